"""URL filters by redirect equivalence.

1. Rules (verdict, host, path) are matched by equality only: a url's host is expanded to its suffixes, and for each suffix
   that has rules the url's path is cut at the lengths of that host's rule paths. So the work for a url is bounded by its
   labels and by the different lengths of one host's paths, however many rules there are. Of the rules that fit, the
   longest (host and path) wins, then the one with the longer host; of one rule given twice, allow wins.
2. Edges of equivalence come from the pages' heads (`link rel=canonical`, `meta http-equiv=refresh` with a target, each
   resolved against the page's url and `base`) and from a table of redirects, if there is one. Urls are the same node if
   they differ only in the case of scheme and host (A-Z), in the fragment, or in an empty path for `/`.
3. Connected components over these edges, in a few rounds of joins, make classes of aliases. A class that holds a url with
   an allow rule is allowed; else one that holds a url with a block rule is blocked. Targets that no page has count too.
4. A page's own rule decides for it; without one its class does; else it is allowed.

Only urls are shuffled, never pages; only pages with a `<link` or an `http-equiv` go to Python, which reads their heads.
Node numbers are dealt to the written distinct nodes, so no two urls can be taken for one.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, no aliases, and is allowed;
a null page has no edges; repeated rows are judged alike, each on its own; no rules or no pages are fine; other columns are
kept, and an output column replaces an input column of that name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import bounded_batches, dropped, released, slices, written
from colloquy.llm.components import components
from colloquy.llm.html_text import tokens

ALLOW, BLOCK = "allow", "block"
OUT = ("host", "path", "rule", "verdict", "decided_by")
#: What may stand in a page's head.
HEAD = frozenset("html head title meta link base style script noscript template".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def behind_scheme(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return lower(F.regexp_extract(behind_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The url as a node: lower-case scheme and host, at least `/` for a path, no fragment; null without `://`."""
    rest = F.regexp_extract(behind_scheme(url), r"^[^/?#]*([^#]*)", 1)
    slash = F.when(rest.startswith("/"), "").otherwise("/")
    return F.when(F.instr(url, "://") > 0, F.concat(lower(F.substring_index(url, "://", 1)), F.lit("://"), host_of(url), slash, rest))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the distinct urls (url, not null) that a rule fits."""
    rules = rules.dropna().groupBy(lower(F.col("host")).alias("_host"), F.col("path").alias("_path")).agg(F.min("verdict").alias("_verdict"))
    lengths = rules.groupBy("_host").agg(F.collect_set(F.length("_path")).alias("_lengths"))
    parts = F.split("_all", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    at = urls.select("url", host_of(F.col("url")).alias("_all"), path_of(F.col("url")).alias("_whole"))
    at = at.select("url", "_whole", F.explode(suffixes).alias("_host")).join(lengths, "_host")
    at = at.select("url", "_whole", "_host", F.explode("_lengths").alias("_n")).filter(F.col("_n") <= F.length("_whole"))
    fits = at.select("url", "_host", F.substr("_whole", F.lit(1), F.col("_n")).alias("_path")).join(rules, ["_host", "_path"])
    rule = F.concat("_host", "_path")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(rule), F.length("_host"), rule.alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best"))
    return best.select("url", "_best.rule", "_best.verdict")


def targets(url: str, html: str) -> list[str]:
    """Where a page's head says that it moves or that its canonical copy stands."""
    base, found = url, []
    for kind, tag, attrs, _ in tokens(html):
        if kind == "text" and tag.strip(" \t\n\f\r\ufeff"):
            break  # text ends the head
        if kind == "end" and tag == "head":
            break
        if kind != "start":
            continue
        if tag not in HEAD:
            break
        if tag == "base" and base is url and attrs.get("href"):
            base = resolved(url, attrs["href"]) or url
        elif tag == "link" and "canonical" in attrs.get("rel", "").lower().split():
            found.append(attrs.get("href", ""))
        elif tag == "meta" and attrs.get("http-equiv", "").strip().lower() == "refresh":
            found.append(refresh_target(attrs.get("content", "")))
    return sorted({t for f in found if f.strip() and (t := resolved(base, f))})


def refresh_target(content: str) -> str:
    """The target of `5; url=...`; empty where a page only loads itself again."""
    _, mark, rest = content.replace(",", ";", 1).partition(";") if ";" not in content else content.partition(";")
    rest = rest.strip()
    if not mark or not rest:
        return ""
    if rest[:3].lower() == "url" and rest[3:].lstrip().startswith("="):
        rest = rest[3:].lstrip()[1:].strip()
    if rest[:1] in ("'", '"'):
        rest = rest[1:].partition(rest[0])[0]
    return rest


def resolved(base: str, href: str) -> str | None:
    """href as an absolute url; None if it isn't one of the web."""
    try:
        full = urljoin(base, href.strip(" \t\n\f\r"))
    except ValueError:  # a broken address
        return None
    return full if full[:7].lower() == "http://" or full[:8].lower() == "https://" else None


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target) of each canonical link and redirect in the pages' heads."""
    bounded_batches(pages.sparkSession)
    may = F.col("html").rlike(r"(?i)<link|http-equiv") & F.col("url").contains("://")
    heads = pages.select(F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html")).filter(may)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "html")):
            pairs = [(u, t) for u, h in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True) for t in targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["url", "target"])

    return heads.mapInArrow(released(run), "url string, target string")


def aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """A written table (node, verdict) of the nodes of edges (url, target) whose class a rule decides."""
    links = edges.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).dropna().filter("a <> b").distinct()
    links = written(links, "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    numbered = links.join(nodes.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
    classes = components(numbered.select(F.col("x").alias("a"), F.col("y").alias("b")))
    own = decided(nodes.select(F.col("node").alias("url")), rules).select(F.col("url").alias("node"), "verdict")
    member = nodes.join(classes.select(F.col("node").alias("id"), "component"), "id").select("node", "component")
    verdicts = member.join(own, "node").groupBy("component").agg(F.min("verdict").alias("verdict"))  # allow comes before block
    out = written(member.join(verdicts, "component").select("node", "verdict"), "aliases")
    dropped(links, nodes, classes)
    return out


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """pages without html, with the columns of OUT; redirects: (url, target), what servers have said besides the pages."""
    edges = page_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("url").cast("string").alias("url"), F.col("target").cast("string").alias("target")))
    others = aliases(edges, rules)
    kept = [c for c in pages.columns if c.lower() not in (*OUT, html.lower())]
    own = F.col(f"`{url}`").cast("string")
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], own.alias("_url"), F.coalesce(host_of(own), F.lit("")).alias("host"), F.coalesce(path_of(own), F.lit("")).alias("path"), node_of(own).alias("_node"))
    by_rule = decided(pages.select(own.alias("url")).dropna().distinct(), rules).select(F.col("url").alias("_url"), "rule", F.col("verdict").alias("_own"))
    by_class = others.select(F.col("node").alias("_node"), F.col("verdict").alias("_class"))
    judged = rows.join(by_rule, "_url", "left").join(by_class, "_node", "left")
    verdict = F.coalesce("_own", "_class", F.lit(ALLOW))
    how = F.when(F.col("_own").isNotNull(), "rule").when(F.col("_class").isNotNull(), "alias").otherwise("default")
    return judged.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", verdict.alias("verdict"), how.alias("decided_by"))
