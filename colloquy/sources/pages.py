"""Notes as HTML pages with a table of contents, for many notes at once.

A note's lines are classified one by one; running values over a note tell what is code and which block a line goes on with.
Lines of a block meet by aggregation: paragraphs, headings, rules, quotes, fenced code, tables, and lists of any depth, whose
tags come from folding a block's items over the stack of open lists. Only a block at a time is put together, then the note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.sources.readers import joined_in_order, lines_of

#: Blanks that make a list item one level deeper.
INDENT = 2
CONTENTS_DEPTH = 2


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def inline(c: Column) -> Column:
    """A text with code spans, strong and emphasised words and links as HTML; what stands in a code span stays as it is."""

    def styled(x: Column) -> Column:
        x = F.regexp_replace(x, r"\[([^\[\]]*)\]\(([^()\s]*)\)", '<a href="$2">$1</a>')
        x = F.regexp_replace(x, r"\*\*(\S(?:[^*]*[^*\s])?)\*\*", "<strong>$1</strong>")
        return F.regexp_replace(x, r"(?<![\w*])\*([^*\s](?:[^*]*[^*\s])?)\*(?![\w*])", "<em>$1</em>")

    def pieces(parts: Column) -> Column:
        last = F.size(parts) - 1
        open_ = last % 2 == 1  # the last mark has no partner
        each = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & ~(open_ & (i == last)), F.concat(F.lit("<code>"), x, F.lit("</code>"))).when(open_ & (i == last), F.concat(F.lit("`"), styled(x))).otherwise(styled(x)))
        return F.array_join(each, "")

    return X.let(F.split(escaped(c), "`", -1), pieces)


def anchor(title: Column) -> Column:
    """Lower-case letters and digits of a heading, joined by single hyphens; `section` without any."""
    words = F.btrim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    return F.when(words == "", "section").otherwise(words)


def classified(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, text) with kind, depth, mark (the list's or heading's) and body, and the number of their block."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    t = F.col("text")
    fence = t.rlike(r"^ {0,3}```")
    own = lines.withColumn("_fence", fence).withColumn("_fences", F.sum(F.col("_fence").cast("int")).over(w))
    code = (F.col("_fences") % 2 == 1) | F.col("_fence")
    item = r"^( *)([-*+]|\d{1,9}[.)]) +(.*)$"
    kind = F.when(code, "code").when(F.btrim(t) == "", "blank").when(t.rlike(r"^#{1,6}(?: |$)"), "heading").when(t.rlike(r"^ {0,3}(?:(?:- *){3,}|(?:\* *){3,}|(?:_ *){3,})$"), "rule")
    kind = kind.when(t.rlike(r"^ {0,3}>"), "quote").when(t.rlike(r"^ *\|.*\| *$"), "table").when(t.rlike(item), "list").otherwise("text")
    own = own.withColumn("_kind", kind)
    # A plain line goes on with the paragraph, quote or list before it.
    before = F.last(F.when(F.col("_kind") != "text", F.col("_kind")), ignorenulls=True).over(w)
    own = own.withColumn("kind", F.when((F.col("_kind") == "text") & before.isin("list", "quote"), before).otherwise(F.col("_kind")))
    last = F.lag("kind").over(w)
    quotes = F.length(F.regexp_replace(F.regexp_extract("text", r"^[ >]*", 0), " ", ""))
    own = own.withColumns({"depth": F.when(F.col("_kind") == "list", F.floor(F.length(F.regexp_extract("text", item, 1)) / INDENT)).when(F.col("_kind") == "quote", quotes).when(F.col("_kind") == "heading", F.length(F.regexp_extract("text", "^#+", 0))).cast("int"), "mark": F.when(F.regexp_extract("text", item, 2).rlike("[0-9]"), "ol").otherwise("ul"), "_last": last})
    own = own.withColumn("depth", F.when((F.col("kind") == "quote") & F.col("depth").isNull(), F.last("depth", ignorenulls=True).over(w)).otherwise(F.col("depth")))
    deeper = (F.col("kind") == "quote") & (F.lag("depth").over(w) != F.col("depth"))
    opens = F.col("_fence") & (F.col("_fences") % 2 == 1)
    new = F.col("_last").isNull() | (F.col("_last") != F.col("kind")) | F.col("kind").isin("heading", "rule") | opens | deeper
    body = F.when(F.col("_kind") == "list", F.regexp_extract("text", item, 3)).when(F.col("_kind") == "quote", F.regexp_replace("text", r"^[ >]*", "")).when(F.col("_kind") == "heading", F.regexp_extract("text", r"^#+ *(.*?) *#* *$", 1)).when(F.col("kind") == "code", t).otherwise(F.btrim(t))
    own = own.withColumns({"block": F.sum(new.cast("int")).over(w), "body": body, "starts": F.col("_kind") == "list"})
    return own.filter((F.col("kind") != "blank") & ~F.col("_fence")).select("doc_id", "line_no", "block", "kind", "depth", "mark", "body", "starts")


def headings(rows: DataFrame) -> DataFrame:
    """doc_id, block, level, title and an anchor that no other heading of the note has."""
    own = rows.filter("kind = 'heading'").select("doc_id", "block", F.col("depth").alias("level"), F.col("body").alias("title"), anchor(F.col("body")).alias("_name"))
    n = F.row_number().over(Window.partitionBy("doc_id", "_name").orderBy("block"))  # names hold no two hyphens in a row
    return own.withColumn("anchor", F.when(n == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("--"), n.cast("string")))).drop("_name")


def nested(items: Column) -> Column:
    """Lists of items (depth, mark, html): an item may be one level deeper than the one before, or go back to any."""
    kind = "struct<html:string,open:array<string>>"

    def closed(lists: Column) -> Column:
        return F.array_join(F.transform(F.reverse(lists), lambda m: F.concat(F.lit("</li></"), m, F.lit(">"))), "")

    def step(state: Column, item: Column) -> Column:
        size = F.size(state["open"])
        level = F.least(item["depth"], size)
        below = F.when(size > level + 1, closed(F.slice(state["open"], level + 2, size))).otherwise("")
        here = F.try_element_at(state["open"], level + 1)
        same = here == item["mark"]
        opened = F.concat(F.lit("<"), item["mark"], F.lit("><li>"))
        tag = F.when(here.isNull(), opened).when(same, "</li><li>").otherwise(F.concat(F.lit("</li></"), here, F.lit(">"), opened))
        return F.struct(F.concat(state["html"], below, tag, item["html"]).alias("html"), F.concat(F.slice(state["open"], F.lit(1), level), F.array(item["mark"])).alias("open"))

    start = F.struct(F.lit("").alias("html"), F.array().cast("array<string>").alias("open")).cast(kind)
    return F.aggregate(items, start, lambda s, x: step(s, x).cast(kind), lambda s: F.concat(s["html"], closed(s["open"])))


def table_html(rows: Column) -> Column:
    """Rows of a table's lines; a line of dashes behind the first makes this a header."""
    def cells(line: Column, tag: str) -> Column:
        inner = F.split(F.regexp_replace(F.btrim(line), r"^\||\|$", ""), r"\|", -1)
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(inner, lambda c: F.concat(F.lit(f"<{tag}>"), inline(F.btrim(c)), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    def made(r: Column) -> Column:
        second = F.regexp_replace(F.coalesce(F.try_element_at(r, F.lit(2)), F.lit("")), r"\s", "")
        header = F.regexp_replace(second, r"^\||\|$", "").rlike(r"^:?-+:?(?:\|:?-+:?)*$")
        rest = lambda n: F.array_join(F.transform(F.slice(r, n, F.size(r)), lambda x: cells(x, "td")), "")
        return F.when(header, F.concat(F.lit("<table><thead>"), cells(r[0], "th"), F.lit("</thead><tbody>"), rest(3), F.lit("</tbody></table>"))).otherwise(F.concat(F.lit("<table><tbody>"), rest(1), F.lit("</tbody></table>")))

    return X.let(rows, made)


def blocks_html(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, block and the HTML of each block of classified lines."""
    line = F.struct("line_no", "body", "depth", "mark", "starts")
    one = rows.groupBy("doc_id", "block", "kind").agg(F.array_sort(F.collect_list(line)).alias("_lines"), F.max("depth").alias("_depth"))
    one = one.join(titles, ["doc_id", "block"], "left")
    body = F.transform("_lines", lambda x: x["body"])
    text = inline(F.array_join(body, "\n"))
    tag = F.concat(F.lit("h"), F.col("level").cast("string"))
    heading = F.concat(F.lit("<"), tag, F.lit(' id="'), F.col("anchor"), F.lit('">'), inline(F.col("title")), F.lit("</"), tag, F.lit(">"))
    starts = F.filter(F.transform("_lines", lambda x, i: F.when(x["starts"], i)), lambda i: i.isNotNull())

    def item(first: Column, k: Column) -> Column:
        until = F.coalesce(F.get(starts, k + 1), F.size("_lines"))
        own = F.get("_lines", first)
        whole = F.array_join(F.transform(F.slice("_lines", first + 1, until - first), lambda x: x["body"]), "\n")
        return F.struct(own["depth"].alias("depth"), own["mark"].alias("mark"), inline(whole).alias("html"))

    html = F.when(F.col("kind") == "heading", heading).when(F.col("kind") == "rule", "<hr>")
    html = html.when(F.col("kind") == "quote", F.concat(F.repeat(F.lit("<blockquote>"), F.col("_depth")), F.lit("<p>"), text, F.lit("</p>"), F.repeat(F.lit("</blockquote>"), F.col("_depth"))))
    html = html.when(F.col("kind") == "code", F.concat(F.lit("<pre><code>"), escaped(F.array_join(body, "\n")), F.lit("\n</code></pre>")))
    html = html.when(F.col("kind") == "table", table_html(body)).when(F.col("kind") == "list", nested(F.transform(starts, item)))
    return one.select("doc_id", "block", html.otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>"))).alias("html"))


def contents(titles: DataFrame, depth: int = CONTENTS_DEPTH) -> DataFrame:
    """doc_id and the nested list of links to headings down to a level."""
    link = F.concat(F.lit('<a href="#'), F.col("anchor"), F.lit('">'), inline(F.col("title")), F.lit("</a>"))
    item = F.struct("block", (F.col("level") - 1).alias("depth"), F.lit("ul").alias("mark"), link.alias("html"))
    return titles.filter(F.col("level") <= depth).groupBy("doc_id").agg(nested(F.array_sort(F.collect_list(item))).alias("toc"))


def note_pages(notes: DataFrame) -> DataFrame:
    """work_id, title (the first heading's, else the id) and html of notes (work_id, note): contents, then the note's blocks.

    An empty or null note gives an empty page. Text is escaped; HTML in a note shows as it is written.
    """
    texts = notes.select(F.col("work_id").alias("doc_id"), F.coalesce("note", F.lit("")).alias("text"))
    rows = classified(lines_of(texts))
    titles = headings(rows)
    body = blocks_html(rows, titles).groupBy("doc_id").agg(joined_in_order("html", "block", "\n").alias("body"))
    first = titles.groupBy("doc_id").agg(F.min_by("title", "block").alias("title"))
    page = texts.select("doc_id").join(body, "doc_id", "left").join(contents(titles), "doc_id", "left").join(first, "doc_id", "left")
    title = F.coalesce("title", F.col("doc_id").cast("string"))
    nav = F.when(F.col("toc").isNotNull(), F.concat(F.lit('<nav id="TOC">'), F.col("toc"), F.lit("</nav>\n"))).otherwise("")
    html = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), escaped(title), F.lit("</title></head><body>\n"), nav, F.coalesce("body", F.lit("")), F.lit("\n</body></html>\n"))
    return page.select(F.col("doc_id").alias("work_id"), title.alias("title"), html.alias("html"))
