"""Url filters: rules against a plain search, aliases against a plain union of classes and the SQL, odd rows."""

import random

import duckdb
import pytest

from colloquy.llm import url_filters
from colloquy.llm.oracles import SQL
from colloquy.llm.queries import URL_RULES, op13_url_filters


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:stop], rest[stop:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(c.lower() if c < "\x80" else c for c in host), path


def plain_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, verdict) for verdict, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return None, None
    best = max(f[:3] for f in fits)
    return best[2], min(f[3] for f in fits if f[:3] == best)


def plain_node(url):
    if "://" not in url:
        return None
    scheme, rest = url.split("://", 1)
    host, path = plain_parts(url)
    tail = rest[len(host) :].split("#", 1)[0]
    return scheme.lower() + "://" + host + ("" if tail.startswith("/") else "/") + tail


def plain_judge(pages, edges, rules):
    """Verdicts of pages (id, url) with classes joined one edge at a time."""
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = plain_node(a), plain_node(b)
        if a and b:
            top[find(a)] = find(b)
    told = {}
    for node in list(top):
        _, verdict = plain_rule(*plain_parts(node), rules)
        if verdict:
            told.setdefault(find(node), set()).add(verdict)
    out = []
    for i, url in pages:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path, rules)
        node = plain_node(url) if url else None
        if verdict:
            how = "rule"
        elif node in top and find(node) in told:
            verdict, how = min(told[find(node)]), "alias"
        else:
            verdict, how = "allow", "default"
        out.append((i, host, path, rule, verdict, how))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict", "decided_by").collect()), key=str)


def head(canonical=None, refresh=None):
    return (
        "<html><head><title>t</title>"
        + (f'<link rel="canonical" href="{canonical}">' if canonical else "")
        + (f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else "")
        + "</head><body>x</body></html>"
    )


def web(seed, n=120):
    """Pages whose heads name each other at random, and urls that no page has."""
    rng = random.Random(seed)
    hosts = ["a.example.org", "EXAMPLE.org", "b.com", "example.com", "c.net", "notexample.org", "x.y.net"]
    url = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['/en/1', '/en/2', '/es/', '/fr/', '/de/', '/', ''])}{rng.choice(['', str(rng.randrange(40))])}{rng.choice(['', '#top', '?q=1'])}"
    edges = [("http://only.net/", "https://example.com/de/blocked")]
    pages = [(n, edges[0][0], head(edges[0][1]))]
    for i in range(n):
        own, canonical, refresh = url(), rng.random() < 0.2 and url(), rng.random() < 0.1 and url()
        pages.append((i, own, head(canonical, refresh)))
        edges += [(own, t) for t in (canonical, refresh) if t]
    return pages, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_random_webs(spark, tmp_path, seed):
    pages, edges = web(seed)
    want = plain_judge([p[:2] for p in pages], edges, URL_RULES)
    assert {r[-1] for r in want} == {"rule", "alias", "default"} and {r[4] for r in want if r[-1] == "alias"} == {"allow", "block"}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    assert rows(op13_url_filters(spark, str(tmp_path))) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = con.execute(f"SELECT page_id, host, path, rule, verdict, decided_by FROM ({SQL['op13_url_filters']})").fetchall()
    assert sorted(got, key=str) == want


def test_classes_allow_first_and_through_unseen_urls(spark):
    rules = [("block", "bad.net", "/x"), ("allow", "good.net", "/")]
    redirects = [("http://a.net/1", "http://b.net/2"), ("http://b.net/2", "http://bad.net/x1"), ("http://c.net/", "http://bad.net/x2"), ("http://c.net/", "http://good.net/q"), ("http://self.net/", "http://self.net/#here")]
    pages = [(1, "http://A.net/1#part", None), (2, "http://c.net", None), (3, "http://bad.net/x2", None), (4, "http://good.net/q", None), (5, "http://a.net/2", None), (6, "http://self.net/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = spark.createDataFrame(redirects, "url string, target string")
    out = {r.page_id: (r.rule, r.verdict, r.decided_by) for r in url_filters.judge(df, url_filters.rule_table(spark, rules), edges).collect()}
    assert out[1] == (None, "block", "alias") and out[2] == (None, "allow", "alias")
    assert out[3] == ("bad.net/x", "block", "rule") and out[4] == ("good.net/", "allow", "rule")
    assert out[5] == out[6] == (None, "allow", "default")


def test_rules_longest_and_repeated(spark):
    rules = [("block", "COM", "/"), ("allow", "a.com", "/x/"), ("block", "a.com", "/x/y"), ("block", "b.com", "/"), ("allow", "b.com", "/"), ("block", "www.c.com", ""), ("allow", "c.com", "/abc")]
    urls = ["http://a.com/x/z", "http://a.com/x/yy", "http://a.com/", "http://b.com/q", "http://aa.com/x/", "http://www.c.com/abc", "http://www.c.com", "ftp://c.com:21/abc", "http://u@c.com/abc", "a.com/x/", "http://", "://a.com/x/", "http://x.com?://a.com/x/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    folded = [(v, h.lower(), p) for v, h, p in rules]
    assert rows(url_filters.judge(df, url_filters.rule_table(spark, rules))) == plain_judge(list(enumerate(urls)), [], folded)


def test_heads():
    page = "http://a.net/dir/page.html?q=1"
    found = lambda html: url_filters.targets(page, html)
    assert found('<link REL="nofollow Canonical" href="../other?x&amp;y">') == ["http://a.net/other?x&y"]
    assert found("<base href='https://b.net/sub/'><link rel=canonical href=here>") == ["https://b.net/sub/here"]
    assert found('<meta content="5;URL=\'/next\'" http-equiv=Refresh>') == ["http://a.net/next"]
    assert found('<meta http-equiv="refresh" content="3">') == found('<meta http-equiv="refresh" content="">') == []
    assert found('<meta http-equiv="refresh" content="0, url=//c.net/">') == ["http://c.net/"]
    assert found('<!-- <link rel="canonical" href="/no"> --><script>"<link rel=canonical href=/no>"</script>') == []
    assert found('<body><link rel="canonical" href="/comment"></body>') == found('</head><link rel="canonical" href="/late">') == []
    assert found('<link rel="canonical" href="mailto:x@y"><link rel="canonical" href="http://[broken"><link rel="canonical">') == []


def test_odd_rows(spark):
    pages = [(None, None, None, "r"), (1, None, head("http://x.com/de/"), "r"), (2, "", "", "r"), (3, "http://q.net/", None, "r"), (3, "http://q.net/", None, "r"), (4, "http://" + "a." * 3000 + "com/de/" + "x" * 50000, "", "r")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, rule string")
    rules = url_filters.rule_table(spark, URL_RULES)
    out = url_filters.judge(df, rules)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "decided_by"]
    got = rows(out)
    assert got[:2] == [(1, "", "", None, "allow", "default"), (2, "", "", None, "allow", "default")] and (None, "", "", None, "allow", "default") in got
    assert got.count((3, "q.net", "/", None, "allow", "default")) == 2
    assert [r[3:] for r in got if r[0] == 4] == [("com/de/", "block", "rule")]
    assert url_filters.judge(df.limit(0), rules).count() == 0
    assert {r[4] for r in rows(url_filters.judge(df, rules.limit(0)))} == {"allow"}
