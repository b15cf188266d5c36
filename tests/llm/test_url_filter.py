import random

from tideloom.llm import components, url_filter
from tideloom.llm.queries import URL_RULES

DDL = "page_id long, url string, html string, host int, node string"


def judged(spark, rows, rules=URL_RULES):
    return {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame([(*r, 0, "") for r in rows], DDL), rules).collect()}


def test_rules(spark):
    urls = ["http://Blog.Example.ORG/es/1", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/de/1?a#b", "http://x.com/fr/", "http://xcom/de/", None, "no scheme.com/de/", "http://a.net?x=://b.com/de/", "http://notexample.org/es/"]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)])
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"),
    ]
    assert (got[0]["host"], got[0]["path"], got[6]["host"], got[8]["host"], got[8]["path"]) == ("blog.example.org", "/es/1", "", "a.net", "")


def test_a_hundred_thousand_rules(spark):
    rng = random.Random(3)
    hosts = [f"h{i}.{tld}" for i in range(400) for tld in ("org", "com")] + ["org", "com"]
    rules = list({(rng.choice(hosts), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(12))), rng.choice(["allow", "block"])) for _ in range(180_000)})
    assert len(rules) >= 100_000
    urls = [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(15))) for _ in range(300)]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)], rules)
    by_host = {}
    for k, (h, p, a) in enumerate(url_filter.ranked(rules)):
        by_host.setdefault(h, []).append((k, p, h + p, a))
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)
        labels = host.split(".")
        fits = [r for n in range(len(labels)) for r in by_host.get(".".join(labels[n:]), []) if ("/" + path).startswith(r[1])]
        best = max(fits, default=(0, "", None, "allow"))
        assert (got[i]["rule"], got[i]["verdict"]) == (best[2], best[3])


def test_rules_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST", 0)
    test_rules(spark)
    assert judged(spark, [(1, "http://a.org/", None)], [])[1]["verdict"] == "allow"


def test_aliases_take_the_decision(spark):
    rows = [
        (1, "http://a.net/1#top", '<LINK href="http://b.net/x?a=1&amp;b=2" REL=canonical>'),
        (2, "http://b.net/x?a=1&b=2", "<meta http-equiv='Refresh' content='0; URL=http://c.com/de/9'>"),
        (3, "http://d.net/", "<!-- <link rel=canonical href='http://c.com/de/9'> --><script>'<link rel=\"canonical\" href=\"http://c.com/de/9\">'</script>"),
        (4, "http://e.net/a/b", '<link rel="canonical" href="../z">'),
        (5, "http://e.net/z", '<meta content="5;url=//c.com/de/7" http-equiv="refresh">'),
        (6, "http://f.net/", '<link rel="canonical" href="http://c.com/de/5"><link rel="canonical" href="http://g.org/">'),
        (7, "http://g.org/", '<link rel="canonical" href="http://c.com/de/5">'),
        (8, None, '<link rel="canonical" href="http://c.com/de/9">'),
        (1, "http://A.net/1", None),
    ]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], DDL)
    got = sorted((r["page_id"], r["verdict"]) for r in url_filter.judge(df, URL_RULES).collect())
    assert got == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "block"), (6, "allow"), (7, "allow"), (8, "allow")]


def test_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], DDL), URL_RULES).count() == 0


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    links += [(1, 1), (None, 2), links[0]]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    want = sorted((x, top(x)) for x in parent)
    half = len(links) // 2
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert sorted(map(tuple, components.connected_components(df(links)).collect())) == want
    found = components.connected_components(df(links[:half]))
    again = components.merged_components(found, df([x for x in links[half:] if x[0] is not None and x[0] != x[1]]), found.count())
    assert sorted(map(tuple, again.collect())) == want


def test_sql_twin_on_planted_links(spark):
    import duckdb

    from tideloom.llm.queries import SQL

    rows = [
        (1, "http://a.net/1#top", '<LINK href="http://b.net/x?a=1" REL=canonical>'),
        (2, "http://b.net/x?a=1", "<meta http-equiv='Refresh' content='0; URL=http://c.com/de/9'>"),
        (3, "http://d.net/", "<!-- <link rel=canonical href='http://c.com/de/9'> -->"),
        (4, "http://e.net/a/b", '<link rel="canonical" href="/z">'),
        (5, "http://e.net/z", '<meta content="5;url=//c.com/de/7" http-equiv="refresh">'),
        (6, "http://f.net/", '<link rel="canonical" href="http://c.com/de/5"><link rel="canonical" href="http://g.org/">'),
        (7, "http://g.org/", '<link rel="canonical" href="http://c.com/de/5">'),
        (8, None, '<link rel="canonical" href="http://c.com/de/9">'),
        (9, "http://A.net/1", None),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted(con.sql("SELECT page_id, host, path, rule, verdict FROM (" + SQL["op7_url_filter"] + ")").fetchall())
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES)
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == want


def test_very_long_pages_and_urls(spark):
    rows = [
        (1, "http://a.net/" + "x" * 100_000, "<p>text</p>" * 50_000 + '<link rel="canonical" href="http://c.com/de/1">'),
        (2, "http://" + "a." * 2_000 + "example.org/es/1", ""),
        (3, "http://a.net/" + "x" * 100_000, "<!-- " * 20_000),
    ]
    got = judged(spark, rows)
    assert [got[i]["verdict"] for i in (1, 2, 3)] == ["block", "block", "block"] and got[2]["rule"] == "example.org/es/"


def test_what_is_visible():
    import re

    plainly = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
    rng = random.Random(8)
    parts = ["<!--", "-->", "<script>", "</SCRIPT >", "<Style a>", "</style>", "<link>", " x ", "<scripts>", "<!-->"]
    for _ in range(500):
        html = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert url_filter.visible(html) == plainly.sub(" ", html), html
    long = "<!-- canonical " * 50_000 + '<link rel="canonical" href="http://b.net/">'
    assert url_filter.links_in("http://a.net/", long) == ["http://b.net/"]
