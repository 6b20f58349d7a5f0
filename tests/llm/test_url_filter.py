import random

from inkproof.llm import url_filter as u

RULES = [("com", "/", "allow"), ("bad.com", "/en/", "block"), ("www.bad.com", "/en/", "allow"), ("org", "/x", "block")]


def page(link=None, kind="canonical"):
    if link is None:
        return "<html><body>canonical and refresh are only words here</body></html>"
    return f'<link href="{link}" rel=canonical>' if kind == "canonical" else f"<META http-equiv='Refresh' content='0; url={link}'>"


def test_rules_aliases_and_odd_rows(spark):
    rows = [
        (1, "https://A.bad.com/en/1?q#f", page(), "allow?"),
        (2, "http://www.bad.com/en/1", page(), ""),
        (3, "http://bad.com/fr/", page(), ""),
        (4, "http://free.net/a", page("http://s.org/x/9"), ""),
        (5, "https://free.net/b#frag", page("//free.net/a", "refresh"), ""),
        (6, "http://free.net/c", page("/b"), ""),
        (7, "http://free.net/d", page(), ""),
        (8, "http://other.net/a", page("http://s.org/x/8"), ""),
        (9, "http://other.net/b", page("http://other.net/a"), ""),
        (10, "http://good.com/1", page("http://other.net/b"), ""),
        (11, None, None, ""),
        (12, "no scheme/en/", page("http://s.org/x/9"), ""),
        (13, "http://com", page(), ""),
        (14, "http://x.org/X", None, ""),
        (15, "http://notcom/", page(), ""),
        (7, "http://free.net/d", page(), ""),
        (16, "http://late.net/1", page(), ""),
        (17, "http://free.net/p/q/r", page("../../a"), ""),
        (18, "http://free.net/p/q", page("./../x/../b#top", "refresh"), ""),
        (19, "http://free.net/p", page("mailto:x@s.org"), ""),
        (20, "http://s2.net/k", page("?u=1&amp;v=2"), ""),
        (21, "http://s2.net/k?u=1&v=2", page("http://s.org/x/7"), ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    redirects = spark.createDataFrame([("http://late.net/1", "http://free.net/c"), (None, "http://x.y/")], "from_url string, to_url string")
    got = sorted(tuple(r) for r in u.filter_urls(pages, u.rules_table(spark, RULES), redirects).collect())
    want = [
        (1, "a.bad.com", "/en/1", "bad.com/en/", "block"),
        (2, "www.bad.com", "/en/1", "www.bad.com/en/", "allow"),
        (3, "bad.com", "/fr/", "com/", "allow"),
        (4, "free.net", "/a", None, "block"),
        (5, "free.net", "/b", None, "block"),
        (6, "free.net", "/c", None, "block"),
        (7, "free.net", "/d", None, "allow"),
        (7, "free.net", "/d", None, "allow"),
        (8, "other.net", "/a", None, "allow"),
        (9, "other.net", "/b", None, "allow"),
        (10, "good.com", "/1", "com/", "allow"),
        (11, "", "", None, "allow"),
        (12, "", "", None, "allow"),
        (13, "com", "", None, "allow"),
        (14, "x.org", "/X", None, "allow"),
        (15, "notcom", "/", None, "allow"),
        (16, "late.net", "/1", None, "block"),
        (17, "free.net", "/p/q/r", None, "block"),
        (18, "free.net", "/p/q", None, "block"),
        (19, "free.net", "/p", None, "allow"),
        (20, "s2.net", "/k", None, "block"),
        (21, "s2.net", "/k", None, "block"),
    ]
    assert got == want


def test_long_chains_and_a_hot_target(spark):
    r = random.Random(6)
    order = list(range(300))
    r.shuffle(order)
    pairs = [(f"http://c.net/{a}", f"http://c.net/{b}") for a, b in zip(order, order[1:])]
    pairs += [(f"http://h.net/{i}", "http://evil.org/x") for i in range(500)] + [("http://c.net/0", "http://w.org/x1")]
    pages = spark.createDataFrame([(i, a, None) for i, (a, _) in enumerate(pairs)], "page_id long, url string, html string")
    out = u.filter_urls(pages, u.rules_table(spark, RULES), spark.createDataFrame(pairs, "from_url string, to_url string"))
    assert out.count() == len(pairs) and out.where("verdict <> 'block'").count() == 0
    assert u.filter_urls(pages.where("false"), u.rules_table(spark, RULES)).count() == 0
    assert u.filter_urls(pages, u.rules_table(spark, RULES).where("false")).where("verdict = 'allow'").count() == len(pairs)


def test_every_link_of_a_page_counts(spark):
    html = '<!-- <link rel="canonical" href="http://free.net/z"> --> <link rel=canonical href=http://free.net/y><LINK href=\'http://s.org/x/1\' REL=canonical><link rel=stylesheet href=http://good.com/>'
    pages = spark.createDataFrame([(1, "http://free.net/a", html), (2, "http://free.net/y", None), (3, "http://free.net/z", ""), (4, "http://free.net/w", "")], "page_id long, url string, html string")
    got = {r.id: r.verdict for r in u.filter_urls(pages, u.rules_table(spark, RULES)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_sql_with_the_closure_agrees(spark, tmp_path):
    import duckdb

    from inkproof.llm import queries

    r = random.Random(8)
    urls = [f"http://{r.choice(['a.net', 'b.net', 'www.example.com', 'example.com', 'c.org', 'd.com'])}/{r.choice(['es', 'fr', 'en', 'x'])}/{i}" for i in range(120)]
    links = lambda: r.choice(["", "", page(r.choice(urls)), page(r.choice(urls), "refresh"), page(r.choice(urls)) + page("/es/1"), page("?q=1&amp;z=2"), page("other"), page("//b.net/fr/3#x"), page("mailto:q")])
    rows = [(i, url, links()) for i, url in enumerate(urls)] + [(500, None, page(urls[0])), (501, "nothing", page(urls[1])), (502, urls[0] + "#part", ""), (503, "http://a.net/x/?q=1&z=2", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    order = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(con.execute(f"select {', '.join(order)} from ({queries.OP5_SQL})").fetchall(), key=repr)
    got = sorted((tuple(x) for x in queries.op5_url_filters(spark, str(tmp_path)).select(*order).collect()), key=repr)
    assert got == want and {v for *_, rule, v in got if rule is None} == {"allow", "block"}
