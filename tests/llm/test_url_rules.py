import duckdb

from tallyvane.llm import url_rules as u
from tallyvane.llm.queries import ORACLES

LINK = '<html><head><link rel="canonical" href="{}"></head>'
META = '<META HTTP-EQUIV="Refresh" CONTENT="0; URL={}">'
PAGES = [
    (1, "http://A.Example.NET/en/x", ""), (2, "http://a.example.net/de/x#f", ""), (3, "https://example.com/de/", None), (4, "http://example.com/fr/", ""), (5, "http://x.org/fr/1?q=/de/", ""),
    (6, "http://notexample.net", ""), (7, "http://badnet/", ""), (8, None, LINK.format("http://example.com/de/x")), (9, "no scheme/net/", ""), (10, "http://net/", ""), (11, "http://h.example.net?x=/en/", ""),
    # 20 -> 21 -> 22 (blocked); 22 is no page
    (20, "http://one.info/a", LINK.format("/b#top")), (21, "http://one.info/b", META.format("http://s.example.com/de/22")),
    # 30 is joined with a blocked and an allowed one: allowed
    (30, "http://two.info/a", LINK.format("http://x.net/1") + META.format("http://y.org/fr/2")), (31, "http://x.net/1", ""),
    # relative, without scheme, itself
    (40, "http://three.info/d/e", LINK.format("f")), (41, "http://three.info/d/f", LINK.format("//x.net/3")), (42, "http://four.info/", LINK.format("http://four.info/")), (43, "http://four.info", LINK.format("g")),
    (20, "http://one.info/a", LINK.format("/b")), (50, "", "x"), (None, "http://one.info/b", ""),
]
WANT = {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "allow", 20: "block", 21: "block", 30: "allow", 31: "block", 40: "block", 41: "block", 42: "allow", 43: "allow", 50: "allow", None: "block"}


def test_rules_and_equivalents(spark):
    df = spark.createDataFrame([(*r, "c", "d") for r in PAGES], "page_id long, url string, html string, host string, node string")
    got = u.judge(df).collect()
    assert len(got) == len(PAGES)
    for r in got:
        assert r.verdict == WANT[r.page_id], r
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule) == ("a.example.net", "/en/x", "example.net/en/") and by[5].rule == "org/fr/" and by[2].rule == "net/" and by[6].rule is None
    assert (by[11].host, by[11].path) == ("h.example.net", "") and (by[8].host, by[8].path) == ("", "") == (by[9].host, by[9].path)
    assert u.judge(df.limit(0)).count() == 0


def test_sql_twin_on_the_same_pages(spark):
    import pandas as pd

    con = duckdb.connect()
    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con.execute("CREATE TABLE pages AS SELECT * FROM pages")
    want = con.execute(ORACLES["op4_redirect_equivalence"]).fetchall()
    got = u.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_recorded_links_and_long_chains(spark):
    pages = spark.createDataFrame([(i, f"http://c.info/{i}", "") for i in range(60)], "page_id long, url string, html string")
    links = spark.createDataFrame([(f"http://c.info/{i}", f"http://c.info/{i + 1}") for i in range(49)] + [("http://c.info/49", "http://q.net/"), (None, "http://c.info/55")], "a string, b string")
    got = {r.page_id: r.verdict for r in u.judge(pages, links).collect()}
    assert all(got[i] == ("block" if i < 50 else "allow") for i in range(60))
    assert {r.verdict for r in u.judge(pages, html_col=None).collect()} == {"allow"}
