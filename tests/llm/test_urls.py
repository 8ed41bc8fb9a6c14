import pytest

from dyadic.llm import urls


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "n", "x", True, 1) for i, u, h in rows], "page_id long, url string, html string, node string, host string, blocked boolean, rule int")


def link(href):
    return f'<html><head><link rel="canonical" href="{href}"></head></html>'


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://A.Example.ORG/es/1?q#f", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/9", "x.com", "/de/9", "com/de/", "block"),
    ("http://x.com/DE/9", "x.com", "/DE/9", None, "allow"), ("http://x.org", "x.org", "", None, "allow"),
    ("x://y?z://q/", "y", "", None, "allow"), ("no scheme.org/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("a\nb://h.net/p\nq#r", "h.net", "/p\nq", None, "allow"), ("http://com/de/", "com", "/de/", "com/de/", "block"),
])
def test_rules(spark, url, host, path, rule, verdict):
    r = urls.judge(pages(spark, [(1, url, None)])).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_blocks_reach_aliases(spark):
    rows = [
        (1, "http://a.net/1", link("https://b.com/de/x")),                                # alias of a blocked page outside the table
        (2, "http://a.net/2#top", "<META content='0; URL=/1' http-equiv=refresh>"),        # alias of an alias
        (3, "http://a.net/3", link("/4")), (4, "http://a.net/4", None),                     # unblocked aliases
        (5, "http://b.com/fr/5", link("http://b.com/de/x")),                              # explicit allow stands
        (6, "http://c.net/dir/page?x=1", '<link href=other rel="nofollow canonical">'), (7, "https://c.net/dir/other", link("?bad=2")),
        (8, "https://c.net/dir/other?bad=2", "<meta http-equiv='refresh' content='5;url=//example.org/es/q'>"),
        (9, "http://a.net/1", None), (9, "http://a.net/1", None), (10, None, link("http://b.com/de/x")), (None, "http://d.net", link("")),
        (11, "http://e.net/1", "<link rel=stylesheet href=http://b.com/de/x><meta content='url=http://b.com/de/x'>"), (12, "http://f.net/1", ""),
    ]
    observed = spark.createDataFrame([("http://f.net/1", "http://a.net/2"), (None, "x"), ("http://a.net/4", "http://a.net/3")], "source string, target string")
    got = urls.judge(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    block = sorted(r.page_id for r in got if r.verdict == "block")
    assert block == [1, 2, 6, 7, 8, 9, 9]
    assert next(r for r in got if r.page_id == 5).verdict == "allow"
    groups = {r.page_id: r.group for r in got}
    assert groups[1] == groups[2] and groups[3] == groups[4] != groups[1] and groups[12] is None
    more = urls.judge(pages(spark, rows), redirects=observed).collect()
    assert sorted(r.page_id for r in more if r.verdict == "block") == [1, 2, 6, 7, 8, 9, 9, 12]


def test_dot_steps_and_sql_of_all_link_forms(spark, tmp_path):
    import duckdb

    rows = [
        (1, "http://a.net/d/e/1", link("../c")), (2, "http://a.net/d/c", link("http://x.com/de/2")),              # up one folder
        (3, "http://a.net/d/3", link("./../../..//4")), (4, "http://a.net//4", link("https://x.com/fr/../de/./4?q=../1")),
        (5, "http://a.net/d/5", link("..")), (6, "http://a.net/", link("//x.com/de/")), (7, "http://b.net/7", link("?de")),
        (8, "http://b.net/7?de", link("#top")), (9, "http://b.net", link("9")), (10, "http://b.net/9", link("/../de/../10/.")),
        (11, "http://b.net/10/", link("mailto:x@y.z")), (12, "http://c.com/fr/12", link("../de/12")), (13, "http://c.com/13", link("de/12")),
        (14, None, None), (15, "no scheme", link("x")), (16, "http://d.net/a/..b/c", link("../.../e")), (17, "http://d.net/a/.../e", None),
    ]
    df = pages(spark, rows)
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert sorted(i for i, r in got.items() if r.verdict == "block") == [1, 2, 3, 4, 5, 6, 13]
    # Names that only begin with dots are no steps.
    assert got[10].group == got[9].group == got[11].group and got[17].group == got[16].group is not None
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(urls.OP10_SQL).fetchall()
    assert sorted(want) == sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.values())


def test_hub_and_empty(spark):
    rows = [(i, f"http://s{i}.net/", link("http://hub.com/de/" if i < 150 else "http://hub.com/en/")) for i in range(300)]
    got = urls.judge(pages(spark, rows)).collect()
    assert sorted(r.page_id for r in got if r.verdict == "block") == list(range(150))
    assert urls.judge(pages(spark, [])).collect() == []
