"""Links of pages with a base, in comments, and with several rel tokens, against SQL and by hand."""

import duckdb
import pytest

from folioscope.llm import registry

PAGES = [
    (1, "http://a.com/x/1.html", '<base href="http://b.net/es/"><link rel="canonical" href="y">', "block"),
    (2, "http://a.com/x/2.html", "<!-- <link rel=canonical href='http://z.net/fr/p'> -->", "allow"),
    (3, "http://a.org/3", '<link rel="nofollow canonical" href="http://z.net/fr/q">', "block"),
    (4, "http://a.org/4", "<link href=http://z.net/fr/r rel='canonical  alternate'>", "block"),
    (5, "http://a.org/5", '<link rel="canonicals" href="http://z.net/fr/s"><link rel="x" title="canonical" href="http://z.net/fr/s">', "allow"),
    (6, "http://a.org/6", '<!-- open <link rel="canonical" href="http://z.net/fr/t">', "allow"),
    (7, "http://z.net/es/7", '<BASE target=_top HREF="../fr/sub/"><meta http-equiv="refresh" content="0; url=k">', "block"),
    (8, "http://a.org/8", '<base href="//z.net/fr/deep/x"><link rel=canonical href="?q=1">', "block"),
    (9, "http://a.org/9", '<base href="#"><base href="http://z.net/fr/"><link rel=canonical href="u">', "allow"),
    (10, "http://a.org/10", '<!-- a --><link rel=canonical\nhref="http://z.net/fr/v"><!-- b -->', "block"),
    (11, "http://a.org/11", '<base href="mailto:x"><link rel=CANONICAL href="/fr/">', "allow"),
    (12, "http://a.org/12", '<link data-rel="canonical" href="http://z.net/fr/w">', "allow"),
    (13, "http://a.org/13", "", "allow"),
    (14, None, '<link rel=canonical href="http://z.net/fr/x">', "allow"),
    (15, "http://a.org/15", None, "allow"),
]


@pytest.mark.parametrize("part", [slice(None), slice(0, 0)])
def test_verdicts(spark, tmp_path, part):
    rows = [(i, u, h) for i, u, h, _ in PAGES[part]]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    out = registry.op1_url_filter(spark, str(tmp_path))
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    # Pages of com have a rule of their own: an explicit allow goes first.
    assert got == {i: "allow" if ".com/" in (u or "") else v for i, u, _, v in PAGES[part]}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.execute(registry.oracle_sql()["op1_url_filter"])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, out.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_a_base_moves_a_link(spark):
    from folioscope.llm import urls

    rows = spark.createDataFrame([(i, u, h) for i, u, h, _ in PAGES], "page_id long, url string, html string")
    got = {(r["source"], r["target"]) for r in urls.link_edges(rows).collect()}
    assert got == {
        ("http://a.com/x/1.html", "http://b.net/es/y"),
        ("http://a.org/3", "http://z.net/fr/q"),
        ("http://a.org/4", "http://z.net/fr/r"),
        ("http://z.net/es/7", "http://z.net/fr/sub/k"),
        ("http://a.org/8", "http://z.net/fr/deep/x?q=1"),
        ("http://a.org/9", "http://a.org/u"),
        ("http://a.org/10", "http://z.net/fr/v"),
        ("http://a.org/11", "http://a.org/fr/"),
    }
