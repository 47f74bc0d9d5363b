"""Many rules against few, and links of all forms against the SQL."""

import random

import duckdb
from pyspark.sql import functions as F

from folioscope.llm import registry, sql, urls


def test_many_rules_are_joined(spark, monkeypatch):
    r = random.Random(3)
    names = ["a", "b", "com", "x.com", "y.x.com", "org", "", "co.uk"]
    rules = [urls.rule(f"{r.choice([n for n in names if n])}/{r.choice(['', 'p', 'p/q', 'long/'])}", r.choice(["allow", "block"])) for _ in range(40)]
    url = lambda: f"http://{r.choice(['', 'w.', 'W.v.'])}{r.choice(names)}{r.choice(['', '/', '/p', '/p/q/r', '/long/x', '/other'])}"
    rows = [(i, url(), None) for i in range(300)] + [(400, None, None), (401, "no url", "")] + [(500 + i, "http://w.x.com/p/q", "<link rel=canonical href='http://b/p'>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    few = sorted(map(tuple, urls.judge(df, rules).collect()))
    monkeypatch.setattr(urls, "INLINE_RULES", 3)
    assert sorted(map(tuple, urls.judge(df, rules).collect())) == few
    assert len({x[3] for x in few}) > 5
    # Far more rules than could be part of a plan.
    more = [urls.rule(f"h{i}.org/", "block") for i in range(5000)]
    got = urls.judge(spark.createDataFrame([(1, "http://h77.org/x", ""), (2, "http://x.h4999.org", ""), (3, "http://h.org/", "")], "page_id int, url string, html string"), more)
    assert {x.page_id: x.verdict for x in got.collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_all_forms_of_links_against_sql(spark, tmp_path):
    r = random.Random(6)
    hosts = ["a.org", "b.net", "example.com", "www.example.com", "c.de"]
    place = lambda: r.choice(["es/", "en/", "fr/", "", "es/1/"]) + str(r.randrange(9))
    url = lambda: f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(['/' + place(), '/', ''])}{r.choice(['', '/', '#t', '?q=1'])}"
    target = lambda: r.choice([url(), place(), "/" + place(), "../" + place(), "./" + place(), "a/../" + place(), "?q=1", "..", ".", "#x", "mailto:a@b.net", "//b.net/es/1", "/x/../../y/./z", "&amp;"])
    tag = lambda: r.choice([f'<link rel="canonical" href="{target()}">', f"<LINK href='{target()}' rel=canonical>", f'<meta http-equiv="refresh" content="1;url={target()}">', "<link rel=canonical>", "<p>"])
    rows = [(i, url(), "".join(tag() for _ in range(r.randrange(3)))) for i in range(200)] + [(900, None, tag()), (901, "x", tag()), (902, url(), None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    names = ["page_id", "host", "path", "rule", "verdict", "inherited"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql.OP1})").fetchall())
    assert sorted(tuple(x[c] for c in names) for x in urls.judge(df, registry.RULES).collect()) == want
    assert 5 < sum(x[5] for x in want) < 150


def test_a_hot_key_stays_spread(spark):
    """Rows of one address and rows without one are not exchanged by it."""
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://a.org/x").when(F.col("id") % 3 == 1, F.concat(F.lit("http://u.org/"), "id")).alias("url"), F.lit("").alias("html"))
    known = spark.createDataFrame([("http://a.org/x", "http://x.net/fr/")], "source string, target string")
    got = urls.judge(rows, registry.RULES, redirects=known).groupBy("verdict", "inherited").count().collect()
    assert {(x.verdict, x.inherited): x["count"] for x in got} == {("block", True): 1000, ("allow", False): 2000}
