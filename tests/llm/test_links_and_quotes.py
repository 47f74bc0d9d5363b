"""URL aliases and quotation linking on planted cases, and against the SQL on fixtures with links and quotes."""

import random

import duckdb
from pyspark.sql import functions as F

from folioscope.llm import quotes, registry, sql, urls

R = registry.RULES


def judged(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.inherited) for r in urls.judge(df, R, **more).collect()}


def test_rules(spark):
    rows = [(0, "http://A.Example.com/en/x?y#z", None), (1, "https://www.example.com/en/", None), (2, "https://www.example.com/fr/", None), (3, "http://x.net/es/1", ""), (4, "http://net/fr/", ""), (5, "http://notexample.com", ""), (6, "http://x.org?q=a://b/c", ""), (7, None, None), (8, "no scheme/com/", ""), (9, "http://x.NET/ES/", ""), (10, "ftp://u@x.com:80/", ""), (11, "http://É.com/É", "")]
    got = judged(spark, rows)
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block", False)
    assert got[1][2:4] == ("www.example.com/en/", "allow") and got[2][2:4] == ("com/", "allow")
    assert got[3][2:4] == ("net/es/", "block") and got[4][2:4] == ("net/fr/", "block")
    assert got[5] == ("notexample.com", "", None, "allow", False)
    assert got[6][:3] == ("x.org", "", None) and got[7] == ("", "", None, "allow", False) == got[8]
    assert got[9][:3] == ("x.net", "/ES/", None) and got[10] == ("u@x.com:80", "/", None, "allow", False)
    assert got[11][:3] == ("É.com", "/É", "com/")


def test_aliases_inherit_blocks_and_allows_go_first(spark):
    canonical = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
    refresh = lambda u: f"<meta http-equiv=refresh content='0; URL={u}'>"
    rows = [
        (1, "http://a.org/1", canonical("http://b.net/es/1")),  # blocked by its target
        (2, "http://c.org/2", refresh("//a.org/1#top")),  # two steps
        (3, "https://www.example.com/en/3", canonical("http://b.net/es/1")),  # explicit allow
        (4, "http://c.org/4", canonical("/2")),  # three steps, relative
        (5, "https://c.org:443/4/", None),  # another spelling of 4
        (6, "http://d.org/", canonical("http://d.org/")),
        (7, "http://e.org/", canonical("https://www.example.com/en/3")),  # alias of an allowed page of the same component
        (8, None, canonical("http://b.net/es/1")),
        (9, "http://f.org/?a=1", ""),
        (9, "http://f.org/?a=1", ""),
    ]
    got = judged(spark, rows)
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "block", 8: "allow", 9: "allow"}
    assert {k for k, v in got.items() if v[4]} == {1, 2, 4, 5, 7}
    known = spark.createDataFrame([("http://f.org/?a=1", "http://x.net/fr/"), (None, "http://x.net/fr/")], "source string, target string")
    more = urls.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), R, redirects=known)
    assert [r.verdict for r in more.where("page_id = 9").collect()] == ["block", "block"]
    assert urls.judge(spark.createDataFrame([], "page_id int, url string, html string"), R).count() == 0
    bare = urls.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), R, html_col=None)
    assert {r.page_id: r.verdict for r in bare.where("page_id < 3").collect()} == {1: "allow", 2: "allow"}


def test_urls_against_sql(spark, tmp_path):
    r = random.Random(5)
    hosts = ["a.org", "b.net", "example.com", "www.example.com", "x.example.com", "c.de"]
    url = lambda: f"http{r.choice(['', 's'])}://{r.choice(hosts)}/{r.choice(['es/', 'en/', 'fr/', ''])}{r.randrange(12)}{r.choice(['', '/', '#t', '?q=1'])}"
    rows = [(i, url(), r.choice(["", f'<link rel="canonical" href="{url()}">', f'<meta http-equiv="refresh" content="1;url={url()}">'])) for i in range(150)] + [(900, None, None), (901, "x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    names = ["page_id", "host", "path", "rule", "verdict", "inherited"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql.OP1})").fetchall())
    assert sorted(tuple(x[c] for c in names) for x in urls.judge(df, R).collect()) == want
    assert sum(x[5] for x in want) > 5


MESSAGES = [
    (1, 0, "user", "First line here.\nSecond  LINE."),
    (1, 1, "assistant", "> second line.\nI answer that."),
    (1, 2, "user", "> I answer that.\n>> First line here.\n\nMore words\n"),
    (1, 3, "user", "> First line here.\n> Second line.\n> I answer that.\nBoth"),
    (1, 4, "user", "> nobody said this\nopen"),
    (1, 5, "assistant", "> open\n> Both"),
    (2, 0, "user", "> Both\nother conversation"),
    (2, 1, "user", None),
    (2, 1, "user", None),
    (None, 3, "user", "a > b"),
    (2, None, None, "> other conversation"),
]


def reply_ordered(spark, rows):
    return quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_threads(spark):
    got = {(r.conv_id, r.turn): r for r in reply_ordered(spark, MESSAGES).collect()}
    of = lambda t: (got[1, t].parent_turn, got[1, t].root_turn, got[1, t].depth, got[1, t].position)
    # Turn 5 quotes a line of turn 3 and one of turn 4: the later one.
    assert [of(t) for t in range(6)] == [(None, 0, 0, 0), (0, 0, 1, 1), (1, 0, 2, 3), (0, 0, 1, 2), (None, 4, 0, 4), (4, 4, 1, 5)]
    assert got[1, 2].body == "More words" and got[1, 2].n_quoted == 2 and got[1, 2].n_linked == 2 and got[1, 5].body == ""
    assert got[2, 0].parent_turn is None and got[2, 0].n_quoted == 1 and got[2, 0].n_linked == 0
    assert got[None, 3].body == "a > b" and got[2, None].parent_turn is None
    assert reply_ordered(spark, []).count() == 0


def test_quotes_against_sql(spark, tmp_path):
    r = random.Random(8)
    said = [f"line {i} of words" for i in range(25)]
    rows = list(MESSAGES)
    for conv in range(10, 16):
        for turn in range(r.randrange(3, 40)):
            text = [f"{r.choice(['', '', '> ', '>> ', ' >>> '])}{r.choice(said)}" for _ in range(r.randrange(4))]
            rows.append((conv, turn, r.choice(["user", "assistant"]), "\n".join(text)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations/*.parquet')")
    names = ["conv_id", "position", "turn", "role", "body", "parent_turn", "root_turn", "depth", "n_quoted", "n_linked"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql.OP4})").fetchall(), key=repr)
    got = quotes.reply_ordered(df.repartition(5)).collect()
    assert sorted((tuple(x[c] for c in names) for x in got), key=repr) == want
    assert max(x[7] for x in want) >= 3
    places = {}
    for x in got:
        places.setdefault(x.conv_id, []).append(x.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_other_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 3)], "conv_id long, turn long, role string, text string, root long")
    assert quotes.reply_ordered(df).select(F.col("position"), "root_turn").first() == (0, 0)
