"""Languages, highlights, facets, pages of results, and retries over a restart, by hand and against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from folioscope.config import Settings
from folioscope.engine import Engine
from folioscope.functions import language as lang
from folioscope.operators import retrieval
from folioscope.plans import queries, search
from folioscope.sources.documents import PlainExtractor
from tests.test_engine import Marked

SF = "/root/testdata/sf0.01"


def plain_buckets(text):
    x = " " + regex.sub(r"[^\p{L}\p{M}]+", " ", (text or "").lower()).strip() + " "
    a = [ord(c) for c in x]
    return [(a[i] * 961 + a[i + 1] * 31 + a[i + 2]) % lang.BUCKETS for i in range(len(a) - 2)]


def test_buckets(spark):
    texts = ["Hello, World!", "", None, "42 -- ", "é", "तेज़ घोड़ा", "a\nb", "𝒜bc 😀 d", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["b"] for r in df.orderBy("i").select(lang.buckets(F.col("t")).alias("b")).collect()]
    assert got == [plain_buckets(t) for t in texts]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.language_codes(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["language_code"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def test_profiles(spark):
    docs = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "xx"), ("lost", None), ("12", "yy")], "text string, lang string")
    p = lang.learned(docs)
    assert p.codes == ["de", "en"] and lang.Profiles.of_rows([{"code": c, "weights": w} for c, w in reversed(p.as_rows())]).as_rows() == p.as_rows()
    some = spark.createDataFrame([("und der Hund",), ("and the cat",), ("",), (None,), ("123",)], "t string")
    assert [r[0] for r in some.select(lang.language(F.col("t"), p)).collect()] == ["de", "en", None, None, None]
    none = lang.learned(docs.limit(0))
    assert none.codes == [] and [r[0] for r in some.select(lang.language(F.col("t"), none)).collect()] == [None] * 5


def test_ingest_fills_the_language(spark, tmp_path):
    (tmp_path / "pdfs").mkdir()
    engine = Engine(spark, Settings(home=str(tmp_path / "home"), documents=str(tmp_path / "pdfs"), dimension=16, chunk_size=6, chunk_overlap=0), extractor=PlainExtractor()).init()
    (tmp_path / "pdfs" / "a.pdf").write_text("the cat and the dog")
    engine.ingest()
    assert [r[0] for r in engine.store.read("chunks").select("language_code").collect()] == [None]
    engine.learn_languages(spark.createDataFrame([("the cat and the dog went with them", "en"), ("der Hund und die Katze gehen mit ihnen", "de")], "text string, lang string"))
    (tmp_path / "pdfs" / "b.pdf").write_text("der Hund und die Katze da und die Hunde gehen mit ihnen the cat and the dog went")
    (tmp_path / "pdfs" / "c.pdf").write_text("1 2 3")
    engine.ingest()
    books = {r["title"]: r["language_code"] for r in engine.store.read("books").collect()}
    assert books == {"a": None, "b": "de", "c": None}
    assert sorted(r[0] or "" for r in engine.store.read("chunk_index").select("language_code").collect()) == ["", "", "de", "de", "en"]
    assert {r["chunk_preview"] for r in engine.search("cat", 5, language="en").collect()} == {"the cat and the dog went"}


def test_highlights(spark):
    texts = ["The cat, the CAT: concatenate", "", None, "तेज़ the", "cat", "😀cat"]
    got = [[(x["start"], x["end"]) for x in r[0]] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(search.highlights(F.col("t"), ["cat", "तेज़"])).collect()]
    assert got == [[(4, 7), (13, 16)], [], [], [(0, 4)], [(0, 3)], [(1, 4)]]
    assert spark.createDataFrame([("a",)], "t string").select(search.highlights(F.col("t"), [])).first()[0] == []


def test_facets(spark):
    df = spark.createDataFrame([("en", "a"), ("en", "b"), ("de", "a"), (None, "a")], "lang string, source string")
    got = {(r["facet"], r["value"]): r["n"] for r in search.facets(df, [["lang"], ["source"], ["lang", "source"]]).collect()}
    assert got == {("lang", "en"): 2, ("lang", "de"): 1, ("lang", ""): 1, ("source", "a"): 3, ("source", "b"): 1, ("lang|source", "en|a"): 1, ("lang|source", "en|b"): 1, ("lang|source", "de|a"): 1, ("lang|source", "|a"): 1}
    assert search.facets(df.limit(0), [["lang"]]).count() == 0


def test_pages_joined_are_the_long_list(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(80, 4)), 1)
    x[10:40] = x[10]
    df = spark.createDataFrame([(i % 7, i, v.tolist()) for i, v in enumerate(x)], "a int, b int, embedding array<double>").repartition(3)
    whole = [(w["a"], w["b"]) for w in retrieval.top_k(df, [1.0, 0.5, 0.0, -1.0], 80, ["a", "b"], unit=False).orderBy("rank").collect()]
    got, after = [], None
    while True:
        page = retrieval.top_k(df, [1.0, 0.5, 0.0, -1.0], 9, ["a", "b"], unit=False, after=after).orderBy("rank").collect()
        if not page:
            break
        got += [(p["a"], p["b"]) for p in page]
        after = (page[-1]["retrieval_score"], page[-1]["a"], page[-1]["b"])
    assert got == whole and len(whole) == 80


def test_blocks_of_queries_are_written(spark):
    """More queries than a block: no plan holds them all, results are those of one block."""
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(70, 5)))], "id long, embedding array<double>")
    asked = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    of = lambda block: sorted((x["query_id"], x["rank"], x["id"]) for x in retrieval.top_k_batch(df, asked, 3, ["id"], unit=False, block=block).collect())
    assert of(16) == of(512) and len(of(16)) == 210
    plan = retrieval.top_k_batch(df, asked, 3, ["id"], unit=False, block=16)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "MapInArrow" not in plan


def test_third_try_after_a_restart(spark, tmp_path):
    """A file fails twice, the process starts anew, and the third try succeeds without a new file."""
    (tmp_path / "pdfs").mkdir()
    settings = Settings(home=str(tmp_path / "home"), documents=str(tmp_path / "pdfs"), dimension=16, poll_seconds=1, max_attempts=5)
    (tmp_path / "pdfs" / "x.pdf").write_text("BROKEN for now")
    for _ in range(2):
        engine = Engine(spark, settings, extractor=Marked()).init()
        engine.watch(once=True).awaitTermination()
    assert [r["attempt"] for r in engine.store.all("ingest_errors").orderBy("attempt").collect()] == [1, 2]
    (tmp_path / "pdfs" / "x.pdf").write_text("whole again")
    again = Engine(spark, settings, extractor=Marked()).init()
    again.watch(once=True).awaitTermination()
    assert [r["title"] for r in again.store.read("books").collect()] == ["x"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_have_right_places(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(["ab", "AB", "é", " ", ", ", "漢", "1"]) for _ in range(40)) for _ in range(60)]
    got = [[(x["start"], x["end"]) for x in row[0]] for row in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(search.highlights(F.col("t"), ["ab", "abab", "1"])).collect()]
    assert got == [[m.span() for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", t) if m[0].lower() in ("ab", "abab", "1")] for t in texts]
