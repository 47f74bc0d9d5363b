"""Faults that only larger tables show: ids that look like years, and what grows faster than the input."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.operators import lexical, retrieval
from folioscope.operators.vector_index import Shape, VectorIndex
from folioscope.plans import oracle, queries, search

SF = "/root/testdata/sf0.001"


def against_sql(spark, name, tables):
    """Rows of a query and of its SQL over a folder of tables."""
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, str(tables))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)


@pytest.fixture
def tables(spark, tmp_path):
    """Tables whose documents have given ids and texts."""

    def put(rows, known=(1,)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("src"), F.pmod("doc_id", F.lit(3)).cast("string")), "n_chars": F.length("text").cast("long")})
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(i, 1, 0) for i in known], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        spark.read.parquet(f"{SF}/embeddings.parquet").write.parquet(str(tmp_path / "embeddings.parquet"))
        return tmp_path

    return put


def test_ids_that_look_like_years(spark, tables):
    """a file's year is the one that is known, whatever digits its name has."""
    at = tables([(i, "a") for i in (1, 7, 1912, 2020, 19_999, 120_055, 99_999_999, 123_456_789, 123_456_780)])
    got, want = against_sql(spark, "books_registry", at)
    assert got == want and len(got) == 8


def exchanged(spark, run):
    """Bytes that the stages of ``run`` write to exchanges."""

    def total():
        none, no_quantiles = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, no_quantiles, none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def said(n, words=600):
    """Texts with ids, no two alike, of about seven bytes for each word."""
    r = random.Random(n)
    return [(i, " ".join(f"w{r.randrange(1 << 20)}" if r.random() < 0.5 else r.choice(["the", "Energy", "la", "of"]) for _ in range(words))) for i in range(n)]


@pytest.mark.parametrize("name", ["bm25_topk", "facets"])
def test_words_are_indexed_without_an_exchange(spark, tables, monkeypatch, name):
    """postings are written where texts are read."""
    monkeypatch.setattr(queries, "spread", lambda df: df)
    rows = said(200)
    at = tables(rows)
    out = []
    assert exchanged(spark, lambda: out.extend(against_sql(spark, name, at))) < sum(len(x) for _, x in rows) / 20
    assert out[0] == out[1] and out[0]


def test_blocks_of_many_rows(spark, tmp_path, monkeypatch):
    """a block is a run of rows, whatever their ids, and blocks of several tasks and batches differ."""
    monkeypatch.setattr(lexical, "FIRST", 2)
    df = spark.createDataFrame([(i * 1_000_003 % 500_009, f"a{' b' * (i % 7)} c{i % 11}") for i in range(3000)] + [(10**12, ""), (10**12 + 1, None)], "id long, text string")
    index = lexical.LexicalIndex(spark, str(tmp_path))
    index.append(df.where("id % 3 > 0").repartition(2), "x")
    index.append(df.where("id % 3 = 0").coalesce(1), "y")
    blocks = spark.read.parquet(f"{tmp_path}/postings").where("term = ''")
    assert blocks.agg(F.sum("n")).first()[0] == 3002 == index.rows() and blocks.count() == blocks.select("block").distinct().count() <= 6
    every = index.scored("b c3", None).orderBy(F.desc("score"), "id").limit(9).collect()
    assert index.scored("b c3", 9).collect() == every and len(every) == 9


def test_nearness_moves_no_texts(spark, tables, monkeypatch):
    """where vectors are too many to be sent to all tasks, ids and counts are exchanged, not texts."""
    monkeypatch.setattr(queries, "spread", lambda df: df)
    rows = said(200, 1500)
    at = tables(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = []
        assert exchanged(spark, lambda: out.extend(against_sql(spark, "hybrid_topk", at))) < sum(len(x) for _, x in rows) / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out[0] == out[1] and out[0]


def test_products_of_few_rows_at_once(spark, monkeypatch):
    """a block of queries meets a bounded number of rows, whatever a batch holds; the best are the same, ties too."""
    rng, seen = np.random.default_rng(3), []
    x = rng.integers(-2, 3, (5000, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(rng.permutation(5000)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float32()))], ["id", "v"])
    monkeypatch.setattr(np, "round", lambda a, n, f=np.round: seen.append(a.shape[1]) or f(a, n))
    got = pa.Table.from_batches(list(retrieval._products(x[:20].astype(np.float64), list(range(20)), 10, True)(iter([batch])))).to_pydict()
    assert max(seen) <= 1024
    near, ids = (1 + x[:20].astype(np.float64) @ x.T) / 2, batch.column("id").to_numpy()
    for q in range(20):
        assert [i for i, o in zip(got["id"], got["_q"]) if o == q] == ids[np.lexsort((ids, -near[q]))[:10]].tolist()


def test_vectors_do_not_go_by_way_of_the_driver(spark, tmp_path):
    """vectors and candidates are merged, however small the planner takes them to be."""
    rows = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k).cast("float")).alias("embedding"), F.lit("a").alias("batch"))
    index = VectorIndex(spark, str(tmp_path), "id", [], Shape(trials=20))
    index.fit(rows)
    plan = index.search_batch(rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Hint=(strategy=merge)" in "".join(x for x in plan.split("\n") if "Join" in x and "list" in x)


def test_pieces_in_any_case(spark):
    """F8: words whose lower case has another length, words inside others, and runs of other characters."""
    texts = ["The theory, THE end the", "\u0130x i\u0307x", "a++b ++", "the\u0301 the", "\u212a k K"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(search.highlights(F.col("t"), ["the", "i\u0307x", "++", "k", "a b"])).collect()
    assert [[tuple(x) for x in r[0]] for r in got] == [[(0, 3), (12, 15), (20, 23)], [(0, 2), (3, 6)], [(1, 3)], [(5, 8)], [(0, 1), (2, 3), (4, 5)]]


@pytest.mark.parametrize("name", ["matched_paragraph", "complete_sentence", "language_codes"])
def test_texts_are_not_folded_by_expressions(spark, name):
    """sentences, paragraphs and runs of letters are no folds, which are interpreted for each element."""
    assert "aggregate(" not in queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().replace("Aggregate", "")
