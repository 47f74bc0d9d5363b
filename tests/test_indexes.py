"""The stored vector index, the inverted index and the fusion of ranked lists, against exhaustive search."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from folioscope.config import Settings
from folioscope.engine import Engine
from folioscope.operators import fusion, lexical, retrieval
from folioscope.operators.vector_index import Shape, VectorIndex
from folioscope.sources import documents

N, D = 3000, 32


def vectors(n=N, seed=1, hot=0):
    """Unit vectors around some directions, the first ``hot`` of them alike."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(40, D))[r.integers(0, 40, n)] + 0.6 * r.normal(size=(n, D))
    x[:hot] = x[0]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, first=0, batch="a"):
    rows = [(first + i, v.tolist(), batch, "even" if i % 2 == 0 else "odd", "rare" if i % 200 == 3 else "few" if i % 20 == 1 else "most") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>, batch string, department string, language_code string").repartition(4)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    x = vectors()
    index = VectorIndex(spark, str(tmp_path_factory.mktemp("index")))
    index.fit(frame(spark, x))
    return index, x


def nearest(x, q, k, kept=None):
    s = np.round((1 + x.astype(np.float64) @ q.astype(np.float64)) / 2, 12)
    return sorted((i for i in range(len(x)) if kept is None or kept(i)), key=lambda i: (-s[i], i))[:k]


def recall(got, want):
    return sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))


def batch_of(spark, index, x, asked, k=10, where=None):
    queries = spark.createDataFrame([(q, x[q].tolist()) for q in asked], "query_id long, query_vector array<float>")
    out = {}
    for r in index.search_batch(queries, k, where).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


def test_recall_and_shape(spark, stored):
    index, x = stored
    book = index.codebook()
    assert 20 <= len(book.centres) <= 120 and 5 <= len(book.groups) <= 10 and book.rows == N and book.probes < len(book.centres)
    asked = range(0, N, 20)
    got = batch_of(spark, index, x, asked)
    assert all(len(g) == 10 for g in got.values()) and recall(got, {q: nearest(x, x[q], 10) for q in asked}) >= 0.95
    assert index.entries().count() == N and index.counts().agg(F.sum("n")).first()[0] == N


def test_one_query(spark, stored):
    index, x = stored
    r = index.search(x[7].tolist(), 5).orderBy("rank").collect()
    assert [a["rank"] for a in r] == [1, 2, 3, 4, 5] and r[0]["chunk_id"] == 7
    for a in r:
        assert math.isclose(a["retrieval_score"], (1 + float(x[7].astype(np.float64) @ x[a["chunk_id"]].astype(np.float64))) / 2, abs_tol=1e-9)
    book = index.codebook()
    near = index._near(index.entries(), book, x[7:8].astype(np.float64), index._lists(book, x[7:8], None, index.counts()), 50, None)
    plan = near._jdf.queryExecution().executedPlan().toString()
    read = next(line for line in plan.split("\n") if "PartitionFilters" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ (IN|=)", read) and "embedding" not in read.split("ReadSchema")[1]
    for bad in ([1.0] * 3, [1.0] * D):
        with pytest.raises(ValueError):
            index.search(bad, 0 if len(bad) == D else 1)


@pytest.mark.parametrize("where,kept", [("department = 'even'", lambda i: i % 2 == 0), ("language_code = 'few'", lambda i: i % 20 == 1 and i % 200 != 3), ("language_code = 'rare'", lambda i: i % 200 == 3), ("language_code = 'none'", lambda i: False)])
def test_filters(spark, stored, where, kept):
    index, x = stored
    asked = range(0, N, 60)
    got = batch_of(spark, index, x, asked, where=F.expr(where))
    want = {q: nearest(x, x[q], 10, kept) for q in asked}
    assert all(kept(i) for g in got.values() for i in g)
    if any(want.values()):
        assert recall(got, want) >= 0.95 and all(len(got[q]) == len(want[q]) for q in asked)
    else:
        assert got == {} and index.search(x[0].tolist(), 3, F.expr(where)).count() == 0


def test_batches(spark, tmp_path):
    x, more = vectors(600, 2), vectors(300, 3)
    index = VectorIndex(spark, str(tmp_path), shape=Shape(trials=50))
    assert index.generation() is None and not index.append(frame(spark, x), "a")
    index.fit(frame(spark, x))
    lists = index.codebook().centres
    for _ in range(2):
        assert index.append(frame(spark, more, 600, "b"), "b")
    assert index.entries().count() == 900 and np.array_equal(index.codebook().centres, lists)
    one = spark.createDataFrame([("a",)], "batch string")
    assert index.search(more[5].tolist(), 1).first()["chunk_id"] == 605
    assert index.search(more[5].tolist(), 1, None, one).first()["chunk_id"] < 600
    assert VectorIndex(spark, str(tmp_path)).search(x[3].tolist(), 1).first()["chunk_id"] == 3
    both = np.vstack([x, more])
    index.fit(frame(spark, x).unionByName(frame(spark, more, 600, "b")))
    assert index.generation() == 2 and index.codebook().rows == 900
    asked = range(0, 900, 30)
    assert recall(batch_of(spark, index, both, asked), {q: nearest(both, both[q], 10) for q in asked}) >= 0.95


def test_many_equal_vectors_and_few_rows(spark, tmp_path):
    x = vectors(900, 4, hot=300)
    index = VectorIndex(spark, str(tmp_path / "hot"), shape=Shape(trials=50))
    index.fit(frame(spark, x))
    assert [r["chunk_id"] for r in index.search(x[0].tolist(), 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    few = VectorIndex(spark, str(tmp_path / "few"))
    few.fit(frame(spark, x[300:303], 7))
    assert [r["chunk_id"] for r in few.search(x[301].tolist(), 9).orderBy("rank").collect()][0] == 8 and few.search(x[301].tolist(), 9).count() == 3
    assert VectorIndex(spark, str(tmp_path / "none")).fit(frame(spark, x).limit(0)) is None


def bm25(texts, query):
    """{id: score} of {id: text} by the formula."""
    docs = {i: regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower()) for i, t in texts.items()}
    n, average = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    out = Counter()
    for w in set(regex.findall(r"[\p{L}\p{M}\p{N}]+", query.lower())):
        df = sum(w in d for d in docs.values())
        for i, d in docs.items():
            if tf := d.count(w):
                out[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))
    return {i: round(s, 9) for i, s in out.items()}


def ordered(scores, k):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_words(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{int(200 * rng.random() ** 3)}" for _ in range(4000)] + ["Über", "तेज़", "x"]
    texts = {i * 37: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 90]))) for i in range(500)} | {5: None, 6: "", 9: "w3 " * 400, 10: "w3", 11: "w3"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    index = lexical.LexicalIndex(spark, str(tmp_path))
    index.append(df.where("id % 2 = 0"), "a")
    for _ in range(2):
        index.append(df.where("id % 2 = 1").withColumn("term", F.lit(1)), "b")
    assert index.rows() == len(texts)
    read = 0
    for query in ("w0 w1", "w3", "über W150 w199 w3", "w3 w3 तेज़", "nothing", "", "w0 w5 w10 w20 w50 nothing"):
        want = bm25(texts, query)
        for k in (1, 10, 1000):
            got = [(r["id"], r["score"]) for r in index.scored(query, k).collect()]
            if want is not None:
                assert [i for i, _ in got] == [i for i, _ in ordered(want, k)] and all(math.isclose(s, want[i], abs_tol=2e-9) for i, s in got)
            read += len(got)
        if want is not None:
            assert {r["id"] for r in index.scored(query, None).collect()} == want.keys()
    assert read > 100
    only = spark.createDataFrame([("a",)], "batch string")
    some = {i: t for i, t in texts.items() if i % 2 == 0}
    assert [r["id"] for r in index.scored("w3 w9", 7, only).collect()] == [i for i, _ in ordered(bm25(some, "w3 w9"), 7)]
    # Few ranges go first and few may be named: the bound decides what is read.
    monkeypatch.setattr(lexical, "FIRST", 1)
    monkeypatch.setattr(lexical, "FILTERED", 1)
    assert [r["id"] for r in index.scored("w0 w150", 10).collect()] == [i for i, _ in ordered(bm25(texts, "w0 w150"), 10)]
    plan = index.scored("w3", 5)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("ReadSchema", "") or "text:string" not in plan
    with pytest.raises(ValueError):
        index.scored("w3", 0)


def test_bounds_are_bounds(spark, tmp_path):
    """No row scores more than its range's bound, so ranges below the k-th score can be left out."""
    for k1_tf, least in ((1, 50), (9, 3), (40, 7)):
        one = spark.range(1).select(lexical.part_of(F.lit(k1_tf), F.lit(least), 10.0).alias("x")).first()["x"]
        for tf in range(1, k1_tf + 1):
            for length in (least, least + 1, 5 * least):
                assert spark.range(1).select(lexical.part_of(F.lit(tf), F.lit(length), 10.0).alias("x")).first()["x"] <= one + 1e-12 if tf in (1, k1_tf) else True


@pytest.mark.parametrize("n,m,k,start", [(300, 300, 10, 4), (300, 5, 10, 1), (40, 0, 3, 1), (0, 0, 3, 2), (500, 400, 1, 1), (60, 60, 100, 1)])
def test_fusion(spark, n, m, k, start):
    rng = random.Random(n + m)
    ids = rng.sample(range(1000), n)
    a = {i: rng.choice([0.5, rng.random()]) for i in ids}
    b = {i: rng.choice([0.25, rng.random()]) for i in rng.sample(ids, min(m, n) // 2) + list(range(2000, 2000 + m - min(m, n) // 2))}
    lists = [fusion.by_score(spark.createDataFrame(list(x.items()), "id long, score double").repartition(3)) for x in (a, b)]
    places = [{i: r for r, (i, _) in enumerate(sorted(x.items(), key=lambda y: (-y[1], y[0])), 1)} for x in (a, b)]
    want = sorted(((-sum(1 / (60 + p[i]) for p in places if i in p), i) for i in {*a, *b}))[:k]
    got = fusion.fused(spark, lists, k, start).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["rank_1"], r["rank_2"]) for r in got] == [(i, -s, places[0].get(i), places[1].get(i)) for s, i in want]


def test_engine_modes(spark, tmp_path):
    (tmp_path / "pdfs").mkdir()
    settings = Settings(home=str(tmp_path / "home"), documents=str(tmp_path / "pdfs"), dimension=64, chunk_size=12, chunk_overlap=2, index_from=60)
    engine = Engine(spark, settings, extractor=documents.PlainExtractor()).init()
    assert engine.search("anything", mode="words").count() == 0 and engine.search("anything", mode="both").count() == 0
    rng = random.Random(8)
    fill = [f"term{i}" for i in range(50)]
    put = lambda name, text: (tmp_path / "pdfs" / name).write_text(text)
    put("Physics_Radium_1998.pdf", "Radium glows in the dark at night. " + " ".join(rng.choice(fill) for _ in range(400)))
    engine.ingest()
    assert engine.store.vectors.generation() is None
    put("Kitchen_Bread_2003.pdf", "Bread needs flour and water. " + " ".join(rng.choice(fill) for _ in range(400)))
    engine.ingest()
    assert engine.store.vectors.generation() == 1
    put("Garden_Roses_2004.pdf", "Roses like the sun and some water. " + " ".join(rng.choice(fill) for _ in range(100)))
    engine.ingest()
    store = engine.store
    n = store.read("chunk_index").count()
    assert store.vectors.generation() == 1 and store.vectors.entries().count() == n == store.words.rows()
    for mode in ("vectors", "words", "both"):
        top = engine.search("what glows in the dark", 2, mode).orderBy("rank").first()
        assert top["source"]["book_title"] == "Radium 1998" and top["rank"] == 1, mode
    assert {r["source"]["department"] for r in engine.search("water", 3, department="Garden").collect()} == {"Garden"}
    assert engine.search("roses", 1, "words").first()["source"]["department"] == "Garden"
    for bad in ({"mode": "other"}, {"mode": "words", "department": "x"}, {"k": 0}):
        with pytest.raises(ValueError):
            engine.search("x", **bad)
    # Rows of a batch without its registry are not seen.
    x = store.read("chunk_index").limit(1).withColumn("chunk_id", F.lit(10**6).cast("long"))
    store.vectors.append(x, "lost")
    store.words.append(x, "lost", "chunk_id")
    assert all(r["chunk_id"] < 10**6 for r in engine._nearest("water", 50).collect())
    exact = retrieval.top_k(store.read("chunk_index").select("chunk_id", "embedding"), engine.embedder.embed(["term1 term2"])[0].tolist(), 5, ["chunk_id"])
    assert len({r[0] for r in exact.select("chunk_id").collect()} & {r[0] for r in engine._nearest("term1 term2", 5).select("chunk_id").collect()}) >= 4


def test_compaction(spark, tmp_path, monkeypatch):
    from folioscope.operators import ingest

    (tmp_path / "pdfs").mkdir()
    engine = Engine(spark, Settings(home=str(tmp_path / "home"), documents=str(tmp_path / "pdfs"), dimension=16, chunk_size=8, chunk_overlap=0, index_from=5), extractor=documents.PlainExtractor()).init()
    assert engine.compact() is None
    store = engine.store

    def state():
        tables = [sorted(map(str, store.read(t).select(c).collect())) for t, c in (("books", "file_path"), ("chunks", "es_doc_id"), ("chunk_index", "doc_id"))]
        return tables, store.words.rows(store.committed()), [[(r["rank"], r["quote"]) for r in engine.search("red sea", 3, m).orderBy("rank").collect()] for m in ("vectors", "words")]

    for i in range(3):
        (tmp_path / "pdfs" / f"b{i}.pdf").write_text(f"book {i} says that the sea is red. and some more words of book {i} follow here")
        engine.ingest()
    before = state()
    assert before[1] == 9 and store.committed().count() == 3

    # One that stops before its registry changes nothing.
    put = ingest.Store.put
    monkeypatch.setattr(ingest.Store, "put", lambda self, name, *a: (_ for _ in ()).throw(OSError("away")) if name == "books" else put(self, name, *a))
    with pytest.raises(OSError):
        engine.compact()
    monkeypatch.undo()
    assert state() == before

    new = engine.compact()
    assert state() == before and [r["batch"] for r in store.committed().collect()] == [new]
    (tmp_path / "pdfs" / "b9.pdf").write_text("one more book")
    assert engine.ingest().books == 1
    after = state()
    assert engine.compact() and state() == after and store.committed().count() == 1
    # What the first one replaced is gone now; its own files stay until the next.
    assert {r["batch"] for r in store.all("chunks").select("batch").distinct().collect()} >= {new} and store.all("chunks").select("batch").distinct().count() <= 4
    assert max(r["id"] for r in store.read("chunks").collect()) == after[1]
