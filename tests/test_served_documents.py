"""Files that were taken in, searched and downloaded; retries without new files; devices; logits; lists of vectors."""

from __future__ import annotations

import json
import threading
import time
import urllib.parse
import urllib.request
from http.server import ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.config import Settings
from folioscope.engine import Engine
from folioscope.operators import ann, chunking, ingest, models, retrieval
from folioscope.server import handler
from tests.test_engine import Marked, pdf, put


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "pdfs").mkdir()
    settings = Settings(home=str(tmp_path / "home"), documents=str(tmp_path / "pdfs"), dimension=32, poll_seconds=1)
    return Engine(spark, settings, extractor=Marked()).init()


def test_links_of_results_can_be_fetched(engine, tmp_path):
    for name in ("Physics Book - Ann Lee - 2020.pdf", "odd [name] {1}*.pdf"):
        put(engine, name, f"Radium glows in {name.split()[0]}.")
    assert engine.ingest().books == 2
    assert {r.file_path for r in engine.store.read("books").collect()} == {"./data/pdfs/Physics Book - Ann Lee - 2020.pdf", "./data/pdfs/odd [name] {1}*.pdf"}
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(engine, str(tmp_path / "none")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for hit in engine.api_search("what glows", 2)["results"]:
            assert hit["pdf_link"].startswith("/data/pdfs/")
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{urllib.parse.quote(hit['pdf_link'])}") as r:
                assert b"Radium glows" in r.read()
    finally:
        server.shutdown()
    # A folder that moved holds the same files.
    (tmp_path / "pdfs").rename(tmp_path / "moved")
    moved = Engine(engine.spark, Settings(home=engine.settings.home, documents=str(tmp_path / "moved"), dimension=32), extractor=Marked())
    assert moved.ingest().books == 0


def test_failed_files_are_tried_without_new_ones(engine):
    put(engine, "bad.pdf", "BROKEN")
    engine.watch(once=True).awaitTermination()
    assert engine.store.read("books").count() == 0
    put(engine, "bad.pdf", "mended now.")
    engine.watch(once=True).awaitTermination()
    assert [r.title for r in engine.store.read("books").collect()] == ["bad"]


def test_every_poll_tries_failed_files(engine):
    put(engine, "bad.pdf", "BROKEN")
    watch = engine.watch()
    try:
        end = time.time() + 60
        while engine.store.read("ingest_errors").isEmpty() and time.time() < end:
            time.sleep(0.5)
        put(engine, "bad.pdf", "mended now.")
        while engine.store.read("books").isEmpty() and time.time() < end:
            time.sleep(0.5)
        assert engine.store.read("books").count() == 1 and watch.isActive
    finally:
        with watch.lock:
            watch.stop()


def test_files_are_looked_up_by_path(engine):
    put(engine, "a.pdf", "Some words.")
    files = engine.spark.read.format("binaryFile").load(engine.settings.documents)
    plan = ingest.new_of(files.select("path"), engine.store, "b")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "LeftAnti" in plan


def test_numbers_over_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunking, "RANGE_ROWS", 7)
    df = spark.createDataFrame([(f"p{i:03}", i % 4) for i in range(50)], "path string, n long").repartition(3)
    got = chunking.with_running(df, "path", {"id": F.lit(1), "first": F.col("n")}, str(tmp_path / "x")).orderBy("path").collect()
    assert [r.id for r in got] == list(range(50)) and [r.first for r in got] == [sum(i % 4 for i in range(k)) for k in range(50)]
    assert chunking.with_running(df.limit(0), "path", {"id": F.lit(1)}, str(tmp_path / "y")).count() == 0


def test_blank_queries(engine):
    for query in ("", " ", "\n\t"):
        for ask in (engine.search, engine.api_search):
            with pytest.raises(ValueError):
                ask(query)


def test_devices(monkeypatch, caplog):
    monkeypatch.setattr(models, "has_gpu", lambda: True)
    assert [models.device_for(d) for d in ("auto", "cpu", "cuda")] == ["cuda", "cpu", "cuda"]
    monkeypatch.setattr(models, "has_gpu", lambda: False)
    assert [models.device_for(d) for d in ("auto", "cpu", "cuda")] == ["cpu"] * 3 and "no GPU" in caplog.text
    with pytest.raises(ValueError):
        models.device_for("tpu")


def test_pairs_are_cut_and_located(tmp_path):
    from tokenizers import Tokenizer, models as m, pre_tokenizers

    tok = Tokenizer(m.WordLevel({"[UNK]": 0, "who": 1, "glows": 2, "radium": 3}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "tokenizer.json"))
    pairs = models.PairEncoder(str(tmp_path / "tokenizer.json"), limit=6)
    ids, mask, own = pairs.encode("who glows", "the radium glows " + "much " * 50)
    assert len(ids) == len(mask) == 6 and own == [None, None, (0, 3), (4, 10), (11, 16), (17, 21)]

    class Session:
        def get_inputs(self):
            return [type("I", (), {"name": "input_ids"})]

        def run(self, names, feed):
            assert names == ["start_logits", "end_logits"] and feed["input_ids"].shape == (1, 6)
            return [np.array([[9.0, 0, 1, 5, 0, 0]]), np.array([[9.0, 0, 9, 0, 4, 0]])]

    logits = models.OnnxLogits(str(tmp_path), "cpu", 6)
    logits._loaded = pairs, Session()
    got = models.LogitsAnswerer(logits).answer("who glows", "the radium glows " + "much " * 50)
    assert got["answer"] == "radium glows" and (got["start"], got["end"]) == (4, 16)


def test_lists_of_vectors(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([c + 0.3 * r.normal(size=(60, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    lists = ann.fit(df, "id", settings=ann.Settings(lists=12))
    table = ann.listed(df, lists)
    assert lists.probes < 6 and table.count() == len(x)
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = {(q.query_id, q.id) for q in ann.search_batch(table, lists, asked, 10, ["id"]).collect()}
    exact = {(q.query_id, q.id) for q in retrieval.top_k_batch(df, asked, 10, ["id"]).collect()}
    assert len(near & exact) >= 0.9 * len(exact) and len(near) == len(exact)
    one = ann.search(table, lists, x[50].tolist(), 3, ["id"]).orderBy("rank").collect()
    assert one[0].id == 50 and len(one) == 3
    every = ann.Lists(lists.centres, len(lists.centres))
    assert {(q.query_id, q.id) for q in ann.search_batch(table, every, asked, 10, ["id"]).collect()} == exact
    none = ann.fit(df.limit(0), "id")
    assert ann.listed(df.limit(0), none).count() == 0


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3000)][::-1], "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, query_vector array<double>")
    got = retrieval.top_k_batch(df, asked, 4, ["id"]).orderBy("query_id", "rank").collect()
    assert [q.id for q in got] == [0, 1, 2, 3] * 2


def test_a_failing_poll_does_not_end_the_others(engine, monkeypatch):
    from folioscope.streaming import watch as streaming

    calls, enough = [], threading.Event()

    def retry(self):
        calls.append(len(calls))
        if len(calls) == 1:
            raise OSError("the store is away")
        if len(calls) == 3:
            enough.set()

    monkeypatch.setattr(streaming.Watch, "retry", retry)
    running = streaming.watch(engine.store, engine.settings.documents, engine.extractor, engine.embedder)
    try:
        assert enough.wait(60)
    finally:
        running.stop()
