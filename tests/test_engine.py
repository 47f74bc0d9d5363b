"""Retrieval, ingest, stream, API, CLI and server, end to end on small files."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
import zlib
from http.server import ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import __main__ as cli
from folioscope.config import Settings
from folioscope.engine import Engine
from folioscope.operators import models, retrieval
from folioscope.plans import schemas, search
from folioscope.server import handler
from folioscope.sources import documents


class Marked(documents.PlainExtractor):
    """Fails on files that say so."""

    def pages(self, content: bytes) -> list[str]:
        if content.startswith(b"BROKEN"):
            raise ValueError("broken file")
        return super().pages(content)


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "pdfs").mkdir()
    settings = Settings(home=str(tmp_path / "home"), documents=str(tmp_path / "pdfs"), dimension=64, chunk_size=30, chunk_overlap=5)
    return Engine(spark, settings, extractor=Marked()).init()


def put(engine, name, text):
    with open(f"{engine.settings.documents}/{name}", "w") as f:
        f.write(text)


def pdf(*pages: str) -> bytes:
    """A PDF file with a deflated and a plain content stream in turn."""
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    out = [f"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [{kids}] /Count {len(pages)} >> endobj\n".encode()]
    for i, p in enumerate(pages):
        data = f"BT /F1 12 Tf ({p}) Tj ET".encode("cp1252")
        extra = b""
        if i % 2 == 0:
            data, extra = zlib.compress(data), b"/Filter /FlateDecode "
        out.append(f"{3 + 2 * i} 0 obj << /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >> endobj\n{4 + 2 * i} 0 obj << ".encode() + extra + f"/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n")
    return b"%PDF-1.4\n" + b"".join(out) + b"%%EOF"


def test_simple_pdf():
    read = documents.SimplePdfExtractor().pages
    assert [p.strip() for p in read(pdf("Hello \\(you\\) \\351", "Second"))] == ["Hello (you) é", "Second"]
    assert read(pdf()) == []
    for bad in (b"", b"no", b"%PDF-1.4\nnothing"):
        with pytest.raises(ValueError):
            read(bad)


def test_list_and_extract(spark, tmp_path):
    assert documents.list_documents(spark, str(tmp_path / "none")).count() == 0
    for name, data in (("a.pdf", pdf("One", "Two")), ("b.PDF", b"junk"), ("c.txt", b"x"), ("d.Pdf", pdf())):
        (tmp_path / name).write_bytes(data)
    files = documents.list_documents(spark, str(tmp_path))
    got = sorted((r.path.rsplit("/", 1)[1], r.page_number or 0, (r.text or "").strip(), bool(r.error)) for r in documents.extract_pages(files, documents.SimplePdfExtractor()).collect())
    assert got == [("a.pdf", 1, "One", False), ("a.pdf", 2, "Two", False), ("b.PDF", 0, "", True), ("d.Pdf", 0, "", False)]


def test_top_k(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8)).astype(np.float32)
    x[7] = x[3]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<float>").repartition(4)
    cos = lambda q: (1 + x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)) / 2
    want = lambda q, k: sorted(range(60), key=lambda i: (-round(float(cos(q)[i]), 9), i))[:k]
    got = retrieval.top_k(df, x[3].tolist(), 5, ["id"], unit=False).orderBy("rank").collect()
    assert [g.id for g in got] == want(x[3], 5) and [g.rank for g in got] == [1, 2, 3, 4, 5] and got[0].id == 3 and got[1].id == 7
    queries = df.where("id % 9 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    for block in (3, 512):
        batch = retrieval.top_k_batch(df, queries, 4, ["id"], unit=False, block=block).orderBy("query_id", "rank").collect()
        assert [b.id for b in batch] == [i for q in range(0, 60, 9) for i in want(x[q], 4)]
    with pytest.raises(Exception, match="expected 3"):
        retrieval.top_k(df, [1.0, 0.0, 0.0], 1, ["id"]).collect()
    with pytest.raises(ValueError):
        retrieval.top_k(df, [1.0] * 8, 0, ["id"])
    plan = retrieval.top_k(df, x[0].tolist(), 5, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_ingest_and_search(engine):
    put(engine, "Physics - Curie - 1998.pdf", "Radium glows in the dark. It is rare.\f\f" + "filler words here. " * 30)
    put(engine, "Dept_Cooking_2003.PDF", "Bread needs flour and water! Salt too.")
    put(engine, "bad.pdf", "BROKEN")
    put(engine, "empty.pdf", " \n\f ")
    report = engine.ingest()
    assert (report.books, report.failed) == (2, 2) and report.chunks > 3
    books = {r.title: r for r in engine.store.read("books").collect()}
    assert books["Physics"].author == "Curie" and books["Physics"].publication_year == 1998 and books["Cooking 2003"].department == "Dept"
    chunks = engine.store.read("chunks").orderBy("id").collect()
    assert [c.id for c in chunks] == list(range(1, len(chunks) + 1)) and len({(c.book_id, c.chunk_index) for c in chunks}) == len(chunks)
    assert all(c.es_doc_id == f"book-{c.book_id}-chunk-{c.chunk_index}" for c in chunks)
    assert {c.page_number for c in chunks if c.book_id == books["Physics"].id} == {1, 3}

    got = engine.search("what glows in the dark?", 3).collect()
    assert got[0].quote == "Radium glows in the dark." and got[0].source.book_title == "Physics" and got[0].source.page_number == 1
    assert [g.qa_score for g in got] == sorted((g.qa_score for g in got), reverse=True) and sorted(g["rank"] for g in got) == [1, 2, 3]
    assert engine.search("x", 1).schema["source"].dataType.fieldNames() == schemas.RESULT["source"].dataType.fieldNames()
    api = engine.api_search("bread water", 1)["results"][0]
    assert api["department"] == "Dept" and api["author"] == "Unknown Author" and api["pdf_link"].startswith("/") and api["page_number"] == 1
    assert json.loads(engine.search_json("bread", 1))["results"][0]["qa_runner"] == "lexical"
    for bad in ({"query": ""}, {"query": "x", "top_k": 0}, {"query": "x", "top_k": 11}, {"query": "x", "top_k": True}):
        with pytest.raises(ValueError):
            engine.api_search(**bad)

    # Known files are not taken again; what failed is tried again, up to the cap.
    again = engine.ingest()
    assert (again.books, again.failed) == (0, 2)
    put(engine, "empty.pdf", "now it has words.")
    assert engine.ingest().books == 1
    assert engine.ingest().failed == 0
    assert max(r.attempt for r in engine.store.read("ingest_errors").collect()) == 3
    ids = sorted(r.id for r in engine.store.read("books").collect())
    assert ids == [1, 2, 3]


def test_uncommitted_batch_is_not_seen(engine):
    put(engine, "a.pdf", "Some words.")
    engine.ingest()
    before = engine.store.read("chunk_index").count()
    rows = engine.store.read("chunk_index")
    engine.store.put("chunk_index", "half", rows)
    assert engine.store.all("chunk_index").count() == 2 * before and engine.store.read("chunk_index").count() == before


def test_empty_engine(engine):
    assert engine.search("x").count() == 0
    assert "message" in json.loads(engine.search_json("x"))
    with pytest.raises(ValueError):
        Engine(engine.spark, Settings(home=engine.settings.home, dimension=32)).init()


def test_stream(engine):
    run = lambda: engine.watch(once=True).awaitTermination()
    titles = lambda: sorted(r.title for r in engine.store.read("books").collect())
    put(engine, "one.pdf", "First text.")
    put(engine, "bad.pdf", "BROKEN")
    run()
    assert titles() == ["one"] and engine.store.read("ingest_errors").count() == 1
    put(engine, "one.pdf", "Rewritten, which counts for nothing.")
    put(engine, "two.PDF", "Second text.")
    put(engine, "bad.pdf", "mended now.")
    run()
    assert titles() == ["bad", "one", "two"]
    assert [r.chunk_text for r in engine.store.read("chunks").join(engine.store.read("books").where("title = 'one'").select(F.col("id").alias("book_id")), "book_id").collect()] == ["First text."]
    run()
    assert titles() == ["bad", "one", "two"]


def test_batch_that_runs_again_replaces_itself(engine):
    from folioscope.operators.ingest import ingest

    put(engine, "one.pdf", "First text.")
    files = documents.list_documents(engine.spark, engine.settings.documents)
    for _ in range(2):
        report = ingest(files, engine.store, engine.extractor, engine.embedder, "stream-0", 0)
        assert (report.books, report.chunks) == (1, 1)
    assert engine.store.read("books").count() == engine.store.read("chunks").count() == 1


def test_projections(spark):
    source = "struct<book_title:string,author:string,department:string,page_number:int,file_path:string>"
    rows = [(1, "q", ("T", "A", "D", 4, "./data/pdfs/x.pdf"), "p", "c"), (2, None, ("", None, None, None, ""), "", "chunk"), (3, "q", (None, "", None, 0, "/abs.pdf"), None, None), (4, "q", ("T", "A", None, 1, "././x"), "p", "c")]
    df = spark.createDataFrame(rows, f"i int, quote string, source {source}, matched_paragraph string, chunk_preview string")
    got = [tuple(r) for r in search.api_results(df.orderBy("i")).collect()]
    assert got[0] == ("q", "T", "A", "D", 4, "/data/pdfs/x.pdf", "p")
    assert got[1] == ("", "Unknown Title", "Unknown Author", None, 0, "#", "chunk")
    assert got[2] == ("q", "Unknown Title", "Unknown Author", None, 0, "/abs.pdf", "") and got[3][5] == "/./x"
    assert search.api_results(df).columns == schemas.API_RESULT.fieldNames()
    shown = search.client_results(search.api_results(df)).orderBy("exact_quote").collect()
    assert {r.preview for r in shown} == {"/data/pdfs/x.pdf#page=4", "##page=0", "/abs.pdf#page=0", "/./x#page=1"}


def test_rerank_is_stable_and_empty_hits_use_their_rank(spark):
    rows = [(1, "", 0.9), (2, "b c.", 0.2), (3, "d e.", 0.5), (4, "f.", 0.2)]
    df = spark.createDataFrame(rows, "rank int, text string, s double")
    hits = df.select("rank", "text", F.lit(0.5).alias("retrieval_score"), *[F.lit(None).cast("string").alias(c) for c in ("title", "author", "department", "file_path")], F.lit(1).alias("page_number"), F.struct(F.lit("").alias("answer"), F.col("s").alias("score"), F.lit(-1).alias("start"), F.lit(-1).alias("end")).alias("qa"))
    assert [r["rank"] for r in search.results(hits, "x").collect()] == [3, 2, 4]


def test_models_on_tables(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "Beta!")], "i int, text string")
    got = {r.i: np.array(r.embedding) for r in models.embedded(df, models.HashingEmbedder(16)).collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-6 for x in got.values()) and len(got[2]) == 16
    qa = {r.i: r.qa for r in models.answered(df, models.LexicalAnswerer(), F.lit("beta")).collect()}
    assert qa[1].answer == "beta" and qa[1].start == 6 and qa[2].start == -1


def test_settings(monkeypatch):
    monkeypatch.setenv("FOLIOSCOPE_CHUNK_SIZE", "12")
    monkeypatch.setenv("FOLIOSCOPE_DEVICE", "CUDA")
    s = Settings.from_environment()
    assert (s.chunk_size, s.device, s.chunk_overlap) == (12, "cuda", 50)
    for bad in ({"chunk_size": 0}, {"chunk_overlap": -1}, {"dimension": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_command_line(engine, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: engine.spark)
    for k in ("home", "documents", "dimension"):
        monkeypatch.setenv(f"FOLIOSCOPE_{k.upper()}", str(getattr(engine.settings, k)))
    put(engine, "x.pdf", "no pdf")
    assert cli.main(["init"]) == 0
    assert cli.main(["ingest", "--once"]) == 0
    assert cli.main(["search", "--query", "words"]) == 0
    assert json.loads(capsys.readouterr().out)["results"] == []
    assert cli.main(["search", "--query", ""]) == 1
    with pytest.raises(SystemExit):
        cli.main(["search"])


def test_server(engine, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "secret").write_text("s")
    put(engine, "a.pdf", "Water boils.")
    engine.ingest()
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(engine, str(tmp_path / "data")))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode())) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    try:
        assert call("/health") == (200, b'{"status": "ok"}') and call("/data/f.pdf") == (200, b"%PDF")
        assert call("/data/../secret")[0] == call("/data/%2e%2e/secret")[0] == call("/x")[0] == 404
        status, body = call("/api/search", {"query": "water"})
        assert status == 200 and json.loads(body)["results"][0]["exact_quote"] == "Water boils."
        assert call("/api/search", {"query": ""})[0] == call("/api/search", [])[0] == call("/api/search", {"query": "x", "top_k": 99})[0] == 422
    finally:
        server.shutdown()
