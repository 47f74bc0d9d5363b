"""The data source of document files: the rows of the file source, read in tasks, and streams that go on after a restart."""

from __future__ import annotations

import os

import pytest

from folioscope.sources import documents, paged


def rows(df):
    return sorted(((r["path"], r["page_number"] or 0, r["text"] or "", r["error"] or "") for r in df.collect()))


def put(folder, name, text, age=60.0):
    path = folder / name
    path.write_text(text)
    at = path.stat().st_mtime - age
    os.utime(path, (at, at))


def test_same_rows_as_the_file_source(spark, tmp_path):
    paged.register(spark)
    folder = tmp_path / "pdfs"
    folder.mkdir()
    read = lambda **more: spark.read.format("paged_documents").options(extractor="plain", **more).load(str(folder))
    assert rows(read()) == []
    for i in range(23):
        put(folder, f"file {i} ü.PdF" if i % 2 else f"file {i}.pdf", f"one {i}\ftwo {i}")
    put(folder, "other.txt", "no")
    (folder / "folder.pdf").mkdir()
    (folder / "bad.pdf").write_bytes(b"\xff\xfe\xff")
    want = rows(documents.extract_pages(documents.list_documents(spark, str(folder)), documents.PlainExtractor()))
    assert rows(read()) == want and len(want) == 47
    assert rows(read(parts="1")) == want == rows(read(parts="7")) and read(parts="7").rdd.getNumPartitions() == 7
    missing = spark.read.format("paged_documents").load(str(tmp_path / "none"))
    assert missing.count() == 0
    for bad in ({"extractor": "other"}, {"parts": "0"}):
        with pytest.raises(Exception, match="extractor is one of"):
            spark.read.format("paged_documents").options(**bad).load(str(folder)).count()


def test_stream(spark, tmp_path):
    paged.register(spark)
    folder, out = tmp_path / "pdfs", str(tmp_path / "out")
    folder.mkdir()

    def run():
        s = spark.readStream.format("paged_documents").option("extractor", "plain").load(str(folder))
        s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["text"] for r in spark.read.parquet(out).collect())

    put(folder, "a.pdf", "a1\fa2", 300)
    assert run() == ["a1", "a2"]
    put(folder, "b.pdf", "b1", 200)
    put(folder, "late.pdf", "not settled", -600)
    assert run() == ["a1", "a2", "b1"] == run()
