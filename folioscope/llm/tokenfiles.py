"""Token-ID files: independent zstandard frames, a document index, a trailing seek table.

A file is

* data frames: zstandard frames of little-endian 32-bit ids, each of whole
  documents and about ``FRAME_IDS`` ids, each of its own;
* an index: one skippable frame with a compressed table of documents (id, ids,
  frame);
* the seek table of the public seekable format: a skippable frame with
  compressed size, size and checksum (low 32 bits of the XXH64 of the content)
  of each data frame, the number of frames, a descriptor and a magic number.

A reader takes the last bytes, then the table, then the frames of the documents
that it wants; other readers of zstandard skip index and table. Files are put
in place by renaming, so that a repeated task replaces a file by the same one.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, keyed, new_path, sliced, written
from .tokens import encoder

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 1 << 7
#: Magic number of a skippable frame that holds the index of documents.
INDEX_MAGIC = 0x184D2A50

FRAME_IDS = 1 << 16
#: Parts of texts that a worker remembers in a generation.
KNOWN = 800_000
FILE_BYTES = 24 << 20
_ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("ids", "<u4"), ("frame", "<u4")])


class Store:
    """The file system of a path, as executors see it: local (shared) folders, or what pyarrow can open."""

    def __init__(self, path: str):
        at = urlparse(path)
        self.local = at.scheme in ("", "file")
        if self.local:
            self.root = at.path
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(path)

    def put(self, name: str, data: list[bytes]) -> None:
        target, own = f"{self.root}/{name}", f"{self.root}/.{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            with open(own, "wb") as f:
                f.writelines(data)
            os.replace(own, target)
            return
        self.fs.create_dir(self.root)
        with self.fs.open_output_stream(own) as f:
            for x in data:
                f.write(x)
        self.fs.move(own, target)

    def open(self, name: str):
        return open(f"{self.root}/{name}", "rb") if self.local else self.fs.open_input_file(f"{self.root}/{name}")


class Writer:
    """Collects the frames of a file."""

    def __init__(self, frame_ids: int = FRAME_IDS):
        self.frame_ids, self.out, self.table, self.index, self.open, self.size = frame_ids, [], [], [], [], 0
        self.compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress

    def add(self, id_: int | None, ids: bytes) -> None:
        self.index.append((id_ or 0, id_ is None, len(ids) // 4, len(self.table)))
        self.open.append(ids)
        self.size += len(ids)
        if self.size >= 4 * self.frame_ids:
            self._close()

    def _close(self) -> None:
        data = b"".join(self.open)
        frame = self.compress(data)
        self.out.append(frame)
        self.table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def finish(self) -> list[bytes]:
        if self.open:
            self._close()
        index = self.compress(np.array(self.index, _ENTRY).tobytes())
        table = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        return [*self.out, struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table]


class Reader:
    """Opens a file by its seek table; decompresses only the frames that are asked for."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2) or file.tell()
        file.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        start = end - 9 - 12 * frames - 8
        file.seek(start)
        if struct.unpack("<II", file.read(8)) != (SKIPPABLE_MAGIC, 12 * frames + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(file.read(12 * frames), "<u4").reshape(frames, 3)
        self.places = np.r_[0, np.cumsum(self.table[:, 0], dtype=np.int64)]
        file.seek(int(self.places[-1]))
        magic, size = struct.unpack("<II", file.read(8))
        if magic != INDEX_MAGIC or int(self.places[-1]) + 8 + size != start:
            raise ValueError("the index is damaged")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(file.read(size)), _ENTRY)
        self.before = np.r_[0, np.cumsum(self.index["ids"], dtype=np.int64)]
        self.first = np.searchsorted(self.index["frame"], np.arange(frames))

    def frame(self, i: int) -> bytes:
        self.file.seek(int(self.places[i]))
        data = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.table[i, 0])))
        if len(data) != self.table[i, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        return data

    def document(self, row: int) -> np.ndarray:
        """The ids of the document in that row of the index."""
        f = int(self.index["frame"][row])
        a = int(self.before[row] - self.before[self.first[f]])
        return np.frombuffer(self.frame(f), "<u4")[a : a + int(self.index["ids"][row])]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, ids before it in this file, ids as bytes) of all, frame by frame."""
        ends = np.r_[self.first[1:], len(self.index)]
        for f, (a, b) in enumerate(zip(self.first.tolist(), ends.tolist(), strict=True)):
            data = memoryview(self.frame(f))
            base = int(self.before[a])
            for r in range(a, b):
                x = int(self.before[r]) - base
                yield None if self.index["null"][r] else int(self.index["id"][r]), int(self.before[r]), data[4 * x : 4 * (x + int(self.index["ids"][r]))]


_MANIFEST = "part int, file string, n_tokens long, n_docs long"


def _writes(path: str, vocabulary: str, end_id: int, frame_ids: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, w = encoder(vocabulary, KNOWN, special), Writer(frame_ids)
        tail = np.array([end_id], "<u4").tobytes()
        part, n = TaskContext.get().partitionId(), 0
        for b in sliced(batches, 512, give_back=False):
            for id_, data in zip(b.column("id").to_pylist(), enc.encode_all([t or "" for t in b.column("text").to_pylist()]), strict=True):
                w.add(id_, data + tail)
                n += len(data) // 4 + 1
        if n:
            Store(path).put(f"part-{part:06d}.ids.zst", w.finish())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"part-{part:06d}.ids.zst"]), pa.array([n], pa.int64()), pa.array([len(w.index)], pa.int64())], ["part", "file", "n_tokens", "n_docs"])

    return run


#: Files whose first positions are summed in one window.
GROUP = 4096


def _started(files: DataFrame) -> DataFrame:
    """``files`` with ``start``: the sum of ``n_tokens`` before it in the order of ``part``, by groups of neighbours."""
    grouped = files.withColumn("_group", F.floor(F.col("part") / GROUP))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each GROUP files.
    groups = grouped.groupBy("_group").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("_before", before(Window.orderBy("_group"))).select("_group", "_before")
    inside = grouped.withColumn("_inside", before(Window.partitionBy("_group").orderBy("part")))
    return inside.join(F.broadcast(groups), "_group").withColumn("start", F.col("_before") + F.col("_inside")).drop("_group", "_before", "_inside")


def write(docs: DataFrame, vocabulary: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, frame_ids: int = FRAME_IDS, file_bytes: int = FILE_BYTES, special: bool = False) -> tuple[DataFrame, str]:
    """Write the ids of all texts in ascending id order; returns the manifest and the folder.

    Manifest: ``file, part, n_docs, n_tokens, start`` (ids in the files before),
    a row for each file, a table itself. Files hold neighbouring ranges of ids in order, so
    rows that repeat an id lie together, by text; a null id comes first, a null text
    counts as empty and has the end id alone, texts of any length are encoded
    whole. An empty table writes no file. ``special``: strings of special tokens
    in a text give these tokens, else they are ordinary text. Ids must be
    integers; other columns are not read.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    slim, _ = keyed(docs.select(id_col, text_col), id_col, text_col)
    # Files of one range each: sampled bounds, one exchange of the texts, sorted within. The
    # first characters of the text let texts under one id go to several files.
    n = bucket_count(docs.select(id_col, text_col), file_bytes)
    dealt = slim.select("id", "text").repartitionByRange(n, "id", F.substring("text", 1, 32)).sortWithinPartitions("id", "text")
    files, _ = written(dealt.mapInArrow(_writes(path, vocabulary, end_id, frame_ids, special), _MANIFEST), "manifest")
    return _started(files), path


def _reads(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(path)
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                with store.open(name) as f:
                    rows = [(i, base + s, len(x) // 4, zlib.crc32(x)) for i, s, x in Reader(f).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["id", "start", "n_tokens", "crc32"])

    return run


#: Most tasks that read files.
MOST_TASKS = 1 << 14


def read(manifest: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, crc32`` of each document, from the files: every frame's checksum is verified."""
    files = manifest.select("file", "start")
    return files.repartition(min(MOST_TASKS, max(1, files.count()))).mapInArrow(_reads(path), "id long, start long, n_tokens long, crc32 long").withColumnRenamed("id", id_col)
