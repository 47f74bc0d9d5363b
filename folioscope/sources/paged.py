"""Document files as a data source of their own: ``spark.read.format("paged_documents").load(folder)``, and ``readStream`` alike.

Tasks list the folder themselves, each for the files that a hash of their name
gives it, and read contents there. No list of paths passes the driver, which
only asks for the latest time of change when a stream looks for new files.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .documents import Extractor, PlainExtractor, SimplePdfExtractor, default_extractor, pages_of

SUFFIX = ".pdf"
#: Tasks of a read, and seconds that a file must be unchanged before a stream takes it.
PARTS, SETTLED = 32, 1.0
_EXTRACTORS = {"default": default_extractor, "plain": PlainExtractor, "simple": SimplePdfExtractor}


@dataclass
class Some(InputPartition):
    """The files of one hash value that changed after one time and until another."""

    number: int
    after: int
    until: int


class Folder:
    """A folder as tasks see it: a local (shared) one, or what pyarrow can open."""

    def __init__(self, folder: str):
        at = urlparse(folder)
        self.local = at.scheme in ("", "file")
        if self.local:
            self.root = os.path.abspath(at.path)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)
            self.front = folder.rstrip("/")

    def files(self) -> Iterator[tuple[str, str, int]]:
        """(path as Spark's file source spells it, place, time of change) of the documents in the folder itself."""
        if self.local:
            if os.path.isdir(self.root):
                with os.scandir(self.root) as found:
                    for f in found:
                        if f.name.lower().endswith(SUFFIX) and f.is_file():
                            yield f"file:{f.path}", f.path, f.stat().st_mtime_ns
            return
        from pyarrow import fs

        for f in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True)):
            if f.type == fs.FileType.File and f.base_name.lower().endswith(SUFFIX):
                yield f"{self.front}/{f.base_name}", f.path, f.mtime_ns or 0

    def read(self, place: str) -> bytes:
        with open(place, "rb") if self.local else self.fs.open_input_file(place) as f:
            return f.read()


class _Reads:
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("a folder must be given")
        self.folder, self.parts = options["path"], int(options.get("parts", PARTS))
        self.settled = float(options.get("settled", SETTLED))
        name = options.get("extractor", "default")
        if name not in _EXTRACTORS or self.parts < 1:
            raise ValueError(f"extractor is one of {', '.join(_EXTRACTORS)}; parts is at least 1")
        self.extractor = name

    def _between(self, after: int, until: int) -> list[Some]:
        return [Some(n, after, until) for n in range(self.parts)]

    def read(self, partition: Some) -> Iterator[tuple]:
        extractor: Extractor = _EXTRACTORS[self.extractor]()
        folder = Folder(self.folder)
        for path, place, changed in folder.files():
            if partition.after < changed <= partition.until and zlib.crc32(os.path.basename(place).encode()) % self.parts == partition.number:
                try:
                    content = folder.read(place)
                except FileNotFoundError:  # gone since it was listed
                    continue
                yield from pages_of(path, content, extractor)


class _Reader(_Reads, DataSourceReader):
    def partitions(self) -> list[Some]:
        return self._between(-1, 1 << 62)


class _StreamReader(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        """The latest change that is old enough, so that files of one moment come together."""
        now = time.time_ns() - int(self.settled * 1e9)
        return {"until": max((t for _, _, t in Folder(self.folder).files() if t <= now), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Some]:
        return self._between(start["until"], end["until"]) if end["until"] > start["until"] else []

    def commit(self, end: dict) -> None:
        pass


class PagedDocuments(DataSource):
    """Rows ``path, page_number, text, error``, as :func:`documents.extract_pages` has them.

    Options: ``path``, ``parts`` (tasks), ``extractor`` (default, plain or simple),
    ``settled`` (seconds, streams alone). A stream takes files by the time they
    were changed: one that is put there with an older time than the last batch is not met.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def schema(self) -> str:
        return "path string, page_number int, text string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PagedDocuments)
    return spark
