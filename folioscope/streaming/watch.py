"""Watching a folder with Structured Streaming: each file once, failures set aside and tried again at every poll."""

from __future__ import annotations

import logging
import threading
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import Store, ingest
from ..operators.models import Embedder
from ..plans.schemas import FILES
from ..sources.documents import GLOB, Extractor, load, root_of, unnamed

_LOG = logging.getLogger(__name__)

#: Most failed files that are tried again at once; the others follow at the next poll.
MOST_RETRIES = 1 << 13


def to_retry(store: Store, batch: str) -> list[str]:
    """Paths that failed fewer times than allowed and are not in the registry, those with the fewest attempts first."""
    errors = store.all("ingest_errors").where(F.col("batch") != batch).groupBy("file_path").agg(F.max("attempt").alias("attempt"))
    open_ = errors.where(F.col("attempt") < store.settings.max_attempts).join(store.all("books").select("file_path"), "file_path", "left_anti")
    root = root_of(store.spark, store.settings.documents)
    return [unnamed(r["file_path"], root, store.settings.served_as) for r in open_.orderBy("attempt", "file_path").limit(MOST_RETRIES).collect()]


def with_retries(files: DataFrame, store: Store, batch: str) -> DataFrame:
    """The paths of ``files`` and of those that failed before."""
    paths = to_retry(store, batch)
    again = store.spark.createDataFrame([(p,) for p in paths], "path string")
    return files.select("path").union(again)


class Watch:
    """A running watch: new files come by the query, failed ones are tried again at every poll, new files or not."""

    def __init__(self, store: Store, folder: str, extractor: Extractor, embedder: Embedder, once: bool):
        self.store, self.extractor, self.embedder, self.once = store, extractor, embedder, once
        self.lock, self.stopped, self.batches = threading.Lock(), threading.Event(), 0
        stream = store.spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", GLOB).load(folder).select("path")
        writer = stream.writeStream.foreachBatch(self._take).option("checkpointLocation", store.path("_checkpoint"))
        poll = {"availableNow": True} if once else {"processingTime": f"{store.settings.poll_seconds} seconds"}
        self.query: StreamingQuery = writer.trigger(**poll).start()
        if not once:
            threading.Thread(target=self._poll, daemon=True).start()

    def _take(self, files: DataFrame, number: int) -> None:
        batch = f"stream-{number}"
        with self.lock:
            self.batches += 1
            ingest(with_retries(files, self.store, batch), self.store, self.extractor, self.embedder, batch, number)

    def retry(self) -> None:
        """Try failed files again, if there are any."""
        with self.lock:
            paths = to_retry(self.store, "")
            there = load(self.store.spark, paths).select("path") if paths else None
            if there is not None and not there.isEmpty():
                ingest(there, self.store, self.extractor, self.embedder, f"retry-{uuid.uuid4().hex}")

    def _poll(self) -> None:
        while not self.stopped.wait(self.store.settings.poll_seconds) and self.query.isActive:
            try:
                self.retry()
            except Exception:  # one poll that fails must not end the others
                _LOG.warning("a poll for failed files did not succeed and is tried again", exc_info=True)

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        done = self.query.awaitTermination(timeout)
        if self.once and not self.query.isActive and not self.batches:
            # No new file, so no batch: what failed before is tried all the same.
            self.retry()
        return done

    def stop(self) -> None:
        self.stopped.set()
        self.query.stop()

    @property
    def isActive(self) -> bool:
        return self.query.isActive


def watch(store: Store, folder: str, extractor: Extractor, embedder: Embedder, once: bool = False) -> Watch:
    """Take in new files of ``folder``, now (``once``) or at every poll.

    A path counts once, also when its file is written anew. The checkpoint
    remembers files, the registry their names; a batch that runs again replaces
    what it wrote.
    """
    return Watch(store, folder, extractor, embedder, once)
