"""Ingest of a batch of files: registry, pages, chunks, vectors, in bulk and idempotent.

Each table is a folder of Parquet with one partition for each batch; a batch
that runs again replaces its own partitions. The ``books`` partition is written
last, and only batches that have one are read, so a batch that stops half-way
leaves nothing that a search could see.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions import text as t
from ..functions.language import Profiles, language, learned
from ..functions.vector import checked
from ..plans import schemas
from ..sources.documents import Extractor, extract_pages, load, named, root_of
from .chunking import clean_pages, new_files, page_chunks, with_running
from .lexical import LexicalIndex
from .models import Embedder, embedded
from .vector_index import VectorIndex

TABLES = {"books": schemas.BOOKS, "chunks": schemas.CHUNKS, "chunk_index": schemas.CHUNK_INDEX, "ingest_errors": schemas.ERRORS, "replaced": schemas.REPLACED}


@dataclass
class Store:
    """The engine's tables under ``settings.home``."""

    spark: SparkSession
    settings: Settings

    def path(self, name: str) -> str:
        return self.settings.table(name)

    @property
    def vectors(self) -> VectorIndex:
        return VectorIndex(self.spark, self.path("vector_index"))

    @property
    def languages(self) -> Profiles:
        """Profiles that were learned (:func:`learn_languages`); none at first."""
        path = self.path("_languages")
        return Profiles.of_rows(self.spark.read.parquet(path).collect() if self._exists(path) else [])

    @property
    def words(self) -> LexicalIndex:
        return LexicalIndex(self.spark, self.path("word_index"))

    def committed(self) -> DataFrame:
        """The batches that searches may see: those with a registry, but for those that a compact one of them replaces."""
        books = self.all("books").select("batch").distinct()
        gone = self.all("replaced").join(books, "batch", "left_semi").select(F.col("old").alias("batch"))
        return books.join(gone, "batch", "left_anti")

    def create(self) -> None:
        """Empty tables where there are none, and the dimension of the vectors, which cannot change afterwards."""
        for name, schema in TABLES.items():
            if not self._exists(self.path(name)):
                self.put(name, "empty", self.spark.createDataFrame([], schema))
        if not self._exists(self.words.path):
            self.words.append(self.spark.createDataFrame([], schemas.CHUNK_INDEX), "empty", "chunk_id")
        meta = self.path("_dimension")
        if not self._exists(meta):
            self.spark.range(1).select(F.lit(self.settings.dimension).alias("dimension")).write.mode("overwrite").parquet(meta)
        found = self.spark.read.parquet(meta).first()["dimension"]
        if found != self.settings.dimension:
            raise ValueError(f"the index holds vectors of {found} dimensions, not {self.settings.dimension}")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def put(self, name: str, batch: str, df: DataFrame) -> None:
        schema = TABLES[name]
        df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("overwrite").parquet(f"{self.path(name)}/batch={batch}")

    def all(self, name: str) -> DataFrame:
        """All rows with their ``batch``, committed or not."""
        return self.spark.read.schema(T.StructType([*TABLES[name].fields, T.StructField("batch", T.StringType())])).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        """Rows of committed batches; the filter prunes partitions."""
        rows = self.all(name)
        if name in ("books", "chunks", "chunk_index"):
            rows = rows.join(self.committed(), "batch", "left_semi")
        return rows.drop("batch")

    def name(self, path: Column) -> Column:
        """A file's name in the tables, for its path."""
        return named(path, root_of(self.spark, self.settings.documents), self.settings.served_as)

    def highest(self, name: str, column: str, batch: str) -> int:
        return self.all(name).where(F.col("batch") != batch).agg(F.max(column)).first()[0] or 0


@dataclass(frozen=True)
class Report:
    books: int
    chunks: int
    failed: int


def new_of(paths: DataFrame, store: Store, batch: str) -> DataFrame:
    """Of ``paths (path)`` with their ``name`` those that the registry does not hold and that did not fail too often."""
    known = store.all("books").where(F.col("batch") != batch)
    given_up = store.all("ingest_errors").where((F.col("batch") != batch) & (F.col("attempt") >= store.settings.max_attempts))
    rows = paths.select("path").distinct().withColumn("name", store.name(F.col("path")))
    return new_files(new_files(rows, known, "name"), given_up, "name")


#: Files whose contents are read in one job.
FILES = 1 << 13


def _extracted(paths: DataFrame, store: Store, extractor: Extractor, staging: str) -> None:
    """Pages of the files, written group by group: contents are read for these files alone and never exchanged."""

    def put(some: list[str], mode: str) -> None:
        pages = extract_pages(load(store.spark, some), extractor)
        pages.withColumn("path", store.name(F.col("path"))).write.mode(mode).parquet(staging)

    group: list[str] = []
    mode = "overwrite"
    for r in paths.select("path").toLocalIterator():
        group.append(r["path"])
        if len(group) == FILES:
            put(group, mode)
            group, mode = [], "append"
    if group or mode == "overwrite":
        put(group, mode) if group else store.spark.createDataFrame([], "path string, page_number int, text string, error string").write.mode(mode).parquet(staging)


def learn_languages(store: Store, docs: DataFrame, text_col: str = "text", code_col: str = "lang") -> None:
    """Learn the languages that ingest tells apart from labelled texts; chunks taken in from now on have a code."""
    rows = learned(docs, text_col, code_col).as_rows()
    store.spark.createDataFrame(rows, "code string, weights array<long>").coalesce(1).write.mode("overwrite").parquet(store.path("_languages"))


#: The vectors are indexed anew when there are so many times the rows of the last time.
GROWTH = 4


def refit(store: Store) -> None:
    """Fit the vector index on all committed rows, if there are enough now or many more than before."""
    s = store.settings
    if not s.index_from:
        return
    book = store.vectors.codebook()
    n = store.words.rows(store.committed())
    if n >= (GROWTH * book.rows if book else s.index_from):
        store.vectors.fit(store.all("chunk_index").join(store.committed(), "batch", "left_semi"))


#: What a file's name suggests, and a catalogue may know.
ATTRIBUTES = ("title", "author", "publication_year", "department")


def numbered_books(judged: DataFrame, books: int, chunks: int, path: str) -> DataFrame:
    """Registry rows of ``judged (path, n_chunks)``: ids behind ``books`` in the order of paths, attributes by the file's name, and ``first``, the number of chunks before.

    Attributes that ``judged`` has as columns are known and taken as they are: a name only
    suggests them, and a number in it may look like a year. ``path`` is a folder for the
    ranges that are numbered (:func:`chunking.with_running`).
    """
    known = [c for c in ATTRIBUTES if c in judged.columns]
    good = with_running(judged.select("path", "n_chunks", *known), "path", {"books": F.lit(1), "first": F.col("n_chunks")}, path)
    good = good.withColumns({"id": F.col("books") + 1 + F.lit(books), "first": F.col("first") + F.lit(chunks)})
    attributes = [F.col(c) if c in known else F.col(f"meta.{c}").alias(c) for c in ATTRIBUTES]
    return good.withColumn("meta", t.file_metadata(F.col("path"))).select("id", *attributes, F.col("path").alias("file_path"), "first")


def book_chunks(cut: DataFrame, books: DataFrame, book_col: str = "path") -> DataFrame:
    """Chunks with their book's attributes, their ids over all books, and the names of their documents."""
    own = books.select(F.col("id").alias("book_id"), "title", "author", "department", "file_path", "first")
    rows = cut.join(own, cut[book_col] == own["file_path"])
    doc_id = t.document_id(F.col("book_id"), F.col("chunk_index"))
    return rows.select("book_id", "title", "author", "department", "file_path", "page_number", "chunk_index", "chunk_text", (F.col("first") + F.col("chunk_index") + 1).alias("id"), doc_id.alias("doc_id"))


def ingest(files: DataFrame, store: Store, extractor: Extractor, embedder: Embedder, batch: str, batch_number: int | None = None) -> Report:
    """Take the new ones of ``files (path)`` in; what fails goes to ``ingest_errors``."""
    s, spark = store.settings, store.spark
    staging = f"{store.path('_staging')}/batch={batch}"
    _extracted(new_of(files, store, batch), store, extractor, staging)
    pages = spark.read.parquet(staging)
    clean = clean_pages(pages.where("error is null and page_number is not null"))
    cut = page_chunks(clean, s.chunk_size, s.chunk_overlap)

    sizes = cut.groupBy("path").agg(F.count("*").alias("n_chunks"))
    seen = pages.groupBy("path").agg(F.max("error").alias("error"))
    judged = seen.join(sizes, "path", "left")
    earlier = store.all("ingest_errors").where(F.col("batch") != batch).groupBy(F.col("file_path").alias("path")).agg(F.max("attempt").alias("before"))
    failed = judged.where("n_chunks is null").join(earlier, "path", "left")
    store.put("ingest_errors", batch, failed.select(F.col("path").alias("file_path"), F.coalesce("error", F.lit("no text")).alias("message"), (F.coalesce("before", F.lit(0)) + 1).alias("attempt"), F.lit(batch_number).alias("batch_id"), F.current_timestamp().alias("failed_at")))

    good = judged.where("n_chunks is not null")
    books = numbered_books(good, store.highest("books", "id", batch), store.highest("chunks", "id", batch), f"{staging}-books")
    rows = book_chunks(cut, books).withColumn("language_code", language(F.col("chunk_text"), store.languages))
    index = embedded(rows.withColumnRenamed("chunk_text", "text"), embedder).withColumn("embedding", checked(F.col("embedding"), s.dimension))
    store.put("chunk_index", batch, index.withColumnRenamed("id", "chunk_id"))
    store.put("chunks", batch, rows.select("*", F.col("doc_id").alias("es_doc_id"), F.current_timestamp().alias("created_at")))
    # A book's language is that of most of its chunks.
    said = store.all("chunks").where((F.col("batch") == batch) & F.col("language_code").isNotNull()).groupBy("book_id", "language_code").agg(F.count("*").alias("n"))
    codes = said.groupBy(F.col("book_id").alias("id")).agg(F.min_by("language_code", F.struct(-F.col("n"), "language_code")).alias("language_code"))
    books = books.join(codes, "id", "left").withColumn("created_at", F.current_timestamp())
    of = lambda name: store.all(name).where(F.col("batch") == batch).count()
    n_chunks, n_index = of("chunks"), of("chunk_index")
    if n_chunks != n_index:
        raise RuntimeError(f"{n_index} of {n_chunks} chunks were indexed")
    own_index = store.all("chunk_index").where(F.col("batch") == batch)
    store.words.append(own_index, batch, "chunk_id")
    store.vectors.append(own_index, batch)
    store.put("books", batch, books)
    refit(store)
    for path in (staging, f"{staging}-books"):
        store.delete(path)
    return Report(of("books"), n_chunks, of("ingest_errors"))


def compact(store: Store) -> str | None:
    """Put all committed batches in one, with files of full size; None if there are fewer than two.

    The registry of the new batch is written last: from then on it counts, and
    those that it replaces do not. Their files stay until the next time, for
    searches that are running.
    """
    old = [r["batch"] for r in store.committed().collect()]
    if len(old) < 2:
        return None
    earlier = [r["old"] for r in store.all("replaced").select("old").distinct().collect()]
    new = f"compact-{uuid.uuid4().hex}"
    for name in ("chunks", "chunk_index"):
        store.put(name, new, store.read(name).hint("rebalance"))
    rows = store.all("chunk_index").where(F.col("batch") == new)
    store.words.append(rows, new, "chunk_id")
    store.vectors.append(rows, new)
    store.put("replaced", new, store.spark.createDataFrame([(b,) for b in old], schemas.REPLACED))
    store.put("books", new, store.read("books").hint("rebalance"))
    g = store.vectors.generation()
    for batch in earlier:
        for at in (*[store.path(name) for name in ("chunks", "chunk_index", "books")], f"{store.words.path}/postings", f"{store.words.path}/stats", *([f"{store.vectors.path}/{x}/generation={g}" for x in ("entries", "counts")] if g else [])):
            store.delete(f"{at}/batch={batch}")
    return new
