"""The engine: tables, ingest and search behind one object."""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Settings
from .functions.vector import checked, score
from .operators.fusion import Ranked, fused
from .operators.ingest import Report, Store, compact, ingest, learn_languages
from .operators.models import Answerer, Embedder, HashingEmbedder, LexicalAnswerer, LogitsAnswerer, OnnxLogits, PipelineAnswerer, SentenceEmbedder
from .operators.retrieval import cosine, top_k
from .plans import search as plan
from .sources.documents import Extractor, default_extractor, list_documents
from .streaming.watch import watch, with_retries

#: Fixed values of the results' contract.
MOST_RESULTS = 10
#: What a search goes by.
MODES = ("vectors", "words", "both")
NO_CHUNKS = "No relevant chunks found."


def session(name: str = "folioscope") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _answerer(s: Settings) -> Answerer:
    """A local model if there is one: an ONNX file by its logits, else a pipeline."""
    if not s.answerer_path:
        return LexicalAnswerer()
    return LogitsAnswerer(OnnxLogits(s.answerer_path, s.device)) if os.path.exists(f"{s.answerer_path}/model.onnx") else PipelineAnswerer(s.answerer_path, s.device)


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings = Settings(), extractor: Extractor | None = None, embedder: Embedder | None = None, answerer: Answerer | None = None):
        self.spark, self.settings = spark, settings
        self.store = Store(spark, settings)
        self.extractor = extractor or default_extractor()
        self.embedder = embedder or (SentenceEmbedder(settings.embedder_path, settings.dimension, settings.device) if settings.embedder_path else HashingEmbedder(settings.dimension))
        self.answerer = answerer or _answerer(settings)
        if self.embedder.dimension != settings.dimension:
            raise ValueError(f"the embedder gives {self.embedder.dimension} dimensions, not {settings.dimension}")

    def init(self) -> Engine:
        self.store.create()
        return self

    def ingest(self, folder: str | None = None) -> Report:
        """Take in what is new in the folder, and what failed before, as one batch."""
        batch = f"batch-{uuid.uuid4().hex}"
        files = with_retries(list_documents(self.spark, folder or self.settings.documents).select("path"), self.store, batch)
        return ingest(files, self.store, self.extractor, self.embedder, batch)

    def compact(self) -> str | None:
        """Put the many small batches of a stream in one."""
        return compact(self.store)

    def learn_languages(self, docs: DataFrame, text_col: str = "text", code_col: str = "lang") -> None:
        """Learn from labelled texts which languages there are; what is taken in afterwards has a code."""
        learn_languages(self.store, docs, text_col, code_col)

    def watch(self, folder: str | None = None, once: bool = False):
        return watch(self.store, folder or self.settings.documents, self.extractor, self.embedder, once)

    def search(self, query: str, k: int = 3, mode: str = "vectors", department: str | None = None, language: str | None = None) -> DataFrame:
        """Result records, best answer first; an empty table if nothing is indexed. Lazy but for the ids of the hits.

        ``mode``: ``vectors``, ``words`` (BM25) or ``both`` (fused by ranks).
        ``department`` and ``language`` leave other chunks out, of a search by vectors.
        """
        if not query.strip():
            raise ValueError("query must not be blank")
        if k < 1:
            raise ValueError("k must be at least 1")
        wanted = {c: x for c, x in (("department", department), ("language_code", language)) if x is not None}
        if mode not in MODES or wanted and mode != "vectors":
            raise ValueError(f"mode is one of {', '.join(MODES)}; filters go with vectors")
        index, store = self.store.read("chunk_index"), self.store
        if mode == "vectors":
            best = self._nearest(query, k, wanted)
        else:
            words = Ranked(lambda n: store.words.scored(query, n, store.committed()), lambda: store.words.scored(query, None, store.committed()))
            if mode == "both":
                near = Ranked(lambda n: self._nearest(query, n).select(F.col("chunk_id").alias("id"), F.col("retrieval_score").alias("score")), lambda: self._scored(query))
                best = fused(self.spark, [near, words], k)
            else:
                best = words.best(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
            best = best.select(F.col("id").alias("chunk_id"), F.col("score").alias("retrieval_score"), "rank")
        return plan.search(index, best, query, self.answerer, self.settings.paragraph_words)

    def _nearest(self, query: str, k: int, wanted: dict[str, str] | None = None) -> DataFrame:
        """``chunk_id, retrieval_score, rank`` by the vector index if there is one, else by exact search."""
        vector = self.embedder.embed([query])[0].tolist()
        where = reduce(and_, [F.col(c) == x for c, x in wanted.items()]) if wanted else None
        if self.store.vectors.generation() is not None:
            return self.store.vectors.search(vector, k, where, self.store.committed())
        index = self.store.read("chunk_index")
        return top_k((index if where is None else index.where(where)).select("chunk_id", "embedding"), vector, k, ["chunk_id"])

    def _scored(self, query: str) -> DataFrame:
        """``id, score`` of all chunks, exactly."""
        vector = self.embedder.embed([query])[0].tolist()
        asked = F.array(*[F.lit(float(x)) for x in vector])
        return self.store.read("chunk_index").select(F.col("chunk_id").alias("id"), score(cosine(checked(F.col("embedding"), len(vector)), asked, True)).alias("score"))

    def search_json(self, query: str, k: int = 3, **how: str | None) -> str:
        """Results with the query as JSON; at most ``k`` rows reach the driver."""
        rows = [json.loads(r) for r in self.search(query, k, **how).toJSON().collect()]
        return json.dumps({"query": query, "results": rows} | ({} if rows else {"message": NO_CHUNKS}), ensure_ascii=False, indent=2)

    def api_search(self, query: str, top_k: int = 3) -> dict:
        """The API's response; checks the request as the API does."""
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query must have a character other than white space")
        if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= MOST_RESULTS:
            raise ValueError(f"top_k must be from 1 to {MOST_RESULTS}")
        rows = plan.api_results(self.search(query, top_k)).collect()
        return {"query": query, "results": [r.asDict() for r in rows]}
