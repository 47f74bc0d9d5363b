"""From raw documents to packed sequences: each stage keeps the columns of documents, the last returns pieces.

A stage takes a table with at least ``COLUMNS`` and returns these alone; other
columns end at the first stage, and one that is missing is an error of the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, packing, quality, registry, simhash, substring
from folioscope.llm.common import new_path, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.train(docs, registry.table(spark, sf_dir, "labels").where(~quality.held_out()), metadata=registry.METADATA)
    return quality.score(docs, model, metadata=registry.METADATA).where("predicted = 1").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their 5-word shingles in common) stays, the one with the least id."""
    return simhash.representatives(docs, shingle=5, similarity=0.8).select(COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; a document of which no word is left goes."""
    out = substring.substring_dedup(docs)
    return out.where("n_removed = 0 or n_removed < n_words").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; a document of which no word is left goes."""
    out = decontaminate.search(docs, registry.table(spark, sf_dir, "benchmark"), remove=True)
    return out.where("n_hit = 0 or n_hit < n_words").withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. Workers have other stages before and behind, so they remember fewer parts."""
    return packing.packed(docs, registry.vocabulary(), limits=packing.Limits(segments=2048), cuts=True, known=100_000, special=True).withColumnRenamed("crc32", "ids_crc32")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier, the fingerprints' hash and the tokenizer are not SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's table goes when the next one is written."""
    docs, last = registry.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    # Packing has written all its pieces when it returns.
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, last)
    return out
