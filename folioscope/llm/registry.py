"""The queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, minhash, packing, pieces, quality, quotes, resample, sharding, simhash, sql, sql_hashes, substring, tokenfiles, urls, whitening
from .neighbours import with_next


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file of the contract; it is on every machine, in the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the contract.
RULES = [urls.rule("com/", "allow"), urls.rule("example.com/en/", "block"), urls.rule("www.example.com/en/", "allow"), urls.rule("net/es/", "block"), urls.rule("net/fr/", "block")]


#: Columns of documents that the classifier reads beside the text.
METADATA = ["n_chars"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = minhash.with_fingerprint(docs, name="fp")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next.text", F.lit(1), half))
    both = minhash.with_fingerprint(with_next(own, "doc_id", ["text"]).withColumn("edited", edited), "edited", "edited_fp")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        minhash.as_string(F.col("fp")).alias("fingerprint"),
        minhash.as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        minhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        minhash.likeness(F.col("fp"), F.col("next.fp")).alias("near_next"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, path = tokenfiles.write(table(spark, sf_dir, "documents"), vocabulary(), special=True)
    return tokenfiles.read(manifest, path).withColumnRenamed("crc32", "ids_crc32")


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.reply_ordered(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "position", "turn", "role", "body", "parent_turn", "root_turn", "depth", "n_quoted", "n_linked")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", *METADATA), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out()), metadata=METADATA)
    return quality.score(docs, model, metadata=METADATA, keep_text=False).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = sharding.shuffled(docs, docs.columns, 16)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As many segments as tokens: the contract has a limit of tokens alone.
    out = packing.packed(table(spark, sf_dir, "documents"), vocabulary(), limits=packing.Limits(segments=2048), cuts=True, special=True)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    out = pieces.decoded(pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model, keep_text=False), model)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_minhash, op3_token_files, op4_quotation_linking, op5_substring_dedup, op6_simhash, op7_quality, op8_sharding, op9_decontaminate, op10_packing, op11_resampling, op12_sentencepiece, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": sql.OP1, "op2_minhash": sql_hashes.minhash(), "op6_simhash": sql_hashes.simhash(), "op4_quotation_linking": sql.OP4, "op5_substring_dedup": sql.OP5, "op9_decontaminate": sql.OP9, "op11_resampling": sql_hashes.resampling()}
