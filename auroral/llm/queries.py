"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bytepairs, chat, decontaminate, fingerprint, langid, lm, near, pieces, quality, repeats, toxicity, vectorcodes
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, read in a session whose batches to Python are bounded by bytes and not only by rows: rows may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1)
    scored = quality.score(docs, weights)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.similarity_classes(table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexity(lm.score(table(spark, sf_dir, "documents"), order=2, min_count=2))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents"), window=20))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_hostile_conversation(table(spark, sf_dir, "conversations"))))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs, fold("doc_id", 3) != 1))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2)
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.round_trip_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality, op2_jaccard_join, op3_lm_score, op4_substring_dedup, op5_sentencepiece, op6_simhash, op7_decontamination, op8_language_id, op9_chat_formatting, op10_toxicity, op11_byte_bpe, op12_alignment, op13_vector_codes]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": near.ORACLE_SQL, "op3_lm_score": lm.ORACLE_SQL, "op4_substring_dedup": repeats.ORACLE_SQL, "op7_decontamination": decontaminate.ORACLE_SQL, "op9_chat_formatting": chat.ORACLE_SQL, "op13_vector_codes": vectorcodes.oracle_sql()}
