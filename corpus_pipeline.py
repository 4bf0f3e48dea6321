"""A training-data pipeline over the documents table.

STAGES are applied in order; each takes (spark, docs, sf_dir) and works on all rows
that the stage before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auroral.llm import decontaminate, near, pieces, quality, repeats
from auroral.llm.common import discard, discard_written, materialise, written
from auroral.llm.queries import table, tokenizer_path

#: Documents of a lower quality score go.
MIN_QUALITY = 0.5


def plain(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The rows with columns doc_id, text and the others under names of our own, whatever they are called; and these names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = tuple(f"column{k}" for k in range(len(others)))
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)]), names


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of plain() with the columns of ``docs`` again; n_chars counts the text as it is."""
    others = iter(f"column{k}" for k in range(len(docs.columns)))
    columns = [F.col(c) if c in ("doc_id", "text") else F.col(next(others)).alias(c) for c in docs.columns]
    out = rows.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    rows, names = plain(docs)
    weights = quality.train(rows, table(spark, sf_dir, "labels"), "quality", F.lit(True))
    kept = quality.score(rows, weights, extra=("text", *names)).where(F.col("score") >= MIN_QUALITY)
    return named(kept, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each similarity class: the one of least id (null ids come last), among equal ids that of least hash. Nothing else goes.

    Ids may be null or repeated, so rows are compared under a number of their own, written with them so that it stays the same.
    """
    rows, names = plain(docs)
    rows = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "pipeline-rows")
    classes = near.similarity_classes(rows.select(F.col("number").alias("doc_id"), "text")).select(F.col("doc_id").alias("number"), "class_id")
    order = rows.select("number", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("doc_id", "text", *names), "number").alias("order"))
    kept = order.join(classes.hint("merge"), "number").groupBy("class_id").agg(F.min("order").alias("order")).select("order.number")
    return named(rows.join(kept.hint("merge"), "number", "left_semi"), docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of 20-word windows that begin earlier; a document of which nothing is left goes. Others keep their text as it is."""
    rows, names = plain(docs)
    out = repeats.remove_repeats(rows, window=20, extra=names, layout=True).where("n_removed = 0 or kept <> ''")
    return named(out.withColumnRenamed("kept", "text"), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes spans that benchmark items cover; documents that they cover by more than four fifths go."""
    rows, names = plain(docs)
    clean = decontaminate.scan_and_remove(rows, table(spark, sf_dir, "benchmark"), window=10, min_words=1, max_coverage=0.8, extra=names)
    return named(clean, docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) with an end id."""
    return pieces.encode(docs, tokenizer_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read again; what a stage wrote besides goes with it, and each result once the next is there."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, keep = docs, written()
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{k}")
        discard_written(spark, keep, docs)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The trained classifier and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None
