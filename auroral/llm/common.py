"""What the operators share: the shared folder, bounded samples, blocks of documents."""

from __future__ import annotations

import ctypes
import math
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auroral.series import shared_folder


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders that this process has written and not discarded, in order.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")  # this query's shuffle files go with it
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN[:] = [w for w in _WRITTEN if w.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def written() -> tuple[str, ...]:
    """What materialise() has written and nobody has deleted: a caller that has its result may discard_written() what came between."""
    return tuple(_WRITTEN)


def discard_written(spark: SparkSession, keep: tuple[str, ...], result: DataFrame) -> None:
    """Delete what was written since ``keep`` = written(), except the files of ``result``."""
    own = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in result.inputFiles()}
    for folder in [w for w in _WRITTEN if w not in keep and w.rsplit("/", 1)[1] not in own]:
        _delete(spark, folder)


def give_back() -> None:
    """Returns the freed memory of this Python worker to the system. Workers are reused, so that one stage's peak would stay with the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` documents with their label, in one partition: those of least hash among ids where ``use`` holds, one row for each.

    Null ids and labels are left out; an id with several labels gets the largest, an id with several texts that of least hash (then the
    least text), so that the sample doesn't depend on how rows are dealt out. Only chosen ids (``max_rows`` at most) are broadcast.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & use)
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("x")).select("doc_id", "x.text", "x.label").coalesce(1)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, counted in one pass; a plan's estimated size may be off by any factor."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def block_count(docs: DataFrame, block_bytes: int = 7 << 20) -> int:
    """Blocks of about ``block_bytes`` of text; more input gives more blocks, not larger ones."""
    return max(8, math.ceil(text_bytes(docs) / block_bytes))


#: Keys that join_each() broadcasts, at most.
HEAVY = 1000


def join_each(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, whose rows have distinct values of ``key`` and say in ``__n`` how many of the ``total`` rows have it.

    Keys of more than a ``HEAVY``-th of all rows, fewer than ``HEAVY`` by that count, are broadcast; all others are merged.
    So no task gets all rows of a hot key.
    """
    hot = per_key.where(F.col("__n") > total // HEAVY).drop("__n")
    cold = per_key.where(F.col("__n") <= total // HEAVY).drop("__n")
    apart = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return apart.unionByName(others)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of an undirected graph given as long columns u, v; component is the least node.

    Alternating large-star and small-star rounds, each written to the shared folder; no node's
    neighbours are ever gathered in one task.
    """
    edges = materialise(edges.where(F.col("u") != F.col("v")).distinct(), name)
    before = None
    while True:
        total = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("__n"))
        large = join_each(both.where("v > u"), least, "u", total).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v").distinct()
        down = materialise(large, name)
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
        small = join_each(down, low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, name)
        state = after.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        discard(edges)
        discard(down)
        edges = after
        if before == state:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
