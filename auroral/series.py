"""Ordered, optionally partitioned series: the one place where window specifications are made."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """Rows of ``df`` in the order of ``order_by`` within each ``partition_by``.

    ``order_by`` should be a unique key of a partition; ties leave the order of their rows to Spark.
    Without ``partition_by`` the rows are one series, which one task orders; see chunked() for long ones.
    """

    df: DataFrame
    order_by: tuple[str, ...]
    partition_by: tuple[str, ...] = ()

    @property
    def window(self) -> WindowSpec:
        keys = self.partition_by or (F.lit(1),)
        return Window.partitionBy(*keys).orderBy(*self.order_by)

    def last(self, rows: int) -> WindowSpec:
        """This row and those before it, ``rows`` in all."""
        return self.window.rowsBetween(-(rows - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def after(self) -> WindowSpec:
        return self.window.rowsBetween(1, Window.unboundedFollowing)

    @property
    def from_here(self) -> WindowSpec:
        return self.window.rowsBetween(0, Window.unboundedFollowing)

    @property
    def whole(self) -> WindowSpec:
        keys = self.partition_by or (F.lit(1),)
        return Window.partitionBy(*keys)

    def row_number(self) -> Column:
        return F.row_number().over(self.window)

    def with_columns(self, **columns: Column) -> Series:
        return replace(self, df=self.df.withColumns(columns))

    def drop(self, *names: str) -> Series:
        return replace(self, df=self.df.drop(*names))

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.partition_by, *self.order_by)


def clean(column: str | Column) -> Column:
    """NaN and infinities become null: null alone stands for missing."""
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the one the context has. Where neither is set, a local session gets a temporary one and a cluster an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="auroral-"))
        held = context._jsc.sc().getCheckpointDir()
    return (folder or held.get()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def chunked(series: Series, rows: int, halo: int) -> Series:
    """A long series cut into overlapping chunks, so that bounded causal frames can be computed chunk by chunk.

    Rows get a number in the order (a range sort that is written down, then counts per task; no task sees all rows), a chunk of ``rows``
    rows, and each chunk also gets the ``halo`` rows before it, flagged ``is_halo``. Compute, then drop_halo().
    """
    keys = [F.col(c) for c in series.order_by]
    # written down, so that the counts and the rows below see the same tasks whatever is computed again
    spread = checkpointed(series.df.repartitionByRange(*keys).withColumn("_task", F.spark_partition_id()))
    local = Window.partitionBy(*series.partition_by, "_task").orderBy(*series.order_by)
    counts = spread.groupBy(*series.partition_by, "_task").agg(F.count("*").alias("_n"))
    offsets = counts.select(*series.partition_by, F.col("_task").alias("_t"), (F.sum("_n").over(Window.partitionBy(*(series.partition_by or [F.lit(1)])).orderBy("_task")) - F.col("_n")).alias("_off"))
    on = F.col("_task") == F.col("_t")
    other = offsets
    for c in series.partition_by:
        other = other.withColumnRenamed(c, f"_p_{c}")
        on = on & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    numbered = spread.join(other, on).withColumn("row_no", F.row_number().over(local) + F.col("_off") - 1).select(*series.df.columns, "row_no")
    own = F.floor(F.col("row_no") / rows)
    last = F.floor((F.col("row_no") + halo) / rows)
    dealt = numbered.withColumn("chunk", F.explode(F.sequence(own, last))).withColumn("is_halo", F.col("chunk") != own)
    return Series(dealt, series.order_by, (*series.partition_by, "chunk"))


def drop_halo(series: Series) -> DataFrame:
    return series.df.where("not is_halo").drop("is_halo", "chunk", "row_no")
