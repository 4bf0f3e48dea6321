"""Splits, completeness and basic reports."""

from __future__ import annotations

import functools
import operator
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auroral.series import Series


def temporal_split(df: DataFrame, time: str, split: object) -> tuple[DataFrame, DataFrame]:
    """Rows before ``split`` and from it on; both filters reach the scan. ValueError if there is no such column or no row."""
    if time not in df.columns:
        raise ValueError(f"no column {time!r}")
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        raise ValueError("no rows")
    at = F.lit(split).cast(df.schema[time].dataType)
    if not df.sparkSession.range(1).select(F.lit(low).cast(df.schema[time].dataType) <= at, at <= F.lit(high).cast(df.schema[time].dataType)).first() == (True, True):
        warnings.warn("the split is outside the times of the rows", stacklevel=2)
    return df.where(F.col(time) < at), df.where(F.col(time) >= at)


def split_by(df: DataFrame, column: str, **groups: list) -> dict[str, DataFrame]:
    """A filtered frame for each named list of values."""
    return {name: df.where(F.col(column).isin(values)) for name, values in groups.items()}


def _known(columns: list[str]) -> Column:
    return functools.reduce(operator.add, [F.col(f"`{c}`").isNotNull().cast("int") for c in columns])


def filter_by_completeness(df: DataFrame, min_percent: float = 70.0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of which at least this percentage of columns is known."""
    columns = [c for c in df.columns if c not in exclude]
    if not columns:
        warnings.warn("no columns to judge rows by", stacklevel=2)
        return df
    return df.where(100.0 * _known(columns) / len(columns) >= min_percent)


def missing_percent(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    columns = [c for c in df.columns if c not in exclude]
    return 100.0 - 100.0 * _known(columns) / len(columns)


def completeness_stats(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median and deviation of rows' missing percentages."""
    p = missing_percent(df, exclude)
    return df.select(p.alias("p")).agg(F.count("*").alias("n_rows"), F.avg("p").alias("mean_missing"), F.percentile("p", 0.5).alias("median_missing"), F.stddev_samp("p").alias("std_missing"))


def nan_batches(series: Series, n_batches: int = 10, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of missing percentages in batches of consecutive rows; the last takes the remainder."""
    n = F.count(F.lit(1)).over(series.whole)
    size = F.greatest(F.floor(n / n_batches), F.lit(1))
    marked = series.df.select(*series.keys, missing_percent(series.df, exclude).alias("p"))
    s = Series(marked, series.order_by, series.partition_by)
    batch = F.least(F.floor((s.row_number() - 1) / size), F.lit(n_batches - 1))
    return s.with_columns(batch=batch.cast("int")).df.groupBy(*series.partition_by, "batch").agg(
        F.count("*").alias("n_rows"), F.avg("p").alias("mean"), F.percentile("p", 0.5).alias("median"), F.max("p").alias("max"), F.min("p").alias("min"), F.stddev_samp("p").alias("std")
    )


def basic_stats(df: DataFrame, target: str, threshold: float = -50) -> DataFrame:
    """Rows, storm rows, rows with a null, and both as percentages, in one pass."""
    null = functools.reduce(operator.or_, [F.col(f"`{c}`").isNull() for c in df.columns])
    n = F.count("*")
    return df.agg(
        n.alias("n_rows"), F.count_if(F.col(target) <= threshold).alias("n_storm"), F.try_divide(100.0 * F.count_if(F.col(target) <= threshold), n).alias("storm_percent"),
        F.count_if(null).alias("n_with_null"), F.try_divide(100.0 * F.count_if(null), n).alias("null_percent"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def scale_check(df: DataFrame) -> DataFrame:
    """(column, max_abs, magnitude) of each numeric column."""
    columns = numeric_columns(df)
    tops = df.agg(*[F.max(F.abs(F.col(f"`{c}`").cast("double"))).alias(c) for c in columns])
    long = tops.unpivot([], columns, "column", "max_abs")
    return long.withColumn("magnitude", F.when(F.col("max_abs") > 0, F.floor(F.log10("max_abs"))).cast("int"))


def max_report(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.max(c).alias(f"max_{c}") for c in columns])


def outlier_report(df: DataFrame, column: str, max_value: float, target: str, threshold: float = -50) -> DataFrame:
    """How many rows have a sentinel, and how many of them are storm rows."""
    bad = F.col(column) >= max_value
    return df.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_outliers"), F.count_if(bad & (F.col(target) <= threshold)).alias("n_outliers_in_storms"))


def clean_column_name(name: str) -> str:
    """Separators become single underscores, brackets and commas go, no underscore at either end."""
    for a, b in ((" ", "_"), (",", ""), ("(", ""), (")", ""), ("/", "_"), (".", ""), ("^", ""), ("-", "_")):
        name = name.replace(a, b)
    while "__" in name:
        name = name.replace("__", "_")
    return name.strip("_")


def date_range(df: DataFrame, time: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows from ``first`` to ``last``, both included; an end that is None is open. Rows without a time go."""
    kept = F.col(time).isNotNull()
    if first is not None:
        kept = kept & (F.col(time) >= F.lit(first).cast(df.schema[time].dataType))
    if last is not None:
        kept = kept & (F.col(time) <= F.lit(last).cast(df.schema[time].dataType))
    return df.where(kept)


def row_slice(series: Series, start: int = 0, stop: int | None = None) -> Series:
    """Rows ``start`` up to but without ``stop`` of each series, counted from 0."""
    place = F.col("_place")
    kept = place >= start if stop is None else (place >= start) & (place < stop)
    numbered = series.with_columns(_place=series.row_number() - 1)
    return Series(numbered.df.where(kept).drop("_place"), series.order_by, series.partition_by)
