"""Readers for hourly observation files, phase tables and daily side tables; cleaning at the door."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auroral.operators.rolling import replace_outliers_with_mean
from auroral.series import Series

#: A measurement of at least this much is missing. Names are without dots, which Spark would read as field access.
SENTINELS: dict[str, float] = {
    "Scalar B, nT": 999, "Vector B Magnitude,nT": 999, "Lat Angle of B (GSE)": 999, "Long Angle of B (GSE)": 999,
    "BX, nT (GSE, GSM)": 999, "BY, nT (GSE)": 999, "BZ, nT (GSE)": 999, "BY, nT (GSM)": 999, "BZ, nT (GSM)": 999,
    "SW Plasma Temperature, K": 9999999, "SW Proton Density, N/cm^3": 999, "SW Plasma Speed, km/s": 9999,
    "SW Plasma flow long angle": 999, "SW Plasma flow lat angle": 999, "Alpha/Prot ratio": 9, "Flow pressure": 99.99,
    "E elecrtric field": 999, "Plasma Beta": 999, "Alfen mach number": 999, "Magnetosonic Much num": 99,
    "Quasy-Invariant": 9.9999, "Proton flux (>10 Mev)": 9999, "AE-index, nT": 9999,
}


def parse_sidecar(lines: list[str]) -> list[str]:
    """Column names of a format file: after the header, each line is a number, the name (which may hold spaces) and a format."""
    names = []
    for line in lines:
        line = line.strip()
        if " " in line and re.match(r"\d+\s", line):
            names.append(line[line.index(" ") : line.rindex(" ")].strip().replace(".", ""))
    return names


def timestamp_of(year: Column, doy: Column, hour: Column) -> Column:
    """From year, day of the year and hour; null where they name no hour."""
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lpad(doy.cast("string"), 3, "0"), F.lpad(hour.cast("string"), 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyyDDDHH")).cast("timestamp_ntz")


def with_time(df: DataFrame, name: str = "full_date") -> DataFrame:
    return df.withColumn(name, timestamp_of(F.col("YEAR").cast("int"), F.col("DOY").cast("int"), F.col("Hour").cast("int")))


def read_observations(spark: SparkSession, format_path: str, body_path: str, drop: tuple[str, ...] = (), add_time: bool = True) -> DataFrame:
    """A headerless body of fields between white space, named by its format file, numbers where they can be read as such."""
    names = parse_sidecar([r[0] for r in spark.read.text(format_path).collect()])  # a line for each column
    fields = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(body_path).where(F.trim("value") != "")
    kinds = {"YEAR": "int", "DOY": "int", "Hour": "int"}
    columns = [F.try_element_at(fields, F.lit(k + 1)).try_cast(kinds.get(n, "double")).alias(n) for k, n in enumerate(names) if n not in drop]
    out = rows.select(*columns)
    return with_time(out) if add_time and {"YEAR", "DOY", "Hour"} <= set(names) else out


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    """Phase intervals; an end date lasts until its last second."""
    schema = T.StructType([T.StructField("cycle_count", T.IntegerType()), T.StructField("phase", T.StringType()), T.StructField("start_date", T.DateType()), T.StructField("end_date", T.DateType())])
    raw = spark.read.csv(path, header=True, schema=schema)
    return raw.select("cycle_count", "phase", F.col("start_date").cast("timestamp_ntz").alias("start_date"), F.expr("cast(end_date as timestamp_ntz) + interval '23:59:59' hour to second").alias("end_date"))


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN in any floating-point column becomes null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def process(df: DataFrame, sentinels: dict[str, float] = SENTINELS, keep: list[str] | None = None, drop_missing: bool = False) -> DataFrame:
    """Sentinels become null in one projection onto ``keep``; with ``drop_missing`` rows with a null go."""
    names = [c for c in (keep or df.columns) if c in df.columns]
    out = df.select(*[F.when(F.col(f"`{c}`") < sentinels[c], F.col(f"`{c}`")).alias(c) if c in sentinels else F.col(f"`{c}`") for c in names])
    return out.na.drop() if drop_missing else out


def process_series(series: Series, sentinels: dict[str, float] = SENTINELS, keep: list[str] | None = None, half_width: int = 5, min_valid: int = 3) -> Series:
    """Sentinels become the mean of the valid values within ``half_width`` rows, null with fewer than ``min_valid``, all columns in one projection onto ``keep`` and the series' keys; rows with nulls stay."""
    names = [c for c in (keep or series.df.columns) if c in series.df.columns]
    held = [k for k in (*series.partition_by, *series.order_by) if k not in names]
    columns = [replace_outliers_with_mean(series, f"`{c}`", sentinels[c], half_width, min_valid).alias(c) if c in sentinels else F.col(f"`{c}`") for c in names]
    return Series(series.df.select(*held, *columns), series.order_by, series.partition_by)


def phase_columns(time: Column, phases: list[tuple[int, str, object, object]], cap: object, missing_rate: float = 0.0, seed: int = 0, key: Column | None = None) -> tuple[Column, Column]:
    """(cycle, phase) of a time from a short interval table, as CASE chains: no join, and the last covering interval wins.

    The last interval is open-ended. A phase is told only if its interval ends, or the time is, before ``cap``; a share
    ``missing_rate`` of phases, chosen by the hash of ``key``, is left out.
    """
    cycle, phase = F.lit(None).cast("long"), F.lit(None).cast("string")
    for k, (number, name, start, end) in enumerate(phases):
        inside = (time >= F.lit(start)) if k == len(phases) - 1 else (time >= F.lit(start)) & (time <= F.lit(end))
        cycle = F.when(inside, F.lit(number).cast("long")).otherwise(cycle)
        phase = F.when(inside & ((F.lit(end) <= F.lit(cap)) | (time < F.lit(cap))), F.lit(name)).otherwise(phase)
    if missing_rate and key is not None:
        phase = F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) >= int(missing_rate * 1_000_000), phase)
    return cycle, phase


def join_daily(rows: DataFrame, daily: DataFrame, time: str, day: str, columns: list[str] | None = None, complete: bool = False) -> DataFrame:
    """Left join of each row with its day's row; Spark broadcasts the side table if it finds it small.

    With ``complete`` rows that are left without any of the columns' values are an error (a job counts them).
    """
    names = columns or [c for c in daily.columns if c != day]
    side = daily.select(F.col(day).alias("_day"), *names)
    out = rows.join(side, F.to_date(time) == F.col("_day"), "left").drop("_day")
    if complete:
        missing = out.where(F.greatest(*[F.col(f"`{c}`").isNull() for c in names], F.lit(False))).count()
        if missing:
            raise ValueError(f"{missing} rows lack daily values")
    return out
