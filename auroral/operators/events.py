"""Runs, labels, categories and rank-based severity."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auroral.scan import framed
from auroral.series import Series

#: The standard storm categories, ascending.
STORM_CATEGORIES: dict[str, float] = {"severe_storm": -200, "intense_storm": -100, "moderate_storm": -50, "quiet": 0, "very_quiet": 50}


def storm_flag(column: str | Column, threshold: float = -50) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c <= threshold, F.lit(False)).cast("int")


def storm_duration(series: Series, column: str, threshold: float = -50, name: str = "storm_duration") -> Series:
    """How many rows right after this one are storm rows."""
    numbered = series.with_columns(_rn=series.row_number())
    calm = F.when(storm_flag(column, threshold) == 0, F.col("_rn"))
    end = F.coalesce(F.first(calm, True).over(numbered.after), F.count(F.lit(1)).over(series.whole) + 1)
    return numbered.with_columns(**{name: (end - F.col("_rn") - 1).cast("int")}).drop("_rn")


def runs(series: Series, flag: Column) -> Series:
    """``_flag`` and ``_run``: a number for each stretch of equal flags in a partition."""
    marked = series.with_columns(_flag=flag)
    change = (F.col("_flag") != F.lag("_flag").over(marked.window)).cast("int")
    stepped = marked.with_columns(_change=F.coalesce(change, F.lit(1)))
    return stepped.with_columns(_run=F.sum("_change").over(stepped.so_far)).drop("_change")


def storm_mask(series: Series, column: str, threshold: float = -50, min_duration: int = 1, name: str = "storm_mask") -> Series:
    """Rows of storm runs of at least ``min_duration`` rows."""
    marked = runs(series, storm_flag(column, threshold))
    length = F.count(F.lit(1)).over(Window.partitionBy(*(series.partition_by or [F.lit(1)]), "_run"))
    return marked.with_columns(**{name: (F.col("_flag") == 1) & (length >= min_duration)}).drop("_flag", "_run")


def entities(series: Series, label: str) -> DataFrame:
    """(partition, start, end): runs of label 1 by row number from 0, both ends included."""
    numbered = series.with_columns(_rn=series.row_number() - 1)
    marked = runs(numbered, F.coalesce(F.col(label) == 1, F.lit(False)).cast("int"))
    return marked.df.where("_flag = 1").groupBy(*series.partition_by, "_run").agg(F.min("_rn").alias("start"), F.max("_rn").alias("end")).drop("_run")


def categorise(column: str, thresholds: dict[str, float] = STORM_CATEGORIES) -> Column:
    """The first category whose threshold is not exceeded, the last one above all; null stays. ValueError unless ascending."""
    names, limits = list(thresholds), list(thresholds.values())
    if any(a >= b for a, b in zip(limits[:-1], limits[1:], strict=True)):
        raise ValueError("thresholds must ascend")
    out = F.when(F.col(column).isNull(), F.lit(None).cast("string"))
    for name, limit in thresholds.items():
        out = out.when(F.col(column) <= limit, name)
    return out.otherwise(names[-1])


def category_rank(column: Column, thresholds: dict[str, float] = STORM_CATEGORIES) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in thresholds]), column).cast("int")


def storm_classes(column: str, thresholds: tuple[float, ...] = (-200, -100, -50, -30, 0)) -> Column:
    """Bin number less 1, at least 0: both bins below the second threshold are class 0; missing values are the highest class."""
    out = F.when(F.col(column).isNull(), len(thresholds) - 1)
    for k, limit in enumerate(thresholds):
        out = out.when(F.col(column) < limit, max(k - 1, 0))
    return out.otherwise(len(thresholds) - 1).cast("int")


def category_distribution(df: DataFrame, category: str) -> DataFrame:
    """(category, n, percent, cumulative percent), most frequent first, null as a category of its own."""
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), F.col(category).asc_nulls_last())  # a row for each category
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select(category, "n", (100.0 * F.col("n") / total).alias("percent"), (100.0 * F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cumulative_percent"))


def _rolling_ranks(x: np.ndarray, before: int, after: int, min_valid: int) -> np.ndarray:
    """For each value the share of its frame that is not above it, from a sorted block of the frame that each row enters and leaves once."""
    held: list[float] = []
    values, n = x.tolist(), len(x)
    out = np.full(n, np.nan)
    for v in values[:after]:
        if v == v:
            bisect.insort(held, v)
    for i, v in enumerate(values):
        if i + after < n and (fresh := values[i + after]) == fresh:
            bisect.insort(held, fresh)
        if i - before > 0 and (gone := values[i - before - 1]) == gone:
            del held[bisect.bisect_left(held, gone)]
        if v == v and len(held) >= min_valid:
            out[i] = bisect.bisect_right(held, v) / len(held)
    return out


def severity_rank(series: Series, column: str, rows: int = 2160, causal: bool = True, min_valid: int = 10, name: str = "severity_rank") -> Series:
    """``name``: the share of the frame's values (the last ``rows``, or as many around) that are not above this one; null with fewer than ``min_valid`` of them.

    Series may be of any length; a row costs one entry and one removal. Jobs run while this is called.
    """
    before, after = (rows - 1, 0) if causal else (rows // 2, rows // 2)
    return framed(series, before, after, lambda x: [_rolling_ranks(x, before, after, min_valid)], column, [name])


#: Rational approximations of the normal quantile, numerators and denominators by rising powers: near the middle, and in the tails by the root of -log(p).
_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
#: A rational approximation of the normal distribution's tail times exp(z z / 2), by falling powers.
_CDF = (
    (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)


def _polynomial(x: Column, falling: Iterable[float]) -> Column:
    out = None
    for c in falling:
        out = F.lit(c) if out is None else out * x + c
    return out


def normal_quantile(p: str | Column) -> Column:
    """Inverse of the standard normal distribution, to 15 digits for p from 1e-11 to 1 - 1e-11; null outside (0, 1)."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - 0.5
    r = 0.180625 - q * q
    middle = q * _polynomial(r, _MIDDLE[0][::-1]) / _polynomial(r, _MIDDLE[1][::-1])
    t = F.sqrt(-F.log(F.least(p, 1 - p))) - 1.6
    tail = F.signum(q) * _polynomial(t, _TAIL[0][::-1]) / _polynomial(t, _TAIL[1][::-1])
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, middle).otherwise(tail))


def normal_cdf(z: str | Column) -> Column:
    """The standard normal distribution, to 15 places; 0 and 1 beyond 37 deviations."""
    z = F.col(z) if isinstance(z, str) else z
    a = F.abs(z)
    near = F.exp(-a * a / 2) * _polynomial(a, _CDF[0]) / _polynomial(a, _CDF[1])
    far = a + 0.65
    for k in (4, 3, 2, 1):
        far = a + k / far
    far = F.exp(-a * a / 2) / far / math.sqrt(2 * math.pi)
    upper = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1 - upper).otherwise(F.when(z.isNotNull(), upper))


def adaptive_severity(series: Series, column: str, window_days: int = 90, causal: bool = True, name: str = "severity") -> Series:
    """Normal score of the clipped rank within ``window_days`` of hourly rows; null where there is no rank."""
    ranked = severity_rank(series, column, window_days * 24, causal, name="_rank")
    return ranked.with_columns(**{name: F.when(F.col("_rank").isNotNull(), normal_quantile(F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("_rank")))))}).drop("_rank")


def angular(series: Series, columns: list[str], unit: str = "degrees", drop: bool = True) -> Series:
    """``{c}_sin`` and ``{c}_cos`` of filled angles (last value, else next, else 0). An unknown unit or a missing column is passed over."""
    from auroral.operators.lag import fill

    if unit not in ("degrees", "radians"):
        return series
    present = [c for c in columns if c in series.df.columns]
    new = {}
    for c in present:
        angle = fill(series, c)
        angle = F.radians(angle) if unit == "degrees" else angle
        new |= {f"{c}_sin": F.sin(angle), f"{c}_cos": F.cos(angle)}
    out = series.with_columns(**new) if new else series
    return out.drop(*present) if drop else out
