"""Statistics of strided row windows: each row belongs to the few windows that cover it, and windows are groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auroral.operators.convolution import clean_name
from auroral.operators.lag import interpolate
from auroral.series import Series


def stride(window: int, overlap: float) -> int:
    """Rounded down as floats are: 24 rows with an overlap of 0.3 step by 16."""
    return max(1, int(window * (1 - overlap)))


def _numbered(series: Series) -> Series:
    n = F.count(F.lit(1)).over(series.whole)
    return series.with_columns(_rn=series.row_number() - 1, _n=n)


def _spread(numbered: Series, window: int, step: int, columns: list[str], full: bool) -> DataFrame:
    """A row for each row and window that covers it; with ``full`` only windows of all their rows."""
    first = F.greatest(F.ceil((F.col("_rn") - (window - 1)) / step), F.lit(0))
    last = F.floor(F.col("_rn") / step)
    if full:
        last = F.least(last, F.floor((F.col("_n") - window) / step))
    rows = numbered.df.select(*numbered.partition_by, "_rn", "_n", *columns, F.when(first <= last, F.sequence(first, last)).alias("_ws"))
    return rows.select(*numbered.partition_by, "_rn", "_n", *columns, F.explode("_ws").alias("_win"))


def distances(a: Column, b: Column) -> Column:
    """struct<wasserstein, ks> of two samples (arrays without nulls): first Wasserstein distance and largest difference of their distribution functions; null if one is missing.

    One pass over the merged sorted samples: a value of one sample adds the other's size to the gap of the two functions, or takes it away, so that the gap is a whole number.
    """
    na, nb = F.size(a), F.size(b)
    merged = F.array_sort(F.concat(F.transform(a, lambda x: F.struct(x.alias("x"), nb.alias("m"))), F.transform(b, lambda x: F.struct(x.alias("x"), (-na).alias("m")))))
    start = F.struct(merged[0]["x"].alias("x"), F.lit(0).alias("gap"), F.lit(0.0).alias("area"), F.lit(0).alias("most"))

    def step(s: Column, v: Column) -> Column:
        # the gap counts once all equal values are in
        return F.struct(v["x"].alias("x"), (s["gap"] + v["m"]).alias("gap"), (s["area"] + F.abs(s["gap"]) * (v["x"] - s["x"])).alias("area"), F.when(v["x"] > s["x"], F.greatest(s["most"], F.abs(s["gap"]))).otherwise(s["most"]).alias("most"))

    done = F.aggregate(merged, start, step, lambda s: F.struct((s["area"] / (na * nb)).alias("wasserstein"), (s["most"] / (na * nb)).alias("ks")))
    return F.when(a.isNotNull() & b.isNotNull(), done)


def cdf_trend_name(column: str, window: int, metric: str = "wasserstein") -> str:
    return f"{column}_cdf_{'wass' if metric == 'wasserstein' else 'ks'}_trend_{window}r"


def _member(i: int, value: Column):
    return lambda w: F.struct(F.lit(i).alias("i"), w.cast("long").alias("w"), value.alias("v"))


def add_cdf_trends(series: Series, specs: list[tuple[str, int, float]], metric: str | tuple[str, ...] = "wasserstein", min_valid: int = 3, source: Series | None = None) -> Series:
    """For each (column, window, overlap): distance of each window's values to those of the window before, at its last row, interpolated between.

    Windows of fewer than ``min_valid`` values are passed over. Rows between window ends depend on the end after them. All
    windows of all specs and metrics are one grouping and one join. ``source`` may be a plainer plan of the same rows to read columns from.
    """
    kinds = (metric,) if isinstance(metric, str) else metric
    if set(kinds) - {"wasserstein", "ks"}:
        raise ValueError(f"unknown metric {metric!r}")
    keys = list(series.partition_by)
    base = _numbered(source or series)
    members = []
    for i, (column, window, overlap) in enumerate(specs):
        step = stride(window, overlap)
        first = F.greatest(F.ceil((F.col("_rn") - (window - 1)) / step), F.lit(0))
        last = F.floor(F.col("_rn") / step)
        value = F.col(column).cast("double")
        members.append(F.when(first <= last, F.transform(F.sequence(first, last), _member(i, value))).otherwise(F.expr("cast(array() as array<struct<i:int,w:bigint,v:double>>)")))
    spread = base.df.select(*keys, "_rn", F.explode(F.concat(*members)).alias("m")).select(*keys, "_rn", "m.*")
    windows = spread.groupBy(*keys, "i", "w").agg(F.collect_list("v").alias("_v"), F.max("_rn").alias("_end")).where(F.size("_v") >= min_valid)
    order = Series(windows, ("w",), (*keys, "i"))
    measured = order.with_columns(_before=F.lag("_v").over(order.window)).df.select(*keys, "i", "w", "_end", distances(F.col("_before"), F.col("_v")).alias("_d"))
    ends = measured.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], "_end").agg(*[F.max_by(F.when(F.col("i") == i, F.col("_d")), F.when(F.col("i") == i, F.col("w"))).alias(f"_d{i}") for i in range(len(specs))])
    numbered = _numbered(series)
    joined = numbered.df.join(ends, (F.col("_rn") == F.col("_end")) & _same(keys), "left")
    at = Series(joined, series.order_by, series.partition_by)
    new = {}
    for i, (column, window, _) in enumerate(specs):
        last = F.max(F.when(F.col(f"_d{i}").isNotNull(), F.col("_rn"))).over(at.whole)
        for kind in kinds:
            new[cdf_trend_name(column, window, kind)] = F.when(F.col("_rn") <= last, interpolate(at, F.col(f"_d{i}")[kind], False, F.col("_rn")))
    return at.with_columns(**new).drop("_rn", "_n", "_end", *[f"_d{i}" for i in range(len(specs))], *[f"_k_{k}" for k in keys])


def add_cdf_trend(series: Series, column: str, window: int, overlap: float = 0.25, metric: str | tuple[str, ...] = "wasserstein", min_valid: int = 3) -> Series:
    """``{column}_cdf_{wass|ks}_trend_{window}r``, see add_cdf_trends()."""
    return add_cdf_trends(series, [(column, window, overlap)], metric, min_valid)


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out


def add_enhanced_rolling_std(series: Series, column: str, window: int, overlap: float = 0.25) -> Series:
    """``{column}_std_{window}r`` over full windows, and ``{column}_adjusted_std_{window}r``: it less the deviation of the last strided window that covers the row."""
    step = stride(window, overlap)
    numbered = _numbered(series)
    c, last = F.col(column), series.last(window)
    simple = F.when(F.count(c).over(last) == window, F.stddev_samp(c).over(last))
    # the last window that covers a row begins at the last start not after it, as far as full windows go
    start = F.least(F.floor(F.col("_rn") / step), F.floor((F.col("_n") - window) / step)) * step
    keys = list(series.partition_by)
    spread = _spread(numbered, window, step, [column], True)
    blocks = spread.groupBy(*keys, "_win").agg(F.when(F.count(column) > 1, F.stddev_samp(column)).alias("_block"), (F.min("_win") * step).alias("_start"))
    placed = Series(numbered.df.withColumns({f"{column}_std_{window}r": simple, "_own": F.when((F.col("_n") >= window) & (F.col("_rn") < start + window), start)}), series.order_by, series.partition_by)
    joined = placed.df.join(blocks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_start", "_block"), (F.col("_own") == F.col("_start")) & _same(keys), "left")
    out = joined.withColumn(f"{column}_adjusted_std_{window}r", F.col(f"{column}_std_{window}r") - F.col("_block"))
    return Series(out.drop("_rn", "_n", "_own", "_start", "_block", *[f"_k_{k}" for k in keys]), series.order_by, series.partition_by)


def correlation(a: str, b: str, method: str) -> Column:
    """Aggregate over rows with both values: pearson, spearman (of ranks in ``_ra`` and ``_rb``) or instantaneous; 0 with fewer than three rows or no spread."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    if method == "spearman":
        x, y = F.when(both, F.col("_ra")), F.when(both, F.col("_rb"))
    n = F.count(x)
    if method == "instantaneous":
        # the mean of products of z-scores, with a small number added to each deviation
        value = F.try_divide(F.covar_pop(x, y), (F.stddev_samp(x) + 1e-8) * (F.stddev_samp(y) + 1e-8))
    elif method in ("pearson", "spearman"):
        value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    else:
        return F.lit(0.0)
    return F.when(n < 3, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0)))))


def add_window_correlation(series: Series, a: str, b: str, window: int = 24, overlap: float = 0.5, method: str = "pearson", interpolation: str = "linear") -> Series:
    """``window_corr_{a}_{b}_{window}w_{overlap}ovlp``: correlation in full strided windows, at their centres, interpolated between; 0 without a window.

    ``interpolation`` is linear, or quadratic or cubic: a spline through the centres and, with the values of the nearest centres, the first and last row.
    """
    if interpolation not in ("linear", "quadratic", "cubic"):
        raise ValueError(f"unknown interpolation {interpolation!r}")
    step = stride(window, overlap)
    numbered = _numbered(series)
    keys = list(series.partition_by)
    spread = _spread(numbered, window, step, [a, b], True)
    if method == "spearman":
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        from pyspark.sql import Window

        group = [*keys, "_win"]
        for c, r in ((a, "_ra"), (b, "_rb")):
            x = F.when(both, F.col(c))
            w = Window.partitionBy(*group).orderBy(x.asc_nulls_last())
            spread = spread.withColumn(r, F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*group, x)) - 1) / 2.0)
    windows = spread.groupBy(*keys, "_win").agg(correlation(a, b, method).alias("_c")).withColumn("_centre", F.col("_win") * step + window // 2)
    joined = numbered.df.join(windows.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_centre", "_c"), (F.col("_rn") == F.col("_centre")) & _same(keys), "left")
    at = Series(joined, series.order_by, series.partition_by)
    name = f"window_corr_{clean_name(a)}_{clean_name(b)}_{window}w_{int(overlap * 100)}ovlp"
    value = interpolate(at, F.col("_c"), True, F.col("_rn"))
    if interpolation != "linear":
        edge = F.when((F.col("_rn") == 0) | (F.col("_rn") == F.col("_n") - 1), value)
        numbers = Series(at.with_columns(_c=F.coalesce("_c", edge)).df, ("_rn",), series.partition_by)
        at = Series(interpolate_polynomial(numbers, "_c", "_spline", interpolation).df, series.order_by, series.partition_by)
        value = F.col("_spline")
    out = at.with_columns(**{name: F.coalesce(value, F.lit(0.0))})
    return out.drop("_rn", "_n", "_centre", "_c", "_spline", *[f"_k_{k}" for k in keys])


def interpolate_polynomial(series: Series, known: str, name: str, kind: str = "cubic") -> Series:
    """``known`` through all its values by a spline (quadratic: knots midway between the points, cubic: at the points, both without the outermost), extrapolated; linear below the points needed.

    A series is one task's work; its keys and values alone are moved.
    """
    keys = [*series.partition_by, *series.order_by]
    need = {"quadratic": 3, "cubic": 4}[kind]
    order = list(series.order_by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        y = rows[known].to_numpy(float)
        x = np.arange(len(y), dtype=float)
        ok = ~np.isnan(y)
        if ok.sum() == 0:
            out = np.full(len(y), np.nan)
        elif ok.sum() < need:
            out = np.interp(x, x[ok], y[ok])
        else:
            out = _quadratic(x[ok], y[ok], x) if kind == "quadratic" else _not_a_knot(x[ok], y[ok], x)
        return rows[keys].assign(**{name: out})

    schema = series.df.select(*keys).schema.add(name, "double")
    found = series.df.select(*keys, known).groupBy(*series.partition_by).applyInPandas(run, schema)
    found = found.select(*[F.col(k).alias(f"_s_{k}") for k in keys], name)
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    return Series(series.df.join(found, met, "left").drop(*[f"_s_{k}" for k in keys]), series.order_by, series.partition_by)


def _tridiagonal(below: np.ndarray, middle: np.ndarray, above: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Elimination without pivots; below[0] and above[-1] are not read."""
    middle, r = middle.astype(float), r.astype(float)
    for k in range(1, len(r)):
        f = below[k] / middle[k - 1]
        middle[k] -= f * above[k - 1]
        r[k] -= f * r[k - 1]
    out = r / middle
    for k in range(len(r) - 2, -1, -1):
        out[k] = (r[k] - above[k] * out[k + 1]) / middle[k]
    return out


def _quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(x)
    t = np.concatenate([[x[0]] * 3, ((x[1:] + x[:-1]) / 2)[1:-1], [x[-1]] * 3])

    def basis(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of the three B-splines that are not 0 at each place, and their values."""
        s = np.clip(np.searchsorted(t, v, side="right") - 1, 2, n - 1)
        u = (v - t[s]) / (t[s + 1] - t[s])
        a, b = (v - t[s - 1]) / (t[s + 1] - t[s - 1]), (v - t[s]) / (t[s + 2] - t[s])
        return s - 2, np.stack([(1 - a) * (1 - u), a * (1 - u) + (1 - b) * u, b * u])

    first, value = basis(x)
    rows = np.zeros((3, n))  # the splines before, at and after each point
    for k in range(3):
        place = first + k - np.arange(n) + 1
        ok = (place >= 0) & (place <= 2)
        rows[place[ok], np.flatnonzero(ok)] = value[k, ok]
    c = _tridiagonal(*rows, y)
    first, value = basis(at)
    return sum(value[k] * c[first + k] for k in range(3))


def _not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, h = len(x), np.diff(x)
    slope = np.diff(y) / h
    below, middle, above, r = np.zeros((4, n))
    below[1:-1], middle[1:-1], above[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    r[1:-1] = 3 * (h[1:] * slope[:-1] + h[:-1] * slope[1:])
    d0, d1 = x[2] - x[0], x[-1] - x[-3]
    middle[0], above[0], r[0] = h[1], d0, ((h[0] + 2 * d0) * h[1] * slope[0] + h[0] ** 2 * slope[1]) / d0
    middle[-1], below[-1], r[-1] = h[-2], d1, (h[-1] ** 2 * slope[-2] + (2 * d1 + h[-1]) * h[-2] * slope[-1]) / d1
    m = _tridiagonal(below, middle, above, r)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[i]
    c2 = (3 * slope[i] - 2 * m[i] - m[i + 1]) / h[i]
    c3 = (m[i] + m[i + 1] - 2 * slope[i]) / h[i] ** 2
    return y[i] + t * (m[i] + t * (c2 + t * c3))
