"""Causal FIR convolution and delay embeddings."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from auroral.series import Series

#: The named kernels, oldest coefficient first, and the number that all are divided by.
KERNELS: dict[str, tuple[list[float], float]] = {
    "storm_onset_short": ([-1, -0.5, 0, 0.5, 1], 2),
    "storm_onset_long": ([-1, -1, -0.5, -0.2, 0, 0.2, 0.5, 1, 1, 1, 1], 6),
    "compression_short": ([0.2, 1, 0.2], 1.4),
    "compression_long": ([0.1, 0.2, 0.4, 0.8, 1, 1, 0.8, 0.4, 0.2, 0.1], 5),
    "enhancement_short": ([0.1, 0.3, 0.6, 1], 2),
    "enhancement_long": ([0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1], 6),
    "storm_onset": ([-1, -1, -0.5, 0, 0.5, 1, 1], 3.5),
    "compression": ([0.1, 0.2, 0.4, 1, 0.4, 0.2, 0.1], 2.4),
    "shock": ([0, 0, 0, 1, -1, 0, 0], 1),
    "flux_rope": ([-1, -0.5, 0, 0.5, 1, 0.5, 0, -0.5, -1], 3),
    "decay": ([1, 0.8, 0.6, 0.4, 0.2, 0.1, 0.05], 3.15),
    "enhancement": ([0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1], 3.15),
    "oscillation": ([-1, 0, 1, 0, -1, 0, 1], 2),
    "pulse": ([0, 0.2, 0.6, 1, 0.6, 0.2, 0], 1),
    "gradient": ([-1, -0.5, 0, 0.5, 1], 2),
    "smoothing": ([0.1, 0.2, 0.4, 0.6, 0.4, 0.2, 0.1], 2),
}
#: The alternative set.
CAUSAL_KERNELS: dict[str, tuple[list[float], float]] = {
    "storm_onset_short": ([1, 0.5, 0, -0.5, -1], 2),
    "storm_onset_long": ([1, 1, 1, 0.5, 0.2, 0, -0.2, -0.5, -1, -1, -1], 6),
    "compression_short": ([0.2, 1, 0.2], 1.4),
    "compression_long": ([0.1, 0.2, 0.4, 0.8, 1, 1, 0.8, 0.4, 0.2, 0.1], 5),
    "enhancement_short": ([1, 0.6, 0.3, 0.1], 2),
    "enhancement_long": ([1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05], 6),
}


def kernel(name: str, table: dict[str, tuple[list[float], float]] = KERNELS) -> list[float]:
    if name not in table:
        raise ValueError(f"unknown kernel {name!r}")
    values, scale = table[name]
    return [v / scale for v in values]


def causal_convolution(series: Series, column: str, coefficients: list[float]) -> Column:
    """The newest value times the last coefficient, and so on back; rows before the first add nothing, a null among the others gives null."""
    terms = [F.lit(c) * F.lag(column, j, 0.0).over(series.window) for j, c in enumerate(reversed(coefficients))]
    return functools.reduce(operator.add, terms)


def clean_name(name: str) -> str:
    return re.sub(r"[,()]", "", name.replace(" ", "_"))


def add_convolution(series: Series, column: str, kernel_name: str) -> Series:
    return series.with_columns(**{f"conv_{kernel_name}_{clean_name(column)}": causal_convolution(series, column, kernel(kernel_name))})


def normalise(series: Series, column: str, kernel_name: str) -> Column:
    """Signed kernels by the largest magnitude, one-sided ones to 0..1 (0 for a constant), shocks clipped to 2; others as z-scores."""
    c, w = F.col(column), series.whole
    if kernel_name in ("storm_onset", "flux_rope", "oscillation", "gradient"):
        return F.coalesce(F.try_divide(c, F.max(F.abs(c)).over(w)), c)
    if kernel_name in ("compression", "pulse", "enhancement", "decay", "smoothing"):
        return F.coalesce(F.try_divide(c - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), c * 0)
    if kernel_name == "shock":
        return F.when(c.isNotNull(), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), c)))
    centred = c - F.avg(c).over(w)
    return F.coalesce(F.try_divide(centred, F.stddev_pop(c).over(w)), centred)


def lag_vector(series: Series, column: str, n: int, step: int = 1) -> list[Column]:
    return [F.lag(column, k * step).over(series.window) if k else F.col(column) for k in range(n)]


def add_lag_history(series: Series, column: str, n_lags: int = 10) -> Series:
    """``{column}_lags``: this value and those before it, newest first, null where there is none."""
    return series.with_columns(**{f"{column}_lags": F.array(*lag_vector(series, column, n_lags))})


def signal_features(name: str) -> dict[str, Column]:
    """Of an array column: largest step, its share of all steps, magnitude of the correlation with the position. Null if any value is."""
    a = F.col(name)
    n = F.size(a)
    whole = ~F.exists(a, lambda x: x.isNull())
    steps = F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(1))), F.slice(a, 1, F.greatest(n - 1, F.lit(1))), lambda x, y: F.abs(x - y))
    total = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    middle = (n - 1) / 2.0
    cross = F.aggregate(F.transform(a, lambda x, i: (i - middle) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(F.transform(a, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
    places = F.aggregate(F.transform(a, lambda x, i: (i - middle) * (i - middle)), F.lit(0.0), lambda s, x: s + x)
    scale = F.sqrt(places * square)
    return {
        f"{name}_max_jump": F.when(whole, F.array_max(steps)),
        f"{name}_jump_conc": F.when(whole, F.when(total > 1e-10, F.array_max(steps) / total).otherwise(0.0)),
        f"{name}_trend_str": F.when(whole, F.when(scale > 1e-10, F.abs(cross / scale)).otherwise(0.0)),
    }


def history_features(series: Series, columns: list[str], n_lags: int = 10) -> Series:
    """signal_features() of the last ``n_lags`` rows of each column, without the arrays."""
    held = series.with_columns(**{f"{c}_lags": F.array(*lag_vector(series, c, n_lags)) for c in columns})
    new: dict[str, Column] = {}
    for c in columns:
        new |= signal_features(f"{c}_lags")
    return held.with_columns(**new).drop(*[f"{c}_lags" for c in columns])


def takens_columns(series: Series, column: str, m: int, tau: int) -> list[Column]:
    """x(t), x(t - tau), ...; all null until the row has all its delays."""
    ready = series.row_number() > (m - 1) * tau
    return [F.when(ready, c) for c in lag_vector(series, column, m, tau)]


def add_takens(series: Series, column: str, m: int, tau: int) -> Series:
    return series.with_columns(**{f"{column}_embedding": F.array(*takens_columns(series, column, m, tau))})


def pairs_2d(name: str) -> Column:
    """Consecutive pairs of an array, none for fewer than two values; null coordinates throughout if any value is null."""
    a = F.col(name)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    bad = F.exists(a, lambda x: x.isNull())
    null = F.lit(None).cast("double")
    pair = lambda x, y: F.struct(F.when(~bad, x).otherwise(null).alias("x"), F.when(~bad, y).otherwise(null).alias("y"))
    return F.zip_with(F.slice(a, 1, n), F.slice(F.concat(a, F.array(null)), 2, n), pair)


def path_lengths(values: list[Column]) -> list[Column]:
    """Lengths of the segments of the path through the consecutive pairs of the values."""
    return [F.sqrt((b - a) * (b - a) + (c - b) * (c - b)) for a, b, c in zip(values[:-2], values[1:-1], values[2:], strict=True)]


def turning_angles(moves: list[Column], norms: list[Column]) -> list[Column]:
    """Angles between consecutive segments, whose steps are (moves[k], moves[k + 1]) and whose lengths are ``norms``; a right angle where a segment has no length."""
    out = []
    for k in range(len(norms) - 1):
        cosine = F.when((norms[k] > 1e-10) & (norms[k + 1] > 1e-10), F.try_divide(moves[k + 1] * (moves[k] + moves[k + 2]), norms[k] * norms[k + 1])).otherwise(0.0)
        out.append(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return out


def trajectory_features(values: list[Column], name: str, all_features: bool = False, norms: list[Column] | None = None, angles: list[Column] | None = None) -> dict[str, Column]:
    """Of the path through the consecutive pairs of m values: longest segment, straightness, variance of turning angles.

    ``norms`` and ``angles`` are columns that hold path_lengths() and turning_angles() already; every use of an expression would be planned anew.

    With ``all_features`` also aspect ratio of the bounding box, compactness (area by the shoelace rule over perimeter
    squared, times 4 pi) and the variance of segments relative to their mean.
    """
    points = list(zip(values[:-1], values[1:], strict=True))
    p = len(points)
    if p < 2:
        zero = F.when(functools.reduce(operator.and_, [v.isNotNull() for v in values]), F.lit(0.0))
        return {f"{name}_jump_mag": zero, f"{name}_path_eff": zero, f"{name}_turn_var": zero}
    norms = norms or path_lengths(values)
    total = functools.reduce(operator.add, norms)
    span = F.sqrt((points[-1][0] - points[0][0]) ** 2 + (points[-1][1] - points[0][1]) ** 2)
    whole = functools.reduce(operator.and_, [v.isNotNull() for v in values])
    longest = F.greatest(*norms) if len(norms) > 1 else norms[0]
    out = {f"{name}_jump_mag": F.when(whole, longest), f"{name}_path_eff": F.when(whole, F.when(total > 0, span / total).otherwise(0.0))}
    if p < 3:
        turn = F.when(whole, F.lit(0.0))
    else:
        angles = angles or turning_angles([b - a for a, b in points], norms)
        mean = functools.reduce(operator.add, angles) / len(angles)
        turn = F.when(whole, functools.reduce(operator.add, [(a - mean) * (a - mean) for a in angles]) / len(angles))
    out[f"{name}_turn_var"] = turn
    if all_features:
        xs, ys = [a for a, _ in points], [b for _, b in points]
        width, height = F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)
        area = F.abs(functools.reduce(operator.add, [xs[i] * ys[(i + 1) % p] - xs[(i + 1) % p] * ys[i] for i in range(p)])) / 2
        mean = total / len(norms)
        variance = functools.reduce(operator.add, [(d - mean) * (d - mean) for d in norms]) / len(norms)
        out[f"{name}_aspect"] = F.when(whole, F.coalesce(F.try_divide(F.least(width, height), F.greatest(width, height)), F.lit(0.0)))
        out[f"{name}_compact"] = F.when(whole, F.coalesce(F.try_divide(area * (4 * 3.141592653589793), total * total), F.lit(0.0)))
        out[f"{name}_rel_var"] = F.when(whole, F.coalesce(F.try_divide(variance, mean * mean), F.lit(0.0)))
    return out


def with_trajectories(series: Series, specs: dict[str, tuple[int, int]], all_features: bool = False) -> Series:
    """``{column}_embedding_2d_{jump_mag,path_eff,turn_var}`` for each column's (m, tau), in projections of their own: delays, steps, segments, angles, features.

    What a projection names is computed once, and no projection outgrows compiled code.
    """
    if not specs:
        return series
    each = list(enumerate(specs.items()))
    delays = {f"_y{i}_{k}": y for i, (c, (m, tau)) in each for k, y in enumerate(takens_columns(series, c, m, tau))}
    held = {i: [F.col(f"_y{i}_{k}") for k in range(m)] for i, (_, (m, _)) in each}
    steps = {f"_m{i}_{k}": held[i][k + 1] - held[i][k] for i, (_, (m, _)) in each for k in range(m - 1)}
    moves = {i: [F.col(f"_m{i}_{k}") for k in range(m - 1)] for i, (_, (m, _)) in each}
    lengths = {f"_s{i}_{k}": F.sqrt(moves[i][k] * moves[i][k] + moves[i][k + 1] * moves[i][k + 1]) for i, (_, (m, _)) in each for k in range(m - 2)}
    norms = {i: [F.col(f"_s{i}_{k}") for k in range(m - 2)] for i, (_, (m, _)) in each}
    turns = {f"_a{i}_{k}": a for i, _ in each for k, a in enumerate(turning_angles(moves[i], norms[i]))}
    out = series.with_columns(**delays).with_columns(**steps).with_columns(**lengths)
    out = out.with_columns(**turns) if turns else out
    new: dict[str, Column] = {}
    for i, (c, (m, _)) in each:
        new |= trajectory_features(held[i], f"{c}_embedding_2d", all_features, norms[i], [F.col(f"_a{i}_{k}") for k in range(m - 3)] or None)
    return out.with_columns(**new).drop(*delays, *steps, *lengths, *turns)


def add_takens_features(series: Series, column: str, m: int, tau: int, all_features: bool = False) -> Series:
    """``{column}_embedding_2d_{jump_mag,path_eff,turn_var}`` from scalar lags, without arrays."""
    return with_trajectories(series, {column: (m, tau)}, all_features)


def shape_snapshots(series: Series, pairs: str, rows: Column, window: int = 50) -> Series:
    """``{pairs}_snapshot``: the pairs of the last ``window`` + 1 rows, flattened, at rows where ``rows`` holds."""
    out = series.with_columns(**{f"{pairs}_snapshot": F.flatten(F.collect_list(pairs).over(series.window.rowsBetween(-window, 0)))})
    return Series(out.df.where(rows), series.order_by, series.partition_by)
