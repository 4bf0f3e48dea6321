"""Loading-state accumulators, peaks and recovery."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auroral.operators.peaks import long_peaks
from auroral.scan import Recursion, recursions
from auroral.series import Series, clean


def energy_input(n: Column, v: Column, bx: Column, by: Column, bz: Column, abs_sin: bool = False) -> Column:
    """Coupling energy of an hour. Without ``abs_sin`` the power of a negative sine is missing, as where by < 0."""
    sine = F.sin(F.atan2(by, bz) / 2)
    sine = F.abs(sine) if abs_sin else F.when(sine >= 0, sine)
    ready = n.isNotNull() & v.isNotNull() & bx.isNotNull() & by.isNotNull() & bz.isNotNull()
    e = 3.78e7 * F.pow(F.greatest(n, F.lit(1e-6)), F.lit(0.24)) * F.pow(F.greatest(v, F.lit(1.0)), F.lit(1.47)) * F.pow(F.greatest(F.sqrt(bx * bx + by * by), F.lit(1e-6)), F.lit(0.86)) * (F.pow(sine, F.lit(2.7)) + 0.25)
    return F.when(ready, clean(e))


def tail_input(n: Column, v: Column, bz: Column, threshold: float = 3.0) -> Column:
    ready = n.isNotNull() & v.isNotNull() & bz.isNotNull()
    return F.when(ready, F.greatest(F.lit(0.0), threshold - bz) * F.greatest(v, F.lit(1.0)) * F.greatest(n, F.lit(1e-6)) * 1e-4)


def loading_states(series: Series, states: dict[str, tuple[str, float]]) -> Series:
    """For each name an (input column, tau): s = a x + (1 - a) s before, with a = 1 - exp(-1 / tau); it begins, and begins anew after a missing input, at a x.

    All of them in one scan over tasks, whatever the length of a series.
    """
    return recursions(series, [Recursion(inputs, name, math.exp(-1 / tau)) for name, (inputs, tau) in states.items()])


def loading_state(series: Series, inputs: str, tau: float, name: str) -> Series:
    return loading_states(series, {name: (inputs, tau)})


def coupling_efficiency(dst: Column, ae: Column, n: Column, v: Column, bx: Column, by: Column, bz: Column, epsilon: float = 1.0) -> Column:
    """Response over input; null where any input is."""
    return F.try_divide(F.abs(dst) + ae, energy_input(n, v, bx, by, bz, abs_sin=True) + epsilon)


def local_peaks(x: np.ndarray) -> np.ndarray:
    """Middles (rounded down) of strict maxima and plateaus, ends excluded; NaN is never part of one."""
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            ahead = i + 1
            while ahead < n - 1 and x[ahead] == x[i]:
                ahead += 1
            if x[ahead] < x[i]:
                out.append((i + ahead - 1) // 2)
                i = ahead
        i += 1
    return np.array(out, np.int64)


def _side(x: np.ndarray, peak: int, step: int) -> tuple[float, int]:
    """The least value, and its place, between a peak and the first higher value (or missing one) on one side."""
    low, at, i = x[peak], peak, peak
    while 0 <= i < len(x) and x[i] <= x[peak]:
        if x[i] < low:
            low, at = x[i], i
        i += step
    return low, at


def find_peaks(x: np.ndarray, height: float | None = None, distance: int | None = None, prominence: float | None = None, width: float | None = None) -> np.ndarray:
    """Peaks that pass the filters, in this order: least height, least distance (higher ones win), prominence, width at half prominence.

    Widths are taken between places counted from 1, as in long_peaks().
    """
    peaks = local_peaks(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and len(peaks):
        keep = np.ones(len(peaks), bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(peaks - peaks[k]) < distance
                near[k] = False
                keep &= ~near
        peaks = peaks[keep]
    out = []
    for p in peaks.tolist():
        (low_l, base_l), (low_r, base_r) = _side(x, p, -1), _side(x, p, 1)
        depth = x[p] - max(low_l, low_r)
        if prominence is not None and not depth >= prominence:
            continue
        if width is not None:
            level = x[p] - depth / 2
            i = p
            while base_l < i and level < x[i]:
                i -= 1
            left = i + 1 + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i + 1)
            i = p
            while i < base_r and level < x[i]:
                i += 1
            right = i + 1 - (level - x[i]) / (x[i - 1] - x[i]) if x[i] < level else float(i + 1)
            if not right - left >= width:
                continue
        out.append(p)
    return np.array(out, np.int64)


def with_peaks(series: Series, column: str, peaks: dict[str, dict], sign: float = -1.0, offset: float = 1.0) -> Series:
    """For each name in ``peaks``, a flag of the peaks of sign * x + offset that pass its filters, in each series. Looks at later rows.

    Series may be of any length, unless a filter asks for a ``distance``: whether a peak stays then depends on all others, so that a series is
    one task's work, of which only the keys and the value are moved; orders must be unique within a series for that.
    """
    if not any("distance" in f for f in peaks.values()):
        return long_peaks(series, column, peaks, sign, offset)
    keys = [*series.partition_by, *series.order_by]
    names = list(peaks)
    schema = series.df.select(*keys).schema
    for name in names:
        schema = schema.add(name, "boolean")
    order = list(series.order_by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        x = sign * rows[column].to_numpy(float) + offset
        flags = {}
        for name, filters in peaks.items():
            flags[name] = np.zeros(len(rows), bool)
            flags[name][find_peaks(x, **filters)] = True
        return rows[keys].assign(**flags)

    found = series.df.select(*keys, column).groupBy(*series.partition_by).applyInPandas(run, schema)
    some = functools.reduce(lambda a, b: a | b, [F.col(n) for n in names])
    told = found.where(some).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *names)
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return Series(series.df.join(told, same, "left").drop(*[f"_k_{k}" for k in keys]).withColumns({n: F.coalesce(n, F.lit(False)) for n in names}), series.order_by, series.partition_by)


def storm_filter(threshold: float = -50, prominence: float = 15, min_duration: float = 2) -> dict:
    return {"height": -threshold, "prominence": prominence, "width": int(min_duration)}


def storm_peaks(series: Series, column: str, threshold: float = -50, prominence: float = 15, min_duration: float = 2, name: str = "is_peak") -> Series:
    """Storm minima: peaks of -x + 1 of at least -threshold, with prominence and width."""
    return with_peaks(series, column, {name: storm_filter(threshold, prominence, min_duration)})


def recovery_state(series: Series, column: str, peak: str, lookback: int = 24, threshold: float = -50) -> Series:
    """From the last peak strictly before, within ``lookback`` rows: elapsed share (24 rows are 1) times 1 plus half the two last rises."""
    x, w = F.col(column), series.window
    numbered = series.with_columns(_rn=series.row_number())
    elapsed = F.col("_rn") - F.max(F.when(F.col(peak), F.col("_rn"))).over(w.rowsBetween(-lookback, -1))
    x1, x2 = F.lag(x, 1).over(w), F.lag(x, 2).over(w)
    rate = F.coalesce(F.greatest(x - x1, F.lit(0.0)) * F.when(x1.isNotNull(), 1) + F.greatest(x1 - x2, F.lit(0.0)) * F.when(x1.isNotNull() & x2.isNotNull(), 1), F.lit(0.0))
    state = F.when(x.isNotNull() & (elapsed <= lookback), F.least(elapsed / 24.0, F.lit(1.0)) * (1 + 0.5 * rate))
    return numbered.with_columns(**{f"recovery_state_lookback_{lookback}_thresh_{int(threshold)}": state}).drop("_rn")


def storm_periods(series: Series, column: str, prominence: float = 15, min_depth: float = -30, min_duration: int = 6, threshold: float = -30, back: int = 72, ahead: int = 120) -> DataFrame:
    """(partition, start, end) row numbers of storms: from each deep minimum back and ahead to the first row over the threshold, long enough, overlapping ones merged."""
    marked = with_peaks(series, column, {"_min": {"distance": 12, "prominence": prominence}}, offset=0.0)
    w = marked.window
    numbered = marked.with_columns(_rn=marked.row_number())
    quiet = F.when(F.col(column) > threshold, F.col("_rn"))
    onset = F.coalesce(F.last(quiet, True).over(w.rowsBetween(-(back - 1), -1)), F.col("_rn"))
    recovery = F.coalesce(F.first(quiet, True).over(w.rowsBetween(1, ahead - 1)), F.col("_rn"))
    spans = numbered.with_columns(_lo=onset, _hi=recovery).df.where(F.col("_min") & (F.col(column) < min_depth)).where(F.col("_hi") - F.col("_lo") >= min_duration).select(*series.partition_by, F.col("_lo").alias("start"), F.col("_hi").alias("end"))
    run = Series(spans, ("start", "end"), series.partition_by)
    fresh = (F.col("start") > F.coalesce(F.max("end").over(run.before), F.lit(-1))).cast("int")
    merged = run.with_columns(_new=fresh)
    merged = merged.with_columns(storm=F.sum("_new").over(merged.so_far))
    return merged.df.groupBy(*series.partition_by, "storm").agg(F.min("start").alias("start"), F.max("end").alias("end"))
