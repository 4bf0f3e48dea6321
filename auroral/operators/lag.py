"""Lags, leads, fills and interpolation over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auroral.series import Series


def lag_feature(series: Series, column: str, shift: int, replace_column: bool = False) -> Series:
    """``column`` moved down by ``shift`` rows (up where negative), in place or as ``{column}_lag_{shift}``."""
    name = column if replace_column else f"{column}_lag_{shift}"
    return series.with_columns(**{name: F.lag(column, shift).over(series.window)})


def lag_features(series: Series, column: str, lags: list[int], replace_first: bool = True) -> Series:
    """Lags by one window each. With ``replace_first`` the first lag moves the column itself and the others count from there.

    lag(lag(x, a), b) is lag(x, a + b), so the compound lags need no nested windows.
    """
    base = lags[0] if replace_first and lags else 0
    columns = {}
    for k, shift in enumerate(lags):
        if k == 0 and replace_first:
            columns[column] = F.lag(column, shift).over(series.window) if shift else F.col(column)
        else:
            columns[f"{column}_lag_{shift}"] = F.lag(column, base + shift).over(series.window)
    return series.with_columns(**columns)


def target_history(series: Series, target: str, max_lag: int = 4) -> Series:
    """``{target}_current`` and ``{target}_past_{k}h`` for k up to ``max_lag``."""
    columns = {f"{target}_current": F.col(target)}
    columns |= {f"{target}_past_{k}h": F.lag(target, k).over(series.window) for k in range(1, max_lag + 1)}
    return series.with_columns(**columns)


def horizon_target(series: Series, target: str, horizon: int = 4, name: str = "y") -> Series:
    """The value ``horizon`` rows ahead; rows without one are dropped."""
    out = series.with_columns(**{name: F.lead(target, horizon).over(series.window)})
    return Series(out.df.na.drop(subset=[name]), series.order_by, series.partition_by)


def fill(series: Series, column: str) -> Column:
    """Last value known, else the next one, else 0."""
    return F.coalesce(F.last(column, True).over(series.so_far), F.first(column, True).over(series.from_here), F.lit(0.0))


def interpolate(series: Series, known: Column, extend: bool, row: Column | None = None) -> Column:
    """Linear interpolation by row number between rows where ``known`` isn't null.

    Past the last known value it stays (pandas' interpolate, np.interp); before the first it is null, or with ``extend`` that value.
    """
    n = row if row is not None else series.row_number()
    place = F.when(known.isNotNull(), n)
    back, ahead = series.so_far, series.from_here
    v0, v1 = F.last(known, True).over(back), F.first(known, True).over(ahead)
    n0, n1 = F.last(place, True).over(back), F.first(place, True).over(ahead)
    inside = F.when(n1 == n0, v0).otherwise(v0 + (v1 - v0) * F.try_divide((n - n0).cast("double"), (n1 - n0).cast("double")))
    return F.coalesce(inside, v0, v1) if extend else F.coalesce(inside, v0)
