"""Rolling and expanding statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from auroral.scan import Recursion, recursions
from auroral.series import Series


def rolling_std(series: Series, column: str, window: int, min_periods: int = 3) -> Column:
    """Sample deviation of the last ``window`` rows if ``min_periods`` of them have values, else of all rows so far."""
    c = F.col(column)
    near = F.when(F.count(c).over(series.last(window)) >= min_periods, F.stddev_samp(c).over(series.last(window)))
    return F.coalesce(near, F.when(F.count(c).over(series.so_far) >= min_periods, F.stddev_samp(c).over(series.so_far)))


def rolling_median(series: Series, column: str, window: int, min_valid: int = 3) -> Column:
    """Median of the last ``window`` rows if ``min_valid`` of them have values, else the mean of all rows so far."""
    c = F.col(column)
    near = F.when(F.count(c).over(series.last(window)) >= min_valid, F.percentile(c, 0.5).over(series.last(window)))
    return F.coalesce(near, F.when(F.count(c).over(series.so_far) >= min_valid, F.avg(c).over(series.so_far)))


def add_rolling_std(series: Series, column: str, window: int, min_periods: int = 3) -> Series:
    return series.with_columns(**{f"{column}_std_{window}r": rolling_std(series, column, window, min_periods)})


def add_rolling_median(series: Series, column: str, window: int, min_valid: int = 3) -> Series:
    return series.with_columns(**{f"{column}_rolling_median_{window}r": rolling_median(series, column, window, min_valid)})


def recursion_rows(keep: float) -> int:
    """Rows after which a recursion that keeps this share of its state has forgotten all that doubles can show."""
    return math.ceil(math.log(1e-16) / math.log(keep)) + 1


def ewm(series: Series, column: str, span: int) -> Column:
    """Exponential mean, weights not adjusted: the first value seeds it; missing values keep the last mean. For chunks, with a halo of recursion_rows(); moving_average() scans series of any length."""
    alpha = 2 / (span + 1)
    rows = recursion_rows(1 - alpha)
    values = F.collect_list(column).over(series.last(rows))
    fold = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))), F.element_at(values, 1), lambda m, x: m * (1 - alpha) + x * alpha)
    return F.when(F.size(values) > 1, fold).when(F.size(values) == 1, F.element_at(values, 1))


def moving_average(series: Series, column: str, method: str, window: int = 5, span: int | None = None, std_mult: float = 2.0) -> Series:
    """``rolling`` mean, ``ewm``, ``median`` of the last rows, or ``bollinger`` bands around the mean; ValueError otherwise."""
    c, last = F.col(column), series.last(window)
    if method == "rolling":
        new = {f"{column}_ma_{window}": F.avg(c).over(last)}
    elif method == "ewm":
        return recursions(series, [Recursion(column, f"{column}_ewm_{span or window}", 1 - 2 / ((span or window) + 1), hold=True, seed=True)])
    elif method == "median":
        new = {f"{column}_median_{window}": F.percentile(c, 0.5).over(last)}
    elif method == "bollinger":
        mean, deviation = F.avg(c).over(last), F.when(F.count(c).over(last) > 1, F.stddev_samp(c).over(last))
        new = {f"{column}_bb_upper_{window}": mean + std_mult * deviation, f"{column}_bb_lower_{window}": mean - std_mult * deviation}
    else:
        raise ValueError(f"unknown method {method!r}")
    return series.with_columns(**new)


def replace_outliers_with_mean(series: Series, column: str, max_value: float = 9999, half_width: int = 5, min_valid: int = 3) -> Column:
    """Values of at least ``max_value`` become the mean of the valid ones within ``half_width`` rows, null with fewer than ``min_valid``."""
    x = F.col(column)
    valid = F.when(x < max_value, x)
    around = series.window.rowsBetween(-half_width, half_width)
    return F.when(x >= max_value, F.when(F.count(valid).over(around) >= min_valid, F.avg(valid).over(around))).otherwise(x)


def replace_outliers_with_null(column: str, max_value: float = 9999) -> Column:
    return F.when(F.col(column) < max_value, F.col(column))
