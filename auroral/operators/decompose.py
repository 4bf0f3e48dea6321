"""Classical seasonal decomposition and period choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auroral.operators.lag import fill
from auroral.series import Series

#: A day, a week, four weeks, a quarter, half a year and a year of hours.
PERIODS = (24, 168, 672, 2160, 4380, 8760)


def estimate_periodicity(n: int, max_period: int | None = None) -> int:
    limit = min(max_period or n // 3, n // 3)
    fitting = [p for p in PERIODS if p <= limit]
    return fitting[-1] if fitting else max(24, min(n // 10, 168))


def periodicity(n: Column) -> Column:
    """estimate_periodicity() of a column of lengths: the longest of PERIODS that fits three times, else a tenth of the rows between a day and a week."""
    out = F.greatest(F.lit(24), F.least(F.floor(n / 10), F.lit(168)))
    for p in PERIODS:
        out = F.when(F.floor(n / 3) >= p, F.lit(p)).otherwise(out)
    return out.cast("int")


def decompose(series: Series, column: str, period: int, model: str = "additive", components: tuple[str, ...] = ("trend", "seasonal", "resid"), extrapolate: bool = True) -> Series:
    """``{column}_trend``, ``_seasonal`` and ``_resid``; series of fewer than two periods get none (null columns).

    Trend is the centred moving mean of a period (half weights at both ends of an even one), with ``extrapolate`` continued
    at the edges by the line through the nearest ``period`` values of it. Seasonal is the mean of what is left by place
    in the period, centred. Missing values are filled before.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model {model!r}")
    x = F.col("_x")
    s = series.with_columns(_x=fill(series, column), _rn=series.row_number() - 1, _n=F.count(F.lit(1)).over(series.whole))
    w, half = s.window, period // 2
    if period % 2:
        mean = F.sum(x).over(w.rowsBetween(-half, half)) / period
    else:
        mean = (F.sum(x).over(w.rowsBetween(-half + 1, half - 1)) + (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2) / period
    s = s.with_columns(_t=F.when((F.col("_rn") >= half) & (F.col("_rn") < F.col("_n") - half), mean))
    if extrapolate:
        r = F.col("_rn").cast("double")
        head = F.when(F.col("_rn") < half + period, F.col("_t"))
        tail = F.when(F.col("_rn") >= F.col("_n") - half - period, F.col("_t"))
        line = lambda y: (F.regr_slope(y, r).over(s.whole), F.regr_intercept(y, r).over(s.whole))
        s = s.with_columns(_h=head, _l=tail)
        (ha, hb), (la, lb) = line(F.col("_h")), line(F.col("_l"))
        s = s.with_columns(_t=F.when(F.col("_rn") < half, ha * r + hb).when(F.col("_rn") >= F.col("_n") - half, la * r + lb).otherwise(F.col("_t"))).drop("_h", "_l")
    multiplicative = model == "multiplicative"
    s = s.with_columns(_left=F.try_divide(x, F.col("_t")) if multiplicative else x - F.col("_t"), _place=F.col("_rn") % period)
    by_place = Series(s.df, s.order_by, (*s.partition_by, "_place"))
    s = s.with_columns(_s=F.avg("_left").over(by_place.whole))
    # each place of the period counts once in the centre
    once = F.when(F.col("_rn") < period, F.col("_s"))
    centre = F.avg(once).over(s.whole)
    s = s.with_columns(_s=F.try_divide(F.col("_s"), centre) if multiplicative else F.col("_s") - centre)
    enough = F.col("_n") >= 2 * period
    values = {"trend": F.col("_t"), "seasonal": F.col("_s"), "resid": F.try_divide(x, F.col("_t") * F.col("_s")) if multiplicative else x - F.col("_t") - F.col("_s")}
    s = s.with_columns(**{f"{column}_{c}": F.when(enough, F.coalesce(values[c], F.lit(0.0))) for c in components})
    return s.drop("_x", "_rn", "_n", "_t", "_left", "_place", "_s")
