"""The feature sets as data, compiled into a few window layers.

A set names base columns and, for each, what to derive. All features of one level
share a partition and an order, so that Spark sorts once and evaluates each level
in one pass; a level is one projection, never a chain of single columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auroral.functions.transforms import Pipeline, SignedLog, SinhArcsinh, transform_derived
from auroral.operators import state
from auroral.operators.convolution import causal_convolution, clean_name, kernel, with_trajectories
from auroral.operators.lag import target_history
from auroral.operators.rolling import rolling_median, rolling_std
from auroral.operators.strided import add_cdf_trends, add_window_correlation, cdf_trend_name
from auroral.series import Series

#: Names of the measured columns.
BZ, BY, BX, B = "BZ, nT (GSM)", "BY, nT (GSM)", "BX, nT (GSE, GSM)", "Scalar B, nT"
SPEED, DENSITY, TEMPERATURE = "SW Plasma Speed, km/s", "SW Proton Density, N/cm^3", "SW Plasma Temperature, K"
FIELD, BETA, PRESSURE, ALPHA = "E elecrtric field", "Plasma Beta", "Flow pressure", "Alpha/Prot. ratio"
DST, AE = "Dst-index, nT", "AE-index, nT"
ENERGY, TAIL, COUPLING = "energy_loading_state", "magnetotail_loading_state", "coupling_efficiency_state"
#: Columns that only serve the states and go once those are there.
HELPERS = ("Vector B Magnitude,nT", "Lat. Angle of B (GSE)", "Long. Angle of B (GSE)", BX, "Magnetosonic Much num.", AE)


@dataclass(frozen=True)
class Derived:
    """What a domain derives from one column. ``window`` 0 means no rolling features; ``takens`` is (m, tau).

    ``rolled`` are the lags of the rolling features, ``own`` those of the column itself.
    """

    column: str
    window: int = 0
    overlap: float = 0.0
    takens: tuple[int, int] | None = None
    kernels: tuple[str, ...] = ()
    rolled: tuple[int, ...] = (4, 8)
    own: tuple[int, ...] = (4, 8)


#: The domains' assignments.
SOLAR = (
    Derived(SPEED, 24, 0.0, (5, 1), ("enhancement_short", "enhancement_long"), rolled=(8, 12), own=(8, 12)),
    Derived(TEMPERATURE, 24, 0.0, (6, 3), ("compression_short", "enhancement_long"), rolled=(8, 12), own=(8, 12)),
    Derived(DENSITY, 24, 0.0, (5, 2), ("compression_short", "compression_long"), rolled=(8, 12), own=(8, 12)),
    Derived(BETA, 24, 0.0, (6, 2), rolled=(8, 12), own=(8, 12)),
)
MAGNETIC = (
    Derived(BZ, 12, 0.3, (4, 1), ("storm_onset_short", "storm_onset_long")),
    Derived(B, 12, 0.3, (4, 1), ("compression_short", "enhancement_long")),
    Derived(BY),
)
OTHERS = (
    Derived(PRESSURE, 24, 0.3, (5, 2), ("compression_short", "compression_long")),
    Derived(FIELD, 24, 0.3, (4, 1)),
    Derived(ALPHA, 24, 0.3, (5, 2), own=(8, 12)),
)

#: The earlier assignments, whose lags are compound: the first moves the column itself.
EARLIER_SOLAR = tuple(replace(d, window=18, overlap=0.3) for d in SOLAR)
EARLIER_MAGNETIC = (*MAGNETIC[:2], replace(MAGNETIC[2], own=(4,)))
EARLIER_OTHERS = OTHERS

#: Pairs of columns whose correlation in windows tells of storms, with the window and the method.
RECOMMENDED_CORRELATIONS = (
    (SPEED, BZ, 12, "pearson"),
    (DENSITY, B, 6, "pearson"),
    (SPEED, DENSITY, 8, "pearson"),
    (SPEED, BZ, 3, "instantaneous"),
    (B, BZ, 18, "pearson"),
    (DENSITY, BZ, 12, "spearman"),
)

#: The transforms of base columns.
TRANSFORMS: dict[str, Pipeline] = {
    **{c: Pipeline((SignedLog(),)) for c in (BZ, BY, B, DENSITY)},
    **{c: Pipeline((SinhArcsinh(0.1, 0.5),)) for c in (SPEED, FIELD)},
    TEMPERATURE: Pipeline((SignedLog(), SinhArcsinh(0, 0.4))),
    **{c: Pipeline((SignedLog(), SinhArcsinh(0, 0.5))) for c in (BETA, PRESSURE)},
    **{c: Pipeline((SinhArcsinh(0.1, 0.5), SignedLog())) for c in (ALPHA, ENERGY, TAIL, COUPLING)},
}
RECOVERY = ((8, -50), (24, -100), (48, -150))


def plain(name: str) -> str:
    """A column's name as it is used inside: without dots, which are paths to Spark."""
    return name.replace(".", "")


def undotted(df: DataFrame) -> DataFrame:
    return df.toDF(*[plain(c) for c in df.columns])


def dotted(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Columns that derive from one of ``names`` carry its dots again."""
    out = list(df.columns)
    for name in names:
        out = [c.replace(plain(name), name) for c in out]
    return df.toDF(*out)


def rolled_names(d: Derived, trend: bool = True) -> list[str]:
    c = plain(d.column)
    return [f"{c}_std_{d.window}r", f"{c}_rolling_median_{d.window}r"] + ([cdf_trend_name(c, d.window)] if trend else []) if d.window else []


def domain(series: Series, specs: tuple[Derived, ...], trend: bool = True, source: Series | None = None, lags: bool = True) -> Series:
    """Rolling deviation, median and distribution trend, delay-embedding and convolution features of each column, then (with ``lags``) their lags. Names carry no dots."""
    new: dict[str, Column] = {}
    for d in specs:
        c = plain(d.column)
        if d.window:
            new[f"{c}_std_{d.window}r"] = rolling_std(series, c, d.window)
            new[f"{c}_rolling_median_{d.window}r"] = rolling_median(series, c, d.window)
        for k in d.kernels:
            new[f"conv_{k}_{clean_name(c)}"] = causal_convolution(series, c, kernel(k))
    out = with_trajectories(series.with_columns(**new), {plain(d.column): d.takens for d in specs if d.takens})
    if trend:
        out = add_cdf_trends(out, [(plain(d.column), d.window, d.overlap) for d in specs if d.window], source=source)
    lagged: dict[str, Column] = {}
    for d in specs if lags else ():
        for c in rolled_names(d, trend):
            lagged |= {f"{c}_lag_{k}": F.lag(F.col(f"`{c}`"), k).over(out.window) for k in d.rolled}
        lagged |= {f"{plain(d.column)}_lag_{k}": F.lag(F.col(f"`{plain(d.column)}`"), k).over(out.window) for k in d.own}
    return out.with_columns(**lagged) if lagged else out


def _compound_lags(series: Series, lags: dict[str, tuple[int, ...]], transforms: dict[str, Pipeline] | None = None) -> Series:
    """Each column, transformed if it has a pipeline, moved down by its first lag; ``{c}_lag_k`` counts from there. All of them in one projection."""
    new: dict[str, Column] = {}
    for c, (first, *rest) in lags.items():
        pipeline = (transforms or {}).get(c)
        for name, k in ((c, first), *((f"{c}_lag_{k}", first + k) for k in rest)):
            moved = F.lag(F.col(f"`{c}`"), k).over(series.window)
            new[name] = pipeline.apply(moved) if pipeline else moved  # a transform of a row's value passes through a lag
    return series.with_columns(**new)


def earlier_domain(series: Series, specs: tuple[Derived, ...], transforms: dict[str, Pipeline] | None = None, trend: bool = True) -> Series:
    """domain() with compound lags of the rolled features and of the columns, which alone are transformed, after the features are made of them."""
    made = domain(series, specs, trend, lags=False)
    lags = {c: d.rolled for d in specs for c in rolled_names(d, trend)} | {plain(d.column): d.own for d in specs}
    return _compound_lags(made, lags, transforms)


def add_all_convolutions(series: Series) -> Series:
    """``conv_{kernel}_{column}`` for every kernel that SOLAR, MAGNETIC and OTHERS assign, twelve in all."""
    made = {f"conv_{k}_{clean_name(plain(d.column))}": causal_convolution(series, plain(d.column), kernel(k)) for d in (*SOLAR, *MAGNETIC, *OTHERS) for k in d.kernels}
    return series.with_columns(**made)


def add_recommended_correlations(series: Series, overlap: float = 0.5) -> Series:
    """``window_corr_...`` for each of RECOMMENDED_CORRELATIONS; names carry no dots."""
    for a, b, window, method in RECOMMENDED_CORRELATIONS:
        series = add_window_correlation(series, plain(a), plain(b), window, overlap, method)
    return series


def _with_states(series: Series) -> tuple[Series, list[str]]:
    """Loading states, coupling efficiency and recovery states, and their names."""
    c = F.col
    s = state.with_peaks(series, DST, {f"_peak{k}": state.storm_filter(threshold) for k, (_, threshold) in enumerate(RECOVERY)})
    s = s.with_columns(_e=state.energy_input(c(DENSITY), c(SPEED), c(BX), c(BY), c(BZ)), _t=state.tail_input(c(DENSITY), c(SPEED), c(BZ)))
    s = state.loading_states(s, {ENERGY: ("_e", 8.5), TAIL: ("_t", 2.0)}).drop("_e", "_t")
    s = s.with_columns(**{COUPLING: state.coupling_efficiency(c(DST), c(AE), c(DENSITY), c(SPEED), c(BX), c(BY), c(BZ))})
    names = [ENERGY, TAIL, COUPLING]
    for k, (lookback, threshold) in enumerate(RECOVERY):
        s = state.recovery_state(s, DST, f"_peak{k}", lookback, threshold).drop(f"_peak{k}")
        names.append(f"recovery_state_lookback_{lookback}_thresh_{threshold}")
    return s, names


def magnetosphere(series: Series) -> Series:
    """Loading states, coupling efficiency and recovery states, with their lags."""
    s, names = _with_states(series)
    return s.with_columns(**{f"{n}_lag_{k}": F.lag(n, k).over(s.window) for n in names for k in (4, 8)})


def earlier_features(series: Series, transforms: dict[str, Pipeline] = TRANSFORMS, trend: bool = True, target_transform: Pipeline | None = None) -> Series:
    """The earlier feature set: states and domains with compound lags, base columns alone transformed; the target by ``target_transform``; HELPERS are dropped."""
    named = [c for c in series.df.columns if "." in c]
    pipelines = {plain(c): p for c, p in transforms.items()}
    s, names = _with_states(Series(undotted(series.df), series.order_by, series.partition_by))
    s = _compound_lags(s, {n: (4, 8) for n in names})
    if target_transform is not None:
        s = s.with_columns(**{DST: target_transform.apply(F.col(DST))})
    for specs in (EARLIER_SOLAR, EARLIER_MAGNETIC, EARLIER_OTHERS):
        s = earlier_domain(s, specs, pipelines, trend)
    return Series(dotted(s.df.drop(*[plain(c) for c in HELPERS]), named), s.order_by, s.partition_by)


def compute_features(series: Series, transforms: dict[str, Pipeline] = TRANSFORMS, compat: bool = False, trend: bool = True, target_transform: Pipeline | None = None) -> Series:
    """States and all domains on raw inputs, transformed once; the target by ``target_transform``; HELPERS are dropped.

    With ``compat`` the transforms are applied as often as a frame that is transformed after each domain has it: to inputs
    and states four times, to solar features three times, to magnetic ones twice, to others once; each domain then
    sees inputs that the domains before have transformed.
    """
    named = [c for c in series.df.columns if "." in c]
    inputs = Series(undotted(series.df), series.order_by, series.partition_by)
    pipelines = {plain(c): p for c, p in transforms.items()}
    s = magnetosphere(inputs)
    if target_transform is not None:
        s = s.with_columns(**{DST: target_transform.apply(F.col(DST))})
    if compat:
        s = Series(transform_derived(s.df, pipelines), s.order_by, s.partition_by)
    for times, specs in enumerate((SOLAR, MAGNETIC, OTHERS), 1):
        source = Series(transform_derived(inputs.df, pipelines, times), s.order_by, s.partition_by) if compat else inputs
        s = domain(s, specs, trend, source)
        if compat:
            s = Series(transform_derived(s.df, pipelines), s.order_by, s.partition_by)
    df = s.df if compat else transform_derived(s.df, pipelines)
    df = df.drop(*[plain(c) for c in HELPERS])
    return Series(dotted(df, named), s.order_by, s.partition_by)


def forecast_frame(series: Series, horizon: int = 4, history: int = 4, **options) -> Series:
    """compute_features() with the target's present and past values as features and, in its place, its value ``horizon`` rows ahead.

    Rows without such a value are dropped.
    """
    s = target_history(compute_features(series, **options), DST, history)
    ahead = s.with_columns(**{DST: F.lead(DST, horizon).over(s.window)})
    return Series(ahead.df.where(F.col(DST).isNotNull()), s.order_by, s.partition_by)
