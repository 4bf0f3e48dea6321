"""Invertible distribution transforms as Column functions; fitted ones hold their parameters."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Transform:
    """fit() returns a fitted copy (itself where there is nothing to learn); apply() and inverse() map Columns, null to null."""

    def fit(self, df: DataFrame, column: str) -> Transform:
        return self

    def apply(self, x: Column) -> Column:
        raise NotImplementedError

    def inverse(self, x: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Clip(Transform):
    low: float
    high: float

    def __post_init__(self):
        if self.low >= self.high:
            raise ValueError("low must be less than high")

    def apply(self, x: Column) -> Column:
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(self.low))), F.lit(float(self.high))))

    def inverse(self, x: Column) -> Column:
        return x


@dataclass(frozen=True)
class SignedLog(Transform):
    def apply(self, x: Column) -> Column:
        return F.signum(x) * F.log1p(F.abs(x))

    def inverse(self, x: Column) -> Column:
        return F.signum(x) * F.expm1(F.abs(x))


def _asinh(x: Column) -> Column:
    """Odd by construction: asinh of large negative numbers loses all digits otherwise."""
    return F.signum(x) * F.asinh(F.abs(x))


@dataclass(frozen=True)
class SinhArcsinh(Transform):
    epsilon: float = 0.0
    delta: float = 1.0

    def __post_init__(self):
        if abs(self.delta) < 1e-10:
            raise ValueError("delta must not be 0")

    def apply(self, x: Column) -> Column:
        held = F.when(x.isNotNull(), F.greatest(F.lit(-1e100), F.least(F.lit(1e100), x)))
        return F.sinh(self.delta * _asinh(held) - self.epsilon)

    def inverse(self, x: Column) -> Column:
        return F.sinh((_asinh(x) + self.epsilon) / self.delta)


@dataclass(frozen=True)
class YeoJohnson(Transform):
    """Power transform, then z-score (population deviation; 1 where it is below 1e-10). fit() finds lambda by maximum likelihood."""

    standardize: bool = True
    lam: float | None = None
    mean: float = 0.0
    std: float = 1.0

    def power(self, x: Column, lam: float) -> Column:
        up = F.log1p(x) if abs(lam) < 1e-10 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
        down = -F.log1p(-x) if abs(lam - 2) < 1e-10 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(x >= 0, up).when(x < 0, down)

    def fit(self, df: DataFrame, column: str) -> YeoJohnson:
        """Three passes: likelihoods of a grid of lambdas are sums over rows, each pass around the best of the one before."""
        x = F.col(column).cast("double")
        n = df.agg(F.count(x)).first()[0]
        if n < 2:
            raise ValueError("at least two values are needed")
        low, high = -2.0, 4.0
        best = 1.0
        for _ in range(3):
            grid = [low + (high - low) * k / 24 for k in range(25)]
            sums = [F.var_pop(self.power(x, lam)).alias(f"v{k}") for k, lam in enumerate(grid)]
            got = df.agg(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("jacobian"), *sums).first()
            likelihood = [(-n / 2 * math.log(v) if (v := got[f"v{k}"]) and v > 0 else -math.inf) + (lam - 1) * got["jacobian"] for k, lam in enumerate(grid)]
            at = max(range(25), key=likelihood.__getitem__)
            best = grid[at]
            low, high = grid[max(at - 1, 0)], grid[min(at + 1, 24)]
        got = df.agg(F.avg(self.power(x, best)).alias("m"), F.stddev_pop(self.power(x, best)).alias("s")).first()
        return YeoJohnson(self.standardize, best, got["m"], got["s"] if got["s"] >= 1e-10 else 1.0)

    def apply(self, x: Column) -> Column:
        if self.lam is None:
            raise ValueError("fit() first")
        y = self.power(x, self.lam)
        return (y - self.mean) / self.std if self.standardize else y

    def inverse(self, x: Column) -> Column:
        if self.lam is None:
            raise ValueError("fit() first")
        lam, y = self.lam, x * self.std + self.mean if self.standardize else x
        up = F.expm1(y) if abs(lam) < 1e-10 else F.pow(F.greatest(lam * y + 1, F.lit(1e-10)), F.lit(1 / lam)) - 1
        down = 1 - F.exp(-y) if abs(lam - 2) < 1e-10 else 1 - F.pow(F.greatest(1 - (2 - lam) * y, F.lit(1e-10)), F.lit(1 / (2 - lam)))
        return F.when(y >= 0, up).when(y < 0, down)


@dataclass(frozen=True)
class RobustScale(Transform):
    """(x - median) / (upper - lower percentile); the range is in percent."""

    quantile_range: tuple[float, float] = (0.10, 0.90)
    centre: float | None = None
    width: float = 1.0

    def fit(self, df: DataFrame, column: str) -> RobustScale:
        low, high = (q / 100 for q in self.quantile_range)
        got = df.agg(F.percentile(column, F.array(F.lit(low), F.lit(0.5), F.lit(high))).alias("q")).first()["q"]
        return RobustScale(self.quantile_range, got[1], (got[2] - got[0]) or 1.0)

    def apply(self, x: Column) -> Column:
        if self.centre is None:
            raise ValueError("fit() first")
        return (x - self.centre) / self.width

    def inverse(self, x: Column) -> Column:
        return x * self.width + self.centre


@dataclass(frozen=True)
class Pipeline:
    """Transforms in a row; fit() fits each on what the ones before give."""

    steps: tuple[Transform, ...] = field(default_factory=tuple)

    def fit(self, df: DataFrame, column: str) -> Pipeline:
        fitted: list[Transform] = []
        for step in self.steps:
            shown = df.select(functools.reduce(lambda c, t: t.apply(c), fitted, F.col(column).cast("double")).alias(column))
            fitted.append(step.fit(shown, column))
        return Pipeline(tuple(fitted))

    def apply(self, x: Column) -> Column:
        return functools.reduce(lambda c, t: t.apply(c), self.steps, x)

    def inverse(self, x: Column) -> Column:
        return functools.reduce(lambda c, t: t.inverse(c), reversed(self.steps), x)


def map_array(values: Column, pipeline: Transform | Pipeline, inverse: bool = False) -> Column:
    """A fitted pipeline over each element of an array (null to null), or its inverse."""
    return F.transform(values, lambda x: pipeline.inverse(x) if inverse else pipeline.apply(x))


def transform_columns(df: DataFrame, pipelines: dict[str, Pipeline]) -> DataFrame:
    """Each column by its own pipeline, in place."""
    return df.withColumns({c: p.apply(F.col(c)) for c, p in pipelines.items()})


def match_derived(columns: Sequence[str], bases: Sequence[str]) -> dict[str, str]:
    """For each column that contains a base name: the longest such name."""
    out = {}
    for c in columns:
        inside = [b for b in bases if b in c]
        if inside:
            out[c] = max(inside, key=len)
    return out


def transform_derived(df: DataFrame, pipelines: dict[str, Pipeline], times: int = 1) -> DataFrame:
    """All columns whose names contain a base name, by the pipeline of the longest one, ``times`` over."""
    found = match_derived(df.columns, list(pipelines))
    new = {}
    for c, base in found.items():
        out = F.col(c)
        for _ in range(times):
            out = pipelines[base].apply(out)
        new[c] = out
    return df.withColumns(new) if new else df


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softmax(values: Column) -> Column:
    """Of an array, shifted by its largest value."""
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda s, w: s + w))
