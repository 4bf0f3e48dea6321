"""Tuning studies: proposals from the density ratio of good and other trials, median pruning, several trials at once, a table of trials that a later run takes up.

A trial is a training run on Spark; the study itself is as small as its trials.
"""

from __future__ import annotations

import dataclasses
import json
import math
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import median

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auroral.operators import boosting
from auroral.operators.metrics import forecast_metrics
from auroral.operators.trees import Forest

SCHEMA = "number int, state string, value double, params string, steps array<struct<step: int, value: double>>, seconds double"


@dataclass(frozen=True)
class Range:
    """Numbers from low to high, on a logarithmic scale if ``log``, in whole steps if ``step`` is given."""

    low: float
    high: float
    log: bool = False
    step: int | None = None

    def inside(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    def outside(self, u: float) -> float:
        x = min(max(math.exp(u) if self.log else u, self.low), self.high)
        return int(min(self.low + round((x - self.low) / self.step) * self.step, self.high)) if self.step else x


@dataclass(frozen=True)
class Choice:
    values: tuple


Space = dict[str, Range | Choice]


@dataclass
class Trial:
    number: int
    params: dict
    state: str = "running"
    value: float | None = None
    steps: list[tuple[int, float]] = field(default_factory=list)
    seconds: float = 0.0


class Pruned(Exception):
    """Raised out of a trial that falls behind the others."""


def _density(x: np.ndarray, seen: np.ndarray, low: float, high: float) -> np.ndarray:
    """A mixture of normals at the values seen, as wide as the gaps between them, and one over the whole range."""
    centres = np.append(seen, (low + high) / 2)
    order = np.argsort(centres)
    edges = np.concatenate([[low], centres[order], [high]])
    widths = np.empty(len(centres))
    widths[order] = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
    widths = np.clip(widths, (high - low) / min(100, 1 + len(centres)), high - low)
    widths[-1] = high - low
    return (np.exp(-0.5 * ((x[:, None] - centres) / widths) ** 2) / widths).mean(1)


def propose(space: Space, trials: Sequence[Trial], rng: np.random.Generator, startup: int, candidates: int) -> dict:
    """Parameters of the next trial: random for the first ``startup``, then of ``candidates`` drawn around the best tenth those likeliest to be of it rather than of the rest."""
    told = sorted((t for t in trials if t.value is not None), key=lambda t: (t.state == "done", t.value), reverse=True)
    explore = len(told) < startup
    good = told[: max(1, math.ceil(0.1 * len(told)))]
    rest = told[len(good) :]
    out = {}
    for name, kind in space.items():
        if isinstance(kind, Choice):
            at = [[1 + sum(t.params.get(name) == v for t in some) for v in kind.values] for some in (good, rest)]
            share = [np.array(a, float) / sum(a) for a in at]
            if explore:
                out[name] = kind.values[int(rng.integers(len(kind.values)))]
            else:
                drawn = rng.choice(len(kind.values), candidates, p=share[0])
                out[name] = kind.values[int(max(drawn, key=lambda k: share[0][k] / share[1][k]))]
            continue
        low, high = kind.inside(kind.low), kind.inside(kind.high)
        if explore or low == high:
            out[name] = kind.outside(rng.uniform(low, high))
            continue
        seen = [np.array([kind.inside(t.params[name]) for t in some if name in t.params]) for some in (good, rest)]
        centres = np.append(seen[0], (low + high) / 2)
        drawn = rng.normal(rng.choice(centres, candidates), max((high - low) / (2 + len(seen[0])), (high - low) / 100))
        drawn = np.clip(drawn, low, high)
        out[name] = kind.outside(float(drawn[np.argmax(_density(drawn, seen[0], low, high) / _density(drawn, seen[1], low, high))]))
    return out


@dataclass
class Study:
    """Looks for the largest value. With ``path`` each trial that ends is written there, and trials found there count as this study's own."""

    spark: SparkSession
    space: Space
    path: str | None = None
    seed: int = 42
    startup: int = 20
    candidates: int = 24
    prune_after: int = 10
    warmup: int = 5
    interval: int = 5
    trials: list[Trial] = field(default_factory=list)

    def __post_init__(self):
        self._lock = threading.Lock()
        if self.path:
            for r in read_trials(self.spark, self.path).orderBy("number").collect():
                self.trials.append(Trial(r.number, json.loads(r.params), r.state, r.value, [(s.step, s.value) for s in r.steps], r.seconds))

    def _ask(self) -> Trial | None:
        """The next trial; none once a space of choices and steps has no point left that wasn't tried."""
        with self._lock:
            number = 1 + max((t.number for t in self.trials), default=-1)
            rng = np.random.default_rng((self.seed, number))
            tried = [t.params for t in self.trials]
            for attempt in range(200):
                params = propose(self.space, [t for t in self.trials if t.state in ("done", "pruned")], rng, self.startup if attempt < 20 else 10**9, self.candidates)
                if params not in tried:
                    trial = Trial(number, params)
                    self.trials.append(trial)
                    return trial
            return None

    def report(self, trial: Trial, step: int, value: float) -> None:
        """Notes a staged value; raises Pruned where the trial's best so far is below the median of what others had at this step."""
        trial.steps.append((step, float(value)))
        with self._lock:
            others = [dict(t.steps) for t in self.trials if t is not trial and t.state == "done"]
        at = [s[step] for s in others if step in s]
        if len(others) >= self.prune_after and at and step >= self.warmup and (step - self.warmup) % self.interval == 0 and max(v for _, v in trial.steps) < median(at):
            raise Pruned

    def _run(self, objective: Callable[[Trial, Study], float], deadline: float) -> bool:
        if time.monotonic() >= deadline:
            return False
        trial = self._ask()
        if trial is None:
            return False
        began = time.monotonic()
        try:
            trial.value, trial.state = float(objective(trial, self)), "done"
        except Pruned:
            trial.value, trial.state = (trial.steps[-1][1] if trial.steps else None), "pruned"
        except Exception:
            trial.state = "failed"
            raise
        finally:
            trial.seconds = time.monotonic() - began
            if self.path:
                trials_frame(self.spark, [trial]).coalesce(1).write.parquet(f"{self.path}/{trial.number}-{uuid.uuid4().hex}")  # a folder each: trials end at the same time
        return True

    def optimise(self, objective: Callable[[Trial, Study], float], trials: int, jobs: int = 1, timeout: float = math.inf) -> Trial | None:
        """Up to ``trials`` further trials, ``jobs`` at once; none begins after ``timeout`` seconds. Returns the best."""
        deadline = time.monotonic() + timeout
        if jobs == 1:
            for _ in range(trials):
                if not self._run(objective, deadline):
                    break
        else:
            with ThreadPoolExecutor(jobs) as pool:
                for done in [pool.submit(inheritable_thread_target(self.spark)(self._run), objective, deadline) for _ in range(trials)]:
                    done.result()
        return self.best

    @property
    def best(self) -> Trial | None:
        return max((t for t in self.trials if t.state == "done"), key=lambda t: (t.value, -t.number), default=None)


def trials_frame(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    return spark.createDataFrame([(t.number, t.state, t.value, json.dumps(t.params), t.steps, t.seconds) for t in trials], SCHEMA)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """(number, state, value, params, steps, seconds) of the trials at ``path``; no rows where there are none yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path}/*")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


#: Parameters of a forecast, with their ranges.
FORECAST_SPACE: Space = {
    "quiet_weight": Range(0.1, 1.5), "storm_weight": Range(2.0, 15.0), "rate": Range(0.01, 0.3, log=True), "rounds": Range(50, 500, step=50), "penalty": Range(1e-8, 10.0, log=True),
    "rows": Range(0.6, 1.0), "columns": Range(0.6, 1.0), "depth": Range(2, 15, step=1), "min_weight": Range(1, 10, step=1), "min_gain": Range(1e-8, 0.5, log=True),
}


def forecast_objective(df: DataFrame, features: Sequence[str], target: str, validation: str, threshold: float = -50, patience: int = 50, constraints: str | None = None, keep: dict[int, Forest] | None = None) -> Callable[[Trial, Study], float]:
    """Storm F1 on validation rows after each round is what a trial reports; its value is the best of them.

    Storm rows (below ``threshold``) and others get the trial's weights. Bins are cut once for all trials. ``keep`` takes each finished trial's forest.
    """
    cuts = boosting.quantile_cuts(df.where(~F.coalesce(F.col(f"`{validation}`"), F.lit(False))), features)

    def objective(trial: Trial, study: Study) -> float:
        params = dict(trial.params)
        storm, quiet = params.pop("storm_weight", 1.0), params.pop("quiet_weight", 1.0)
        weighted = df.withColumn("__weight", F.when(F.col(f"`{target}`") < threshold, storm).otherwise(quiet))
        scores: list[float] = []

        def staged(rows: DataFrame) -> float:
            got = forecast_metrics(rows.select("label", F.col("margins")[0].alias("p")), "label", "p", threshold).first()
            return got.f1_score or 0.0 if got else 0.0

        def watch(turn: int, score: float) -> bool:
            scores.append(score)
            study.report(trial, turn, score)
            return len(scores) - 1 - scores.index(max(scores)) >= patience

        settings = dataclasses.replace(boosting.Settings(), **params, patience=0)
        forest = boosting.train(weighted, features, target, settings=settings, weight="__weight", validation=validation, constraints=constraints, cuts=cuts, watch=watch, staged=staged)
        if keep is not None:
            keep[trial.number] = forest
        return max(scores, default=0.0)

    return objective
