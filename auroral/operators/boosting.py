"""Histogram boosting with own gradients and interaction constraints.

Rows are binned once and written down. A level of a round's trees is one pass over them: tasks sum quantised
gradients by (output, node, feature, bin) and Spark adds the sums up; the best split of each node is found by windows over the
bins, and only the splits, a row a node, come to the driver. Gradients are rounded to multiples of 2**-20, so
that sums are exact and the trees don't depend on how rows are dealt out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auroral.functions.transforms import sigmoid
from auroral.operators import metrics
from auroral.operators.trees import Forest, Tree, matrix
from auroral.series import checkpointed

UNIT = 1 << 20


@dataclass(frozen=True)
class Objective:
    """``gradients(label, margins)``: a (first, second) derivative for each output; ``loss`` of a row; margins is an array column."""

    gradients: Callable[[Column, Column], list[tuple[Column, Column]]]
    loss: Callable[[Column, Column], Column]
    outputs: int = 1


def squared() -> Objective:
    return Objective(lambda y, m: [(m[0] - y, F.lit(1.0))], lambda y, m: (y - m[0]) * (y - m[0]) / 2)


def absolute() -> Objective:
    return Objective(lambda y, m: [(F.signum(m[0] - y), F.lit(1.0))], lambda y, m: F.abs(y - m[0]))


def asymmetric(alpha: float = 2.0, beta: float = 1.0) -> Objective:
    return Objective(lambda y, m: [metrics.asymmetric_gradient(y, m[0], alpha, beta)], lambda y, m: metrics.asymmetric_loss(y, m[0], alpha, beta))


def logistic() -> Objective:
    p = lambda m: sigmoid(m[0])
    return Objective(lambda y, m: [(p(m) - y, F.greatest(p(m) * (1 - p(m)), F.lit(1e-6)))], lambda y, m: F.log1p(F.exp(-F.abs(m[0]))) + F.greatest(m[0], F.lit(0.0)) - y * m[0])


def focal(alpha: float = 0.25, gamma: float = 2.0) -> Objective:
    return Objective(lambda y, m: [metrics.focal_gradient(y, m[0], alpha, gamma)], lambda y, m: metrics.focal_loss(y, m[0], alpha, gamma))


def multiclass_focal(classes: int, gamma: float = 2.0, class_weights: Sequence[float] | None = None, exact: bool = False) -> Objective:
    """Labels 0 to classes - 1, an output for each class."""
    return Objective(lambda y, m: metrics.multiclass_focal_gradient(y, m, classes, gamma, class_weights, exact), lambda y, m: metrics.multiclass_focal_loss(y, m, classes, gamma), classes)


@dataclass(frozen=True)
class Settings:
    rounds: int = 50
    depth: int = 5
    rate: float = 0.1
    bins: int = 64
    penalty: float = 1.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    columns: float = 1.0
    rows: float = 1.0
    patience: int = 0
    seed: int = 42
    #: Rounds after which rows are written down with their margins.
    every: int = 10
    #: Nodes take their best split even where, by the penalty, it gains nothing.
    always: bool = False


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int = 64) -> list[list[float]]:
    """Ascending limits of at most ``bins`` bins for each feature, from approximate quantiles in one pass; [] where a feature has no value."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    clean = {f: F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")) for f in features}
    found = df.agg(*[F.percentile_approx(clean[f], shares, 10_000).alias(f"c{k}") for k, f in enumerate(features)]).first()
    return [sorted(set(found[k] or [])) for k in range(len(features))]


def allowed_features(path: frozenset[int], groups: Sequence[frozenset[int]] | None, n: int) -> frozenset[int]:
    """What may split a node below ``path``: its own features, and all groups that hold every one of them. At the root, all."""
    if groups is None or not path:
        return frozenset(range(n))
    return path.union(*[g for g in groups if path <= g])


def _binned(df: DataFrame, features: Sequence[str], cuts: list[list[float]], label: str, weight: Column, valid: Column, start: Sequence[float]) -> DataFrame:
    """(row, bins array<short>, label, weight, valid, margins): bin 0 is missing, bin b holds values up to cut b."""
    ready = df.select(*[F.col(f"`{f}`").cast("double").alias(f"_{k}") for k, f in enumerate(features)], F.col(f"`{label}`").cast("double").alias("label"), weight.cast("double").alias("weight"), valid.cast("boolean").alias("valid"))
    limits = [np.array(c, float) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, range(len(limits)))
            bins = np.column_stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(c, x[:, k], side="left")) for k, c in enumerate(limits)]) if len(x) else np.zeros((0, len(limits)))
            ends = pa.array(np.arange(len(x) + 1) * len(limits), pa.int32())
            margins = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(start), pa.int32()), pa.array(np.tile(np.array(start, float), len(x))))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(bins.ravel().astype(np.int16))), batch.column(len(limits)), batch.column(len(limits) + 1), batch.column(len(limits) + 2), margins], ["bins", "label", "weight", "valid", "margins"])

    rows = ready.where(F.col("label").isNotNull() & ~F.isnan("label") & (F.col("weight") > 0)).mapInArrow(run, "bins array<short>, label double, weight double, valid boolean, margins array<double>")
    return checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))


class Growing:
    """A tree over bins while it grows, by level."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.missing_left = [-1], [0], [-1], [-1], [False]
        self.g, self.h, self.cover = [0], [0], [0]
        self.path: list[frozenset[int]] = [frozenset()]
        self.open = [0]

    def split(self, node: int, feature: int, limit: int, missing_left: bool, sides: list[tuple[int, int, int]]) -> None:
        self.feature[node], self.bin[node], self.missing_left[node] = feature, limit, missing_left
        for place, (g, h, n) in zip((self.left, self.right), sides, strict=True):
            place[node] = len(self.feature)
            self.feature.append(-1)
            self.path.append(self.path[node] | {feature})
            for held, v in ((self.bin, 0), (self.left, -1), (self.right, -1), (self.missing_left, False), (self.g, g), (self.h, h), (self.cover, n)):
                held.append(v)

    def over_bins(self) -> Tree:
        """The tree whose thresholds are bins: a missing value is bin 0, which no threshold says where to put."""
        return Tree(np.array(self.feature), np.array(self.bin, float), np.array(self.left), np.array(self.right), np.zeros(len(self.feature)), np.array(self.cover, float), np.array(self.missing_left))

    def finished(self, cuts: list[list[float]], rate: float, penalty: float) -> Tree:
        at = [-1 if f < 0 else b for f, b in zip(self.feature, self.bin, strict=True)]
        limit = [0.0 if f < 0 else cuts[f][b - 1] if b <= len(cuts[f]) else math.inf for f, b in zip(self.feature, at, strict=True)]
        value = [-rate * g / (h + penalty * UNIT) if h + penalty * UNIT > 0 else 0.0 for g, h in zip(self.g, self.h, strict=True)]
        return Tree(np.array(self.feature), np.array(limit), np.array(self.left), np.array(self.right), np.array(value), np.array(self.cover, float), np.array(self.missing_left))


def _bin_matrix(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
    x[x == 0] = np.nan
    return x


def _advanced(rows: DataFrame, added: list[list[tuple[Tree, np.ndarray]]], width: int) -> DataFrame:
    """Margins after the rounds in ``added``: for each round a (tree over bins, leaf values) for each output."""
    if not added:
        return rows
    outputs = len(added[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("margins")
            x = _bin_matrix(batch.column("bins"), width)
            margins = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, outputs).copy()
            for trees in added:
                for k, (tree, value) in enumerate(trees):
                    margins[:, k] += value[tree.leaves(x)]
            changed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * outputs, pa.int32()), pa.array(margins.ravel()))
            yield batch.set_column(at, batch.schema.field(at).name, changed)

    return rows.mapInArrow(run, rows.schema)


def _histograms(rows: DataFrame, trees: list[Growing], used: Sequence[int], width: int, size: int) -> DataFrame:
    """(k, node, feature, bin, g, h, n) summed over all rows, for the open nodes of each output's tree and the features used. ``rows`` has bins and g0, h0, g1, ..."""
    held = [(t.over_bins(), np.array(t.open, np.int64)) for t in trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((3, len(nodes) * len(used) * size), np.int64) for _, nodes in held]
        for batch in batches:
            bins = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
            x = np.where(bins == 0, np.nan, bins)
            for k, (tree, nodes) in enumerate(held):
                if not len(nodes):
                    continue
                leaf = tree.leaves(x)
                place = np.full(len(tree.feature), -1)
                place[nodes] = np.arange(len(nodes))
                some = np.flatnonzero(place[leaf] >= 0)
                g, h = (np.rint(batch.column(1 + 2 * k + s).to_numpy(zero_copy_only=False)[some] * UNIT) for s in (0, 1))
                cell = ((place[leaf[some]][:, None] * len(used) + np.arange(len(used))) * size + bins[np.ix_(some, used)]).ravel()
                for s, v in enumerate((g, h, np.ones(len(some)))):
                    sums[k][s] += np.bincount(cell, weights=np.repeat(v, len(used)), minlength=sums[k].shape[1]).astype(np.int64)
        for k, (_, nodes) in enumerate(held):
            at = np.flatnonzero(sums[k][2]) if len(nodes) else np.zeros(0, np.int64)
            node, feature, b = at // (len(used) * size), at // size % len(used), at % size
            columns = [np.full(len(at), k), nodes[node] if len(nodes) else at, np.array(used)[feature], b]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), *(pa.array(sums[k][s][at], pa.int64()) for s in range(3))], ["k", "node", "feature", "bin", "g", "h", "n"])

    cells = rows.mapInArrow(run, "k int, node int, feature int, bin int, g long, h long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)").alias(c)  # noqa: E731  no overflow at any number of rows
    return cells.groupBy("k", "node", "feature", "bin").agg(wide("g"), wide("h"), F.sum("n").alias("n"))


def _best_splits(cells: DataFrame, allowed: DataFrame | None, settings: Settings) -> DataFrame:
    """The split of largest gain of each node (ties: lesser feature, then bin, then missing values to the right) that keeps rows on both sides."""
    by = Window.partitionBy("k", "node", "feature")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    if allowed is not None:
        cells = cells.join(F.broadcast(allowed), ["k", "node", "feature"])
    known = {c: F.when(F.col("bin") > 0, F.col(c)).otherwise(0) for c in ("g", "h", "n")}
    summed = cells.select("k", "node", "feature", "bin", *[F.sum(c).over(by).alias(f"{c}a") for c in "ghn"], *[F.sum(known[c]).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(F.col(c) - known[c]).over(by).alias(f"{c}0") for c in "ghn"])
    # a limit at the last bin parts known values from missing ones
    tried = summed.where("bin > 0").withColumn("left", F.explode(F.when(F.col("n0") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    side = {c: F.col(f"{c}l") + F.when(F.col("left") == 1, F.col(f"{c}0")).otherwise(0) for c in "ghn"}
    tried = tried.select("k", "node", "feature", "bin", "left", *[F.col(f"{c}a") for c in "ghn"], *[side[c].alias(f"{c}l") for c in "ghn"]).withColumns({f"{c}r": F.col(f"{c}a") - F.col(f"{c}l") for c in "ghn"})
    real = lambda c: F.col(c).cast("double") / UNIT
    score = lambda s: F.try_divide(real(f"g{s}") * real(f"g{s}"), real(f"h{s}") + settings.penalty)
    gain = (score("l") + score("r") - score("a")) / 2
    fit = (F.col("nl") > 0) & (F.col("nr") > 0) & (real("hl") >= settings.min_weight) & (real("hr") >= settings.min_weight)
    ranked = tried.where(fit).withColumn("gain", gain).where(F.col("gain").isNotNull() if settings.always else (F.col("gain") > settings.min_gain) & (F.col("gain") > 0))
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (-F.col("left")).alias("m"), "gl", "hl", "nl", "gr", "hr", "nr"))
    return ranked.groupBy("k", "node").agg(best.alias("s")).select("k", "node", "s.*")


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    objective: Objective | None = None,
    settings: Settings = Settings(),  # noqa: B008
    weight: str | None = None,
    validation: str | None = None,
    constraints: str | None = None,
    start: Sequence[float] | None = None,
    cuts: list[list[float]] | None = None,
    watch: Callable[[int, float], bool] | None = None,
    staged: Callable[[DataFrame], float] | None = None,
) -> Forest:
    """A forest for ``objective``. Missing values (null, NaN) go where they gain more; rows without a label or with no positive weight are left out.

    ``constraints`` are groups of feature numbers as interaction_constraints() writes them: a path uses features of one group only. With ``validation``
    (a boolean column; its rows aren't trained on) ``watch(round, loss)`` hears its loss each round and ends training by returning True, and
    ``patience`` rounds without a better one end it, too; the forest then has the rounds up to the best. With ``staged`` watch hears what that makes of
    the validation rows (label, weight, margins) instead. Jobs run while this is called.
    """
    objective = objective or squared()
    n = len(features)
    groups = [frozenset(g) for g in json.loads(constraints)] if constraints else None
    start = tuple(start or (0.0,) * objective.outputs)
    valid = F.coalesce(F.col(f"`{validation}`"), F.lit(False)) if validation else F.lit(False)
    cuts = cuts if cuts is not None else quantile_cuts(df.where(~valid), features, settings.bins)
    size = 2 + max([len(c) for c in cuts], default=0)
    written = _binned(df, features, cuts, label, F.col(f"`{weight}`") if weight else F.lit(1.0), valid, start)
    rng = np.random.default_rng(settings.seed)
    trees, since, best_loss, best_round = [], [], math.inf, 0
    spark = df.sparkSession
    for turn in range(settings.rounds):
        rows = _advanced(written, since, n)
        used = sorted(rng.choice(n, max(1, round(settings.columns * n)), replace=False).tolist()) if settings.columns < 1 else list(range(n))
        train_rows = rows.where("not valid")
        if settings.rows < 1:
            train_rows = train_rows.where(F.pmod(F.xxhash64(F.lit(settings.seed), F.lit(turn), "row"), F.lit(1 << 20)) < int(settings.rows * (1 << 20)))
        derived = objective.gradients(F.col("label"), F.col("margins"))
        ready = train_rows.select("bins", *[(c * F.col("weight")).alias(f"{s}{k}") for k, pair in enumerate(derived) for s, c in zip("gh", pair, strict=True)])
        grown = [Growing() for _ in range(objective.outputs)]
        for level in range(settings.depth):
            cells = _histograms(ready, grown, used, n, size)
            allowed = None
            if groups is not None and level:
                lines = [(k, node, f) for k, t in enumerate(grown) for node in t.open for f in allowed_features(t.path[node], groups, n)]
                allowed = spark.createDataFrame(lines, "k int, node int, feature int") if lines else None
            found = _best_splits(cells, allowed, settings).collect()
            for t in grown:
                t.open = []
            for s in sorted(found, key=lambda r: (r.k, r.node)):
                t = grown[s.k]
                if s.node == 0:
                    t.g[0], t.h[0], t.cover[0] = int(s.gl + s.gr), int(s.hl + s.hr), s.nl + s.nr
                first = len(t.feature)
                t.split(s.node, -s.f, -s.b, s.m == -1, [(int(s.gl), int(s.hl), s.nl), (int(s.gr), int(s.hr), s.nr)])
                t.open += [first, first + 1]
            if not any(t.open for t in grown):
                break
        if any(len(t.feature) == 1 for t in grown):  # a root without a split: its leaf needs its sums
            total = ready.agg(F.count("*").alias("n"), *[F.sum(F.rint(F.col(f"{s}{k}") * UNIT).cast("decimal(20,0)")).alias(f"{s}{k}") for k in range(len(grown)) for s in "gh"]).first()
            for k, t in enumerate(grown):
                if len(t.feature) == 1:
                    t.g[0], t.h[0], t.cover[0] = int(total[f"g{k}"] or 0), int(total[f"h{k}"] or 0), total.n
        done = [t.finished(cuts, settings.rate, settings.penalty) for t in grown]
        trees.append(done)
        since.append([(t.over_bins(), d.value) for t, d in zip(grown, done, strict=True)])
        if len(since) >= settings.every and turn + 1 < settings.rounds:
            written, since = checkpointed(_advanced(written, since, n)), []
        if validation:
            after = _advanced(written, since, n).where("valid")
            loss = None if staged and not settings.patience else after.agg((F.sum(objective.loss(F.col("label"), F.col("margins")) * F.col("weight")) / F.sum("weight")).alias("l")).first().l
            loss = math.inf if loss is None else loss
            if loss < best_loss:
                best_loss, best_round = loss, len(trees)
            if (watch and watch(turn, staged(after) if staged else loss)) or (settings.patience and len(trees) - best_round >= settings.patience):
                break
    kept = trees[:best_round] if validation and settings.patience else trees
    return Forest(tuple(features), tuple(t for round_ in kept for t in round_), tuple(k for round_ in kept for k in range(len(round_))), start)
