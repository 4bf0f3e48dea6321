"""Forests as arrays, and exact contributions of features and of pairs of features to their predictions.

A leaf's path names each feature once: ``zero`` is the share of training rows that pass the feature's conditions
where it isn't known, ``one`` is whether a row passes them. Over all subsets of known features the leaf's weight is a
polynomial in the subset's size, which grows by one factor (zero + one t) for each feature; dividing by a feature's factor
takes it out again. Vectors run over rows, so that a batch costs a few operations for each leaf and feature.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType

#: Rows whose contributions are computed at a time.
ROWS = 1024


@dataclass(frozen=True)
class Tree:
    """Nodes in an array, the root first: feature (-1 at a leaf), threshold (left if x <= it), children, value of a leaf, training rows, where missing values go."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    missing_left: np.ndarray

    def goes_left(self, x: np.ndarray, node: int) -> np.ndarray:
        v = x[:, self.feature[node]]
        return np.where(np.isnan(v), self.missing_left[node], v <= self.threshold[node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            v = x[inner, self.feature[node]]
            left = np.where(np.isnan(v), self.missing_left[node], v <= self.threshold[node])
            at[inner] = np.where(left, self.left[node], self.right[node])

    def paths(self) -> Iterator[tuple[float, list[int], list[float], list[list[tuple[int, bool]]]]]:
        """For each leaf: its value, the features on its path, the share that passes each, and each one's conditions (node, left)."""
        stack = [(0, {}, {})]
        while stack:
            node, zero, steps = stack.pop()
            f = int(self.feature[node])
            if f < 0:
                yield float(self.value[node]), list(zero), list(zero.values()), [steps[k] for k in zero]
                continue
            for child, left in ((int(self.left[node]), True), (int(self.right[node]), False)):
                share = self.cover[child] / self.cover[node]
                stack.append((child, zero | {f: zero.get(f, 1.0) * share}, steps | {f: [*steps.get(f, []), (node, left)]}))


@dataclass(frozen=True)
class Forest:
    """Trees that add up; ``output`` says to which of the outputs (classes) each adds, ``bias`` where each output starts."""

    features: tuple[str, ...]
    trees: tuple[Tree, ...]
    output: tuple[int, ...]
    bias: tuple[float, ...]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of the trees, rows x outputs; missing values are NaN."""
        out = np.tile(np.array(self.bias, float), (len(x), 1))
        for tree, k in zip(self.trees, self.output, strict=True):
            out[:, k] += tree.value[tree.leaves(x)]
        return out

    def expected(self, output: int = 0) -> float:
        """The mean over training rows as the trees know them: what a row is predicted of which nothing is known."""
        return self.bias[output] + sum(v * math.prod(zero) for t, k in zip(self.trees, self.output, strict=True) if k == output for v, _, zero, _ in t.paths())

    def to_json(self) -> str:
        trees = [{k: getattr(t, k).tolist() for k in Tree.__dataclass_fields__} for t in self.trees]
        return json.dumps({"features": self.features, "trees": trees, "output": self.output, "bias": self.bias})

    @classmethod
    def from_json(cls, text: str) -> Forest:
        said = json.loads(text)
        kinds = {"feature": np.int64, "left": np.int64, "right": np.int64, "missing_left": bool}
        trees = [Tree(**{k: np.array(v, kinds.get(k, float)) for k, v in t.items()}) for t in said["trees"]]
        return cls(tuple(said["features"]), tuple(trees), tuple(said["output"]), tuple(said["bias"]))


def from_gbt(model: GBTRegressionModel, features: Sequence[str], missing: float) -> Forest:
    """A model trained on assembled values and missing flags as a forest over ``features`` alone: a flag is a condition on its own feature."""
    n, trees = len(features), []
    for weight, one in zip(model.treeWeights, model.trees, strict=True):
        rows = []

        def walk(node) -> int:
            at = len(rows)
            rows.append(None)
            cover = float(node.impurityStats().count())
            if node.subtreeDepth() == 0:
                rows[at] = (-1, 0.0, -1, -1, weight * node.prediction(), cover, False)  # noqa: B023
                return at
            k, threshold = node.split().featureIndex(), float(node.split().threshold())
            left, right = walk(node.leftChild()), walk(node.rightChild())
            # known values have flag 0: they go where 0 <= threshold sends them, missing ones (flag 1) the other way
            rows[at] = (k, threshold, left, right, 0.0, cover, missing <= threshold) if k < n else (k - n, math.inf if threshold >= 0 else -math.inf, left, right, 0.0, cover, threshold >= 1)
            return at

        walk(one._call_java("rootNode"))
        columns = list(zip(*rows, strict=True))
        trees.append(Tree(*(np.array(c, kind) for c, kind in zip(columns, (np.int64, float, np.int64, np.int64, float, float, bool), strict=True))))
    return Forest(tuple(features), tuple(trees), (0,) * len(trees), (0.0,))


def _extend(one: np.ndarray, zero: Sequence[float]) -> np.ndarray:
    """Coefficients (size, rows) of the product of zero + one t over all features."""
    c = np.zeros((len(zero) + 1, one.shape[1]))
    c[0] = 1.0
    for k, z in enumerate(zero):
        c[1 : k + 2] = z * c[1 : k + 2] + one[k] * c[: k + 1]
        c[0] *= z
    return c


def _unwind(c: np.ndarray, one: np.ndarray, zero: float) -> np.ndarray:
    """The coefficients without the factor zero + one t (one is 0 or 1, zero is positive)."""
    down = np.empty((len(c) - 1, c.shape[1]))
    down[-1] = c[-1]
    for s in range(len(c) - 2, 0, -1):
        down[s - 1] = c[s] - zero * down[s]
    return np.where(one > 0, down, c[:-1] / zero)


def _subset_weights(d: int) -> np.ndarray:
    """s! (d - 1 - s)! / d! for subsets of s of the other d - 1 features."""
    return np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])


def _passed(tree: Tree, x: np.ndarray) -> dict[int, np.ndarray]:
    return {int(n): tree.goes_left(x, n) for n in np.flatnonzero(tree.feature >= 0)}


def _ones(left: dict[int, np.ndarray], steps: list[list[tuple[int, bool]]], n: int) -> np.ndarray:
    """Whether each row passes each feature's conditions, features x rows."""
    out = np.ones((len(steps), n))
    for k, conditions in enumerate(steps):
        for node, to_left in conditions:
            out[k] *= left[node] if to_left else ~left[node]
    return out


def shapley(forest: Forest, x: np.ndarray, output: int = 0) -> np.ndarray:
    """Contributions, rows x features: with expected() they sum to the margin."""
    out = np.zeros((len(x), len(forest.features)))
    for tree, k in zip(forest.trees, forest.output, strict=True):
        if k != output:
            continue
        left = _passed(tree, x)
        for value, features, zero, steps in tree.paths():
            if not features:
                continue
            one = _ones(left, steps, len(x))
            c, weights = _extend(one, zero), _subset_weights(len(features))
            for j, f in enumerate(features):
                out[:, f] += value * (one[j] - zero[j]) * (weights @ _unwind(c, one[j], zero[j]))
    return out


def shapley_pairs(forest: Forest, x: np.ndarray, output: int = 0) -> np.ndarray:
    """Interaction values, rows x features x features: symmetric, a row sums to the feature's contribution.

    Off the diagonal: half of how much one feature's contribution changes when the other becomes known.
    """
    n = len(forest.features)
    out = np.zeros((len(x), n, n))
    for tree, k in zip(forest.trees, forest.output, strict=True):
        if k != output:
            continue
        left = _passed(tree, x)
        for value, features, zero, steps in tree.paths():
            if len(features) < 2:
                continue
            one = _ones(left, steps, len(x))
            c, weights = _extend(one, zero), _subset_weights(len(features) - 1)
            for i, f in enumerate(features):
                without = _unwind(c, one[i], zero[i])
                for j in range(i + 1, len(features)):
                    both = value * (one[i] - zero[i]) * (one[j] - zero[j]) / 2 * (weights @ _unwind(without, one[j], zero[j]))
                    out[:, f, features[j]] += both
                    out[:, features[j], f] += both
    diagonal = np.arange(n)
    out[:, diagonal, diagonal] = shapley(forest, x, output) - out.sum(2)
    return out


def sample(df: DataFrame, key: str, rows: int = 1000, seed: int = 123) -> DataFrame:
    """At most ``rows`` rows, those of least hash of the key: the same whatever the partitioning. Explanations are of a sample, as their cost is by row, tree and leaf."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(rows)


def matrix(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    """Rows x features of doubles, nulls as NaN."""
    return np.column_stack([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in columns]) if batch.num_rows else np.zeros((0, len(columns)))


def _mapped(forest: Forest, df: DataFrame, added: dict[str, DataType], make, rows: int = ROWS) -> DataFrame:
    """``df`` with columns that ``make(x)`` returns as arrays."""
    places = [df.columns.index(f) for f in forest.features]
    schema = df.select("*").schema
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                some = batch.slice(lo, rows)
                yield pa.RecordBatch.from_arrays([*some.columns, *make(matrix(some, places))], schema.names)

    return df.mapInArrow(run, schema)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def predict(forest: Forest, df: DataFrame, name: str = "margins") -> DataFrame:
    """``df`` with ``name``, an array of the forest's outputs before any link."""
    return _mapped(forest, df, {name: ArrayType(DoubleType())}, lambda x: [_lists(forest.margins(x))], 1 << 14)


def contributions(forest: Forest, df: DataFrame, name: str = "contributions", output: int = 0) -> DataFrame:
    """``df`` with ``name``, each feature's contribution in the forest's order, and ``bias``; together they sum to the margin."""
    bias = forest.expected(output)
    return _mapped(forest, df, {name: ArrayType(DoubleType()), "bias": DoubleType()}, lambda x: [_lists(shapley(forest, x, output)), pa.array(np.full(len(x), bias))])


def mean_contributions(forest: Forest, df: DataFrame, output: int = 0) -> DataFrame:
    """(feature, mean_abs, mean): how much and in which direction each feature moves predictions, for a ranked plot."""
    shown = contributions(forest, df, "__c", output).select(F.posexplode("__c").alias("k", "c"))
    names = F.array(*[F.lit(f) for f in forest.features])
    return shown.groupBy("k").agg(F.avg(F.abs("c")).alias("mean_abs"), F.avg("c").alias("mean")).select(names[F.col("k")].alias("feature"), "mean_abs", "mean")


def interaction_strengths(forest: Forest, df: DataFrame, output: int = 0, rows: int = 64) -> DataFrame:
    """(feature, other, mean_abs) for all pairs, the diagonal included: mean absolute interaction values. Tasks add up before anything is moved."""
    n = len(forest.features)
    places = [df.columns.index(f) for f in forest.features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((n, n)), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                x = matrix(batch.slice(lo, rows), places)
                total += np.abs(shapley_pairs(forest, x, output)).sum(0)
                count += len(x)
        if count:
            i, j = (a.ravel() for a in np.indices((n, n)))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel()), pa.array(np.full(n * n, count), pa.int64())], ["i", "j", "total", "n"])

    added = df.mapInArrow(run, "i int, j int, total double, n long").groupBy("i", "j").agg((F.sum("total") / F.sum("n")).alias("mean_abs"))
    names = F.array(*[F.lit(f) for f in forest.features])
    return added.select(names[F.col("i")].alias("feature"), names[F.col("j")].alias("other"), "mean_abs")


def top_interactions(strengths: DataFrame, k: int = 10) -> DataFrame:
    """(feature, other, mean_abs, rank): the pairs among the ``k`` features that interact most with all others, by falling strength and name; no diagonal."""
    apart = strengths.where("feature <> other")
    best = apart.groupBy("feature").agg(F.sum("mean_abs").alias("s")).orderBy(F.desc("s"), "feature").limit(k)  # k rows
    ranked = best.agg(F.collect_list(F.struct((-F.col("s")).alias("s"), "feature")).alias("x")).select(F.posexplode(F.array_sort("x")).alias("p", "x")).select(F.col("x.feature").alias("feature"), (F.col("p") + 1).alias("rank"))
    return apart.join(F.broadcast(ranked), "feature").join(F.broadcast(ranked.select(F.col("feature").alias("other"))), "other").select("feature", "other", "mean_abs", "rank")


def ice(forest: Forest, df: DataFrame, feature: str, points: int = 60, output: int = 0) -> DataFrame:
    """(value, mean, q25, q75): predictions of all rows of ``df`` with ``feature`` set to each of a grid from its 1st to its 99th percentile. Take a sample() of large tables."""
    low, high = df.agg(F.percentile(F.col(f"`{feature}`"), F.array(F.lit(0.01), F.lit(0.99))).alias("q")).first()["q"] or (None, None)
    grid = F.array(*[F.lit(low + (high - low) * k / (points - 1)) for k in range(points)]) if low is not None else F.expr("cast(array() as array<double>)")
    shown = predict(forest, df.withColumn(feature, F.explode(grid)), "__m").select(F.col(f"`{feature}`").alias("value"), F.col("__m")[output].alias("p"))
    return shown.groupBy("value").agg(F.avg("p").alias("mean"), F.percentile("p", 0.25).alias("q25"), F.percentile("p", 0.75).alias("q75"))
