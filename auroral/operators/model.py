"""Imputation and forecast models on boosted trees, tuning, and what explains them.

Missing inputs become a constant far outside the data next to a flag, which trees split off.
"""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auroral.operators.metrics import forecast_metrics
from auroral.series import checkpointed

MISSING = -1e6


def assemble(df: DataFrame, columns: list[str], name: str = "_features") -> DataFrame:
    """``name``: a vector of the columns, nulls replaced, followed by a flag for each of them."""
    parts = {f"_v{k}": F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(MISSING)) for k, c in enumerate(columns)}
    parts |= {f"_m{k}": F.col(f"`{c}`").isNull().cast("double") for k, c in enumerate(columns)}
    return VectorAssembler(inputCols=list(parts), outputCol=name).transform(df.withColumns(parts)).drop(*parts)


@dataclass(frozen=True)
class Imputer:
    model: GBTRegressionModel
    features: list[str]
    r2: float
    mse: float
    n_train: int


def _enough(columns: list[str], of: int, min_percent: float) -> Column:
    known = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns[1:]), F.col(f"`{columns[0]}`").isNotNull().cast("int"))
    return known >= int(of * min_percent / 100)


def train_imputers(df: DataFrame, min_percent: float = 70.0, exclude: tuple[str, ...] = (), min_rows: int = 100, rounds: int = 20, depth: int = 5, seed: int = 42) -> dict[str, Imputer]:
    """A model for each column on rows where it and enough others are known (the share counts all columns); columns with fewer than ``min_rows`` of them get none. Rows are written down once."""
    columns = [c for c in df.columns if c not in exclude]
    width = len(df.columns)
    others = {t: [c for c in columns if c != t] for t in columns if len(columns) > 1}
    if not others:
        return {}
    fit = {t: F.col(f"`{t}`").isNotNull() & _enough(features, width, min_percent) for t, features in others.items()}
    held = checkpointed(df.select(*[F.col(f"`{c}`") for c in columns]))  # read once for each column, made once
    counts = held.agg(*[F.count_if(c).alias(f"n{k}") for k, c in enumerate(fit.values())]).first()
    out = {}
    for k, (target, features) in enumerate(others.items()):
        if counts[f"n{k}"] < min_rows:
            continue
        ready = assemble(held.where(fit[target]), features).select("_features", F.col(f"`{target}`").cast("double").alias("_label"))
        model = GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol="_p", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed).fit(ready)
        e = model.transform(ready).agg(F.avg((F.col("_p") - F.col("_label")) ** 2).alias("mse"), F.var_pop("_label").alias("v")).first()
        out[target] = Imputer(model, features, 1 - e.mse / e.v if e.v else 0.0, e.mse, counts[f"n{k}"])
    return out


def impute(df: DataFrame, imputers: dict[str, Imputer], min_percent: float = 70.0) -> DataFrame:
    """Fills nulls of each column in turn, where enough others are known; a column filled earlier feeds the later ones."""
    names, n = df.columns, len(df.columns)
    for target, imputer in imputers.items():
        shown = imputer.model.setPredictionCol("_p").transform(assemble(df, imputer.features))
        guess = F.when(_enough(imputer.features, n, min_percent), F.col("_p"))
        df = shown.withColumn(target, F.coalesce(F.col(f"`{target}`"), guess)).select(*[F.col(f"`{c}`") for c in names])
    return df


def train_forecast(df: DataFrame, features: list[str], target: str, weight: str | None = None, validation: str | None = None, rounds: int = 50, depth: int = 5, rate: float = 0.1, seed: int = 42, loss: str = "absolute") -> GBTRegressionModel:
    """Boosted trees on rows with a target; with ``validation`` (a boolean column) rounds end when its error stops falling."""
    rows = assemble(df.where(F.col(f"`{target}`").isNotNull()), features).withColumn("_label", F.col(f"`{target}`").cast("double"))
    trainer = GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol="prediction", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, lossType=loss)
    if weight:
        trainer = trainer.setWeightCol(weight)
    if validation:
        trainer = trainer.setValidationIndicatorCol(validation)
    return trainer.fit(rows)


def predict(model: GBTRegressionModel, df: DataFrame, features: list[str], name: str = "prediction") -> DataFrame:
    return model.setPredictionCol(name).transform(assemble(df, features)).drop("_features")


def tune(df: DataFrame, features: list[str], target: str, validation: str, space: dict[str, list], trials: int = 10, threshold: float = -50, seed: int = 42) -> list[dict]:
    """Random search over a space of train_forecast() parameters; trials with their storm F1 on validation rows, best first."""
    points = list(itertools.product(*space.values()))
    chosen = random.Random(seed).sample(points, min(trials, len(points)))
    out = []
    for point in chosen:
        params = dict(zip(space, point, strict=True))
        model = train_forecast(df.where(~F.col(validation)), features, target, **params)
        score = forecast_metrics(predict(model, df.where(validation), features), target, "prediction", threshold).first()
        out.append({**params, "f1": score.f1_score if score else 0.0, "mae": score.mae if score else None})
    return sorted(out, key=lambda t: -t["f1"])


def importances(model: GBTRegressionModel, features: list[str]) -> list[tuple[str, float]]:
    """Each feature's share of the gain (with its missing flag's), largest first."""
    values = model.featureImportances.toArray()
    n = len(features)
    return sorted(((f, float(values[k] + values[n + k])) for k, f in enumerate(features)), key=lambda x: -x[1])


def ice_curve(model: GBTRegressionModel, df: DataFrame, features: list[str], feature: str, key: str, rows: int = 200, points: int = 60, seed: int = 0) -> DataFrame:
    """(value, mean, q25, q75): predictions of a bounded sample of rows with ``feature`` set to each of a grid from its 1st to 99th percentile."""
    low, high = df.agg(F.percentile(F.col(f"`{feature}`"), F.array(F.lit(0.01), F.lit(0.99))).alias("q")).first()["q"] or (None, None)
    sample = df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(rows)
    grid = F.array(*[F.lit(low + (high - low) * k / (points - 1)) for k in range(points)]) if low is not None else F.expr("cast(array() as array<double>)")
    shown = predict(model, sample.drop(feature).withColumn(feature, F.explode(grid)), features)
    return shown.groupBy(F.col(f"`{feature}`").alias("value")).agg(F.avg("prediction").alias("mean"), F.percentile("prediction", 0.25).alias("q25"), F.percentile("prediction", 0.75).alias("q75"))


def path_contributions(model: GBTRegressionModel, df: DataFrame, features: list[str], name: str = "contributions") -> DataFrame:
    """``name``: an array of what each feature (and missing flag) adds to the prediction, by the change of a tree's mean along its path; with ``bias`` they sum to it.

    The trees are walked as expressions, so no row leaves the JVM.
    """
    trees = [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    width = 2 * len(features)

    def walk(node, weight: float, sums: list[float]) -> Column:
        if node.subtreeDepth() == 0:
            return F.array(*[F.lit(float(s)) for s in sums])
        k = node.split().featureIndex()
        left, right = node.leftChild(), node.rightChild()
        step = lambda child: [s + weight * (child.prediction() - node.prediction()) if j == k else s for j, s in enumerate(sums)]
        return F.when(F.element_at("_x", k + 1) <= node.split().threshold(), walk(left, weight, step(left))).otherwise(walk(right, weight, step(right)))

    ready = assemble(df, features).withColumn("_x", vector_to_array("_features"))
    total = F.array(*[F.lit(0.0)] * width)
    for weight, root in trees:
        total = F.zip_with(total, walk(root, weight, [0.0] * width), lambda a, b: a + b)
    bias = sum(w * r.prediction() for w, r in trees)
    return ready.withColumns({name: total, "bias": F.lit(float(bias))}).drop("_x", "_features")
