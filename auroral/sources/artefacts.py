"""Fitted transforms, imputers, forests and models as one versioned artefact in any folder that Spark can write."""

from __future__ import annotations

import dataclasses
import json
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auroral.functions import transforms
from auroral.operators.model import Imputer
from auroral.operators.trees import Forest

_TRANSFORMS = {c.__name__: c for c in (transforms.Clip, transforms.SignedLog, transforms.SinhArcsinh, transforms.YeoJohnson, transforms.RobustScale)}
SCHEMA = "version int, id string, name string, kind string, payload string"


def _transform_out(t: transforms.Transform | transforms.Pipeline) -> dict:
    if isinstance(t, transforms.Pipeline):
        return {"kind": "Pipeline", "steps": [_transform_out(s) for s in t.steps]}
    if type(t).__name__ not in _TRANSFORMS:
        raise ValueError(f"{type(t).__name__} can't be saved")
    return {"kind": type(t).__name__, **dataclasses.asdict(t)}


def _transform_in(said: dict) -> transforms.Transform | transforms.Pipeline:
    said = dict(said)
    kind = said.pop("kind")
    if kind == "Pipeline":
        return transforms.Pipeline(tuple(_transform_in(s) for s in said["steps"]))
    return _TRANSFORMS[kind](**{k: tuple(v) if isinstance(v, list) else v for k, v in said.items()})


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, id, name, kind, payload) of everything saved at ``path``; no rows where nothing was."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path}/manifest/*")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def save(spark: SparkSession, path: str, parts: dict[str, Any]) -> int:
    """Saves the parts under their names as the next version and returns its number.

    Parts are transforms and pipelines, forests, Spark's boosted trees, imputers, and what JSON can say. Trees of Spark are written first and the
    manifest last, in one write: a version is there with all its parts or not at all. Of two writers that take the same number, load() sees one, whole.
    """
    found = versions(spark, path).agg(F.max("version")).first()[0]
    version, made = (found or 0) + 1, uuid.uuid4().hex
    rows = []

    def model_at(name: str, model: GBTRegressionModel) -> str:
        where = f"models/{made}/{name}"
        model.write().save(f"{path}/{where}")
        return where

    for k, (name, part) in enumerate(parts.items()):
        if isinstance(part, Forest):
            kind, said = "forest", part.to_json()
        elif isinstance(part, transforms.Transform | transforms.Pipeline):
            kind, said = "transform", json.dumps(_transform_out(part))
        elif isinstance(part, GBTRegressionModel):
            kind, said = "gbt", model_at(f"{k}", part)
        elif isinstance(part, Imputer):
            kind, said = "imputer", json.dumps({"model": model_at(f"{k}", part.model), "features": part.features, "r2": part.r2, "mse": part.mse, "n_train": part.n_train})
        else:
            kind, said = "json", json.dumps(part)
        rows.append((version, made, name, kind, said))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/manifest/{made}")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> dict[str, Any]:
    """The parts of a version, the last one by default. ValueError where there is none."""
    held = versions(spark, path)
    held = held.where(F.col("version") == version) if version is not None else held.join(F.broadcast(held.agg(F.max("version").alias("version"))), "version")
    rows = held.collect()
    if not rows:
        raise ValueError(f"no version {'' if version is None else version} at {path}")
    one = max(r.id for r in rows)
    out: dict[str, Any] = {}
    for r in rows:
        if r.id != one:
            continue
        if r.kind == "forest":
            out[r.name] = Forest.from_json(r.payload)
        elif r.kind == "transform":
            out[r.name] = _transform_in(json.loads(r.payload))
        elif r.kind == "gbt":
            out[r.name] = GBTRegressionModel.load(f"{path}/{r.payload}")
        elif r.kind == "imputer":
            said = json.loads(r.payload)
            out[r.name] = Imputer(GBTRegressionModel.load(f"{path}/{said.pop('model')}"), **said)
        else:
            out[r.name] = json.loads(r.payload)
    return out
