"""Tuning studies, and what is saved and loaded."""

import math
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from auroral import catalogue
from auroral.functions import transforms as X
from auroral.operators import boosting, model, study, trees
from auroral.operators.study import Choice, Range, Study
from auroral.sources import artefacts
from tests.test_trees import by_subsets

SPACE = {"x": Range(-5, 5), "y": Range(1e-4, 1.0, log=True), "n": Range(2, 20, step=2), "c": Choice(("a", "b", "c"))}


def value(p):
    return -((p["x"] - 1) ** 2) - (math.log10(p["y"]) + 2) ** 2 - abs(p["n"] - 8) / 4 - (p["c"] != "b")


def test_proposals_stay_in_range_and_beat_random_ones(spark):
    best = []
    for startup in (15, 10**6):
        found = []
        for seed in range(6):
            s = Study(spark, SPACE, seed=seed, startup=startup)
            found.append(s.optimise(lambda t, _: value(t.params), 70).value)
            for t in s.trials:
                assert -5 <= t.params["x"] <= 5 and 1e-4 <= t.params["y"] <= 1 and t.params["n"] in range(2, 21, 2) and t.params["c"] in "abc"
        best.append(np.mean(found))
    assert best[0] > best[1]


def test_trials_behind_the_median_are_pruned(spark):
    s = Study(spark, {"x": Range(0, 1)}, prune_after=5, warmup=3, interval=2, startup=100)

    def objective(trial, st):
        for step in range(10):
            st.report(trial, step, trial.params["x"] * step)
        return trial.params["x"]

    s.optimise(objective, 30)
    pruned = [t for t in s.trials if t.state == "pruned"]
    assert pruned and all(len(t.steps) in (4, 6, 8, 10) and t.value == t.steps[-1][1] for t in pruned)
    assert [t.state for t in s.trials[:5]] == ["done"] * 5 and s.best.params["x"] == max(t.params["x"] for t in s.trials)


def test_a_resumed_study_goes_on_and_repeats_nothing(spark, tmp_path):
    space, path = {"c": Choice(tuple(range(6))), "n": Range(1, 2, step=1)}, str(tmp_path / "trials")
    first = Study(spark, space, path, startup=3)
    first.optimise(lambda t, _: t.params["c"] * t.params["n"], 5)
    again = Study(spark, space, path, startup=3)
    assert [t.params for t in again.trials] == [t.params for t in first.trials] and again.best.value == first.best.value
    again.optimise(lambda t, _: t.params["c"] * t.params["n"], 50)
    assert len(again.trials) == 12 == len({tuple(t.params.values()) for t in again.trials}) and again.best.value == 10
    assert study.read_trials(spark, path).count() == 12 and sorted(t.number for t in again.trials) == list(range(12))

    def fails(trial, _):
        raise RuntimeError

    other = Study(spark, {"x": Range(0, 1)}, str(tmp_path / "other"))
    with pytest.raises(RuntimeError):
        other.optimise(fails, 1)
    assert Study(spark, {"x": Range(0, 1)}, str(tmp_path / "other")).trials[0].state == "failed"


def test_several_at_once_and_a_time_limit(spark):
    together, most, lock = [0], [0], threading.Lock()

    def objective(trial, _):
        with lock:
            together[0] += 1
            most[0] = max(most[0], together[0])
        time.sleep(0.1)
        with lock:
            together[0] -= 1
        return trial.params["x"]

    s = Study(spark, {"x": Range(0, 1)})
    s.optimise(objective, 8, jobs=4)
    assert most[0] > 1 and len(s.trials) == 8 and all(t.state == "done" for t in s.trials)
    began = time.monotonic()
    s.optimise(objective, 1000, timeout=0.3)
    assert time.monotonic() - began < 5 and len(s.trials) < 40


def test_forecast_study_and_its_artefact(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = np.where(x[:, 0] > 0.5, -120.0, -10.0) + 5 * x[:, 1]
    df = spark.createDataFrame([(float(a), float(b), float(t), k % 3 == 0) for k, ((a, b), t) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, v boolean")
    forests = {}
    s = Study(spark, {"depth": Range(1, 2, step=1), "rate": Range(0.1, 0.5), "storm_weight": Range(2.0, 15.0), "rounds": Range(2, 3, step=1)}, str(tmp_path / "trials"), startup=2)
    best = s.optimise(study.forecast_objective(df, ["a", "b"], "y", "v", keep=forests), 2, jobs=2)
    assert best.value > 0.9 and all(0 < len(t.steps) <= 3 for t in s.trials)
    fitted = model.train_forecast(df, ["a", "b"], "y", rounds=2, depth=2)
    imputers = model.train_imputers(df.select("a", "y").withColumn("a", F.when(F.rand(1) > 0.2, F.col("a"))), 40, ("y",), min_rows=50, rounds=2, depth=2)
    pipeline = X.Pipeline((X.SignedLog(), X.YeoJohnson(), X.SinhArcsinh(0.1, 0.5), X.RobustScale((1.0, 99.0)), X.Clip(-9, 9))).fit(df, "y")
    path = str(tmp_path / "model")
    with pytest.raises(ValueError):
        artefacts.load(spark, path)
    assert artefacts.save(spark, path, {"forest": forests[best.number], "target": pipeline, "gbt": fitted, "note": {"k": [1, None]}, **{f"impute {c}": i for c, i in imputers.items()}}) == 1
    assert artefacts.save(spark, path, {"forest": forests[best.number], "only": 2}) == 2
    one, two = artefacts.load(spark, path, 1), artefacts.load(spark, path)
    assert set(two) == {"forest", "only"} and one["note"] == {"k": [1, None]} and one["target"] == pipeline and set(one) == {"forest", "target", "gbt", "note", *[f"impute {c}" for c in imputers]}
    assert trees.predict(one["forest"], df).collect() == trees.predict(forests[best.number], df).collect()
    assert model.predict(one["gbt"], df, ["a", "b"]).collect() == model.predict(fitted, df, ["a", "b"]).collect()
    assert df.select(one["target"].apply(F.col("y"))).collect() == df.select(pipeline.apply(F.col("y"))).collect()
    for c, i in imputers.items():
        again = one[f"impute {c}"]
        assert (again.features, again.r2, again.n_train) == (i.features, i.r2, i.n_train)
    with pytest.raises(ValueError):
        artefacts.load(spark, path, 7)


def test_registered_explanations_equal_enumeration(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    rows, names, fitted = catalogue._forecast(spark, folder)
    monkeypatch.setattr(catalogue, "_forecast", lambda *a: (rows, names, fitted))
    forest = trees.from_gbt(fitted, names, model.MISSING)
    held = {r.hour: np.array([math.nan if r[c] is None else r[c] for c in names], float) for r in rows.collect()}
    got = catalogue.queries()["contributions"](spark, folder).collect()
    assert len(got) == min(1000, len(held))
    for r in got[:4]:
        assert np.allclose(r.contributions, by_subsets(forest, held[r.hour], len(names))[0])
    pairs = np.abs(trees.shapley_pairs(forest, np.array(list(held.values())))).mean(0)
    assert np.allclose(trees.shapley_pairs(forest, held[got[0].hour][None])[0], by_subsets(forest, held[got[0].hour], len(names))[1])
    top = catalogue.queries()["interaction_top"](spark, folder).collect()
    assert len(top) == len(names) * (len(names) - 1)
    assert all(r.mean_abs == pytest.approx(pairs[names.index(r.feature), names.index(r.other)], abs=1e-9) for r in top)
    assert boosting.allowed_features(frozenset(), [frozenset({0})], 3) == {0, 1, 2}
