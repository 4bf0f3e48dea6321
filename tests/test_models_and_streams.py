"""Models, constraint groups and the streaming operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auroral import catalogue
from auroral.operators import model
from auroral.plans import grouping
from auroral.streaming import causal


def test_imputation_and_contributions(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(a), None if k % 10 == 0 else float(3 * a + b), float(b)) for k, (a, b) in enumerate(zip(rng.random(300), rng.random(300), strict=True))]
    df = spark.createDataFrame(rows, "t int, a double, y double, b double")
    assert model.train_imputers(df, 40, ("t", "a", "b"), rounds=5, depth=3) == {}
    imputers = model.train_imputers(df, 40, ("t",), rounds=8, depth=3)
    filled = model.impute(df, {"y": imputers["y"]}, 40)
    assert filled.where("y is null").count() == 0 and imputers["y"].r2 > 0.5
    fitted = model.train_forecast(df, ["a", "b"], "y", rounds=4, depth=2)
    for r in model.path_contributions(fitted, model.predict(fitted, df, ["a", "b"]), ["a", "b"]).collect():
        assert r.bias + sum(r.contributions) == pytest.approx(r.prediction)
    assert sum(v for _, v in model.importances(fitted, ["a", "b"])) == pytest.approx(1)
    assert model.ice_curve(fitted, df, ["a", "b"], "a", "t", 20, 10).count() == 10
    trials = model.tune(df.withColumn("valid", F.col("t") % 5 == 0), ["a", "b"], "y", "valid", {"depth": [1, 2], "rounds": [2]}, trials=2)
    assert len(trials) == 2 and trials[0]["f1"] >= trials[1]["f1"]


def test_constraints():
    names = ["BZ, nT (GSM)", "BZ, nT (GSM)_lag_4", "Plasma Beta", "conv_a", "conv_b", "energy_loading_state", "recovery_state"]
    assert grouping.interaction_constraints(names, "physics") == "[[0, 1], [5, 6]]"
    assert grouping.interaction_constraints(names, "engineering") == "[[3, 4, 0, 2], [5, 6, 0, 2]]"
    assert grouping.interaction_constraints(names, "hybrid") == "[[0, 1], [5, 6], [0, 1, 5, 6], [2, 5, 6]]"
    assert grouping.interaction_constraints(["z"], "parameter_only") is None
    with pytest.raises(ValueError):
        grouping.interaction_constraints(names, "none")


def stream_of(spark, folder, batches, **options):
    """What comes out where each list of rows is a batch; the last batch is far in the future, so that all others are told."""
    for k, rows in enumerate([*batches, [("end", "2030-01-01 00:00:00", 0, 0.0)], [("end", "2030-01-02 00:00:00", 0, 0.0)]]):
        spark.createDataFrame(rows, "s string, t string, k long, x double").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").json(f"{folder}/in")
        source = spark.readStream.schema("s string, t timestamp, k long, x double").json(f"{folder}/in")
        features = causal.causal_features(source, "s", "t", "x", lags=(1,), window=3, tie="k", **options)
        query = features.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = spark.read.parquet(f"{folder}/out").where("s <> 'end' or s is null").collect()
    return sorted(((r.s or "", str(r.t), r.x, r.lag_1, r["mean"], r.conv, r.state) for r in got), key=str)


def test_a_stream_cut_anyhow_gives_the_rows_of_one_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(s, f"2024-01-01 00:{m:02d}:00", k, float(rng.integers(0, 9))) for s in ("a", None) for m in range(20) for k in range(2 if m % 5 == 0 else 1)]
    one = stream_of(spark, str(tmp_path / "one"), [rows])
    order = [rows[i] for i in np.argsort([r[1] for r in rows], kind="stable")]
    order[3:9] = order[3:9][::-1]  # out of order, but not late
    some = stream_of(spark, str(tmp_path / "some"), [order[:5], order[5:6], order[6:31], order[31:]])
    assert one == some and len(one) == len(rows)
    x = [r[3] for r in sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[1], r[2]))]
    a = [r for r in one if r[0] == "a"]
    assert sorted(r[2] for r in a) == sorted(x)
    by_time = {}
    for k, r in enumerate(sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[1], r[2]))):
        by_time.setdefault(r[1], []).append((x[k - 1] if k else None, float(np.mean(x[max(0, k - 2) : k + 1]))))
    for t, want in by_time.items():
        assert sorted(((r[3], r[4]) for r in a if r[1] == t), key=str) == sorted(want, key=str)


def test_late_rows_are_left_out_and_idle_series_forgotten(spark, tmp_path):
    first, late = [("a", "2024-01-01 00:00:00", 0, 1.0), ("a", "2024-01-01 00:01:00", 0, 2.0), ("b", "2024-01-02 00:00:00", 0, 5.0)], [("a", "2024-01-01 00:00:30", 0, 9.0), ("b", "2024-01-03 00:00:00", 0, 6.0)]
    again = [("a", "2024-01-04 00:00:00", 0, 3.0)]
    for idle, before in ((None, 2.0), (3600, None)):
        got = stream_of(spark, str(tmp_path / f"idle{idle}"), [first, late, again], idle_seconds=idle)
        a = [r for r in got if r[0] == "a"]
        assert [r[2] for r in a] == [1.0, 2.0, 3.0] and a[-1][3] == before


def test_ice_query_takes_the_rows_and_points_of_the_reference(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "_forecast", lambda *a: (None, ["v"], None))
    monkeypatch.setattr(model, "ice_curve", lambda fitted, rows, names, feature, key, n, points: (n, points))
    n, points = catalogue.ice_curve(spark, "")
    assert n >= 300 and points >= 60


def test_forecast_frame_has_177_columns(spark):
    from pyspark.sql import functions as F

    from auroral.plans import features as P
    from auroral.series import Series

    measured = ["Vector B Magnitude,nT", "Lat. Angle of B (GSE)", "Long. Angle of B (GSE)", P.BX, P.BY, P.BZ, P.B, P.SPEED, P.DENSITY, P.TEMPERATURE, P.BETA, P.PRESSURE, P.FIELD, "Magnetosonic Much num.", P.DST, P.AE, P.ALPHA]
    rows = spark.range(40).select(F.col("id").alias("full_date"), *[(F.sin(F.col("id") * (k + 1)) * 50 + k).alias(c) for k, c in enumerate(measured)], F.lit(24).alias("solar_cycle"), F.lit("max").alias("solar_phase"))
    out = P.forecast_frame(Series(rows, ("full_date",))).df
    assert len(out.columns) == len(set(out.columns)) == 177
    assert {"Alpha/Prot. ratio_std_24r_lag_4", "Alpha/Prot. ratio_lag_12", f"{P.BY}_lag_8", f"{P.PRESSURE}_lag_4", "conv_compression_long_Flow_pressure", f"{P.BETA}_embedding_2d_turn_var"} <= set(out.columns)
    assert not {P.AE, P.BX, "Lat. Angle of B (GSE)", f"{P.PRESSURE}_lag_12", f"{P.ALPHA}_lag_4"} & set(out.columns)
    assert out.count() == 36


def test_earlier_features_move_columns_by_compound_lags(spark):
    from auroral.plans import features as P
    from auroral.series import Series

    measured = ["Vector B Magnitude,nT", "Lat. Angle of B (GSE)", "Long. Angle of B (GSE)", P.BX, P.BY, P.BZ, P.B, P.SPEED, P.DENSITY, P.TEMPERATURE, P.BETA, P.PRESSURE, P.FIELD, "Magnetosonic Much num.", P.DST, P.AE, P.ALPHA]
    rows = spark.range(60).select(F.col("id").alias("full_date"), *[(F.sin(F.col("id") * (k + 1)) * 50 + k).alias(c) for k, c in enumerate(measured)])
    series = Series(rows, ("full_date",))
    got = P.earlier_features(series, trend=False).df.orderBy("full_date").collect()
    raw = rows.orderBy("full_date").collect()
    states = P.magnetosphere(Series(P.undotted(rows), ("full_date",))).df.orderBy("full_date").collect()
    signed = lambda x: np.sign(x) * np.log1p(abs(x))
    for t in range(60):
        assert got[t][P.BZ] == (pytest.approx(signed(raw[t - 4][P.BZ])) if t >= 4 else None)
        assert got[t][f"{P.BZ}_lag_8"] == (pytest.approx(signed(raw[t - 12][P.BZ])) if t >= 12 else None)
        assert got[t][P.BY] == (pytest.approx(signed(raw[t - 4][P.BY])) if t >= 4 else None)
        before = states[t - 4][P.ENERGY] if t >= 4 else None
        assert got[t][P.ENERGY] == (pytest.approx(before) if before is not None else None)
        assert got[t][P.DST] == raw[t][P.DST]
    names = set(got[0].asDict())
    assert {f"{P.SPEED}_std_18r", f"{P.SPEED}_std_18r_lag_12", f"{P.SPEED}_lag_12", f"{P.ALPHA}_lag_12", f"{P.ENERGY}_lag_8"} <= names
    assert not {f"{P.BY}_lag_4", f"{P.BZ}_lag_4", P.AE, P.BX, f"{P.SPEED}_std_18r_lag_8"} & names
