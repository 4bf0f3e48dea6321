"""Golden and edge cases of the time-series operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auroral.functions import transforms as X
from auroral.operators import clean, convolution, decompose, events, lag, metrics, rolling, state, strided
from auroral.series import Series, chunked, drop_halo
from auroral.sources import ingest


def series(spark, values, name="x"):
    rows = [(k, None if v is None else float(v)) for k, v in enumerate(values)]
    return Series(spark.createDataFrame(rows, f"t int, {name} double"), ("t",))


def column(s, name):
    df = s.df if isinstance(s, Series) else s
    return [r[name] for r in df.orderBy("t").collect()]


def test_compound_lag(spark):
    out = lag.lag_features(series(spark, range(20)), "x", [4, 8])
    assert column(out, "x") == [None] * 4 + [float(k) for k in range(16)]
    assert column(out, "x_lag_8") == [None] * 12 + [float(k) for k in range(8)]
    plain = lag.lag_features(series(spark, range(6)), "x", [0, 4])
    assert column(plain, "x") == [float(k) for k in range(6)]


def test_storm_duration_and_labels(spark):
    d = series(spark, [10, 0, -50, -70, -60, -30, 0, 10])
    assert column(events.storm_duration(d, "x"), "storm_duration") == [0, 3, 2, 1, 0, 0, 0, 0]
    labelled = d.with_columns(label=events.storm_flag("x"))
    assert column(labelled, "label") == [0, 0, 1, 1, 1, 0, 0, 0]


def test_entities_and_classes(spark):
    s = series(spark, [0, 0, 1, 1, 1, 0, 1, 1, 0])
    assert sorted((r.start, r.end) for r in events.entities(s, "x").collect()) == [(2, 4), (6, 7)]
    c = series(spark, [-250, -150, -75, -40, -10, 10]).with_columns(c=events.storm_classes("x"))
    assert column(c, "c") == [0, 0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        events.categorise("x", {"a": 1, "b": 0})


def test_fir(spark):
    s = series(spark, [1, 2, 3, 4])
    s = s.with_columns(y=convolution.causal_convolution(s, "x", [0.1, 0.5, 1.0]), same=convolution.causal_convolution(s, "x", [1.0]))
    assert np.allclose(column(s, "y"), [1, 2.5, 4.1, 5.7])
    assert column(s, "same") == [1, 2, 3, 4]
    holed = series(spark, [1, None, 3, 4])
    holed = holed.with_columns(y=convolution.causal_convolution(holed, "x", [0.5, 1.0]))
    assert column(holed, "y") == [1, None, None, 5.5]
    with pytest.raises(ValueError):
        convolution.kernel("none")


def test_pairs_and_trajectory(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([1.0],), ([1.0, None],)], "a array<double>")
    got = [r.p for r in df.select(convolution.pairs_2d("a").alias("p")).collect()]
    assert [tuple(p) for p in got[0]] == [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert got[1] == [] and [tuple(p) for p in got[2]] == [(None, None)]
    s = convolution.add_takens_features(series(spark, [0, 1, 4, 9, 16, 25]), "x", 4, 1, all_features=True)
    assert column(s, "x_embedding_2d_turn_var")[3:] == [0.0] * 3 and column(s, "x_embedding_2d_jump_mag")[:3] == [None] * 3
    assert column(s, "x_embedding_2d_path_eff")[3] <= 1


def recursion(x, alpha):
    out, last = [], 0.0
    for v in x:
        last = 0.0 if v is None else (1 - alpha) * last + alpha * v
        out.append(None if v is None else last)
    return out


def test_loading_state_is_the_recursion(spark):
    rng = np.random.default_rng(1)
    x = [None if rng.random() < 0.02 else float(v) for v in rng.random(900)]
    got = column(state.loading_state(series(spark, x), "x", 8.5, "s"), "s")
    for a, b in zip(got, recursion(x, 1 - math.exp(-1 / 8.5)), strict=True):
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-13)


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 5, 1, 4, 0], float)
    assert state.find_peaks(x).tolist() == [1, 4, 7, 9, 11]
    assert state.find_peaks(x, height=3).tolist() == [4, 9, 11]
    assert state.find_peaks(x, distance=3).tolist() == [1, 4, 9]
    assert state.find_peaks(x, prominence=3).tolist() == [4, 9, 11]
    assert state.find_peaks(x, width=2.5).tolist() == [4]
    assert len(state.find_peaks(np.array([]))) == 0


def test_recovery_sees_only_earlier_peaks(spark):
    s = series(spark, [0, -80, -60, -50, -55, None]).with_columns(peak=F.col("x") == -80)
    got = column(state.recovery_state(s, "x", "peak"), "recovery_state_lookback_24_thresh_-50")
    assert got[:2] == [None, None] and got[5] is None
    assert got[2] == pytest.approx(1 / 24 * (1 + 0.5 * 20)) and got[3] == pytest.approx(2 / 24 * (1 + 0.5 * 30))


def test_causal_features_do_not_change_with_later_rows(spark):
    x = list(np.random.default_rng(3).normal(0, 50, 80))

    def made(values):
        s = series(spark, values)
        s = s.with_columns(a=rolling.rolling_std(s, "x", 6), b=rolling.rolling_median(s, "x", 6), c=rolling.ewm(s, "x", 5))
        return [column(s, c)[:60] for c in "abc"]

    assert made(x[:60]) == made(x)


def test_distances(spark):
    rng = np.random.default_rng(5)
    pairs = [(rng.normal(0, 1, 20), rng.normal(1, 2, 30)), (np.round(rng.normal(0, 1, 9), 0), np.round(rng.normal(0, 1, 7), 0)), (np.ones(3), np.ones(4)), (np.ones(3), np.zeros(3))]
    pairs += [(a, a) for a, _ in pairs] + [(b, a) for a, b in pairs]
    rows = [(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(pairs)] + [(99, None, [1.0]), (98, [1.0], None)]
    got = {r.k: r.d for r in spark.createDataFrame(rows, "k int, a array<double>, b array<double>").select("k", strided.distances(F.col("a"), F.col("b")).alias("d")).collect()}
    for k, (a, b) in enumerate(pairs):
        grid = np.sort(np.concatenate([a, b]))
        fa, fb = ((v[None, :] <= grid[:, None]).mean(axis=1) for v in (a, b))
        assert got[k].wasserstein == pytest.approx(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid))) and got[k].ks == pytest.approx(np.abs(fa - fb).max())
    assert got[99] is None and got[98] is None
    assert strided.stride(24, 0.3) == 16 and strided.stride(12, 0.3) == 8


def test_splines_meet_their_points_and_cubics():
    x = np.array([0.0, 3, 5, 9, 12])
    at = np.arange(13.0)
    cubic = 2 + x - 0.3 * x**2 + 0.05 * x**3
    assert np.allclose(strided._not_a_knot(x, cubic, at), 2 + at - 0.3 * at**2 + 0.05 * at**3)
    assert np.allclose(strided._quadratic(x, 1 + x**2, at), 1 + at**2)


@pytest.mark.parametrize(("kind", "degree"), [("quadratic", 2), ("cubic", 3)])
def test_window_correlation_by_splines(spark, kind, degree):
    rng = np.random.default_rng(8)
    sizes = {1: 75, None: 38, 2: 20, 3: 5}  # many centres, a null key, one centre, none
    rows = [(g, k, float(a), float(b)) for g, n in sizes.items() for k, (a, b) in enumerate(rng.normal(0, 1, (n, 2)))]
    df = spark.createDataFrame(rows, "g int, t int, a double, b double")

    def expected(a, b):
        n = len(a)
        x = [s + 6 for s in range(0, n - 12 + 1, 9)]
        y = [np.corrcoef(a[c - 6 : c + 6], b[c - 6 : c + 6])[0, 1] for c in x]
        if len(x) < 2:
            return np.full(n, y[0] if y else 0.0)
        x, y = np.array([0, *x, n - 1]) / n, np.array([y[0], *y, y[-1]])
        knots = ((x[1:] + x[:-1]) / 2)[1:-1] if degree == 2 else x[2:-2]
        powers = lambda v: np.stack([*[v**p for p in range(degree + 1)], *[np.maximum(v - k, 0) ** degree for k in knots]], 1)
        return powers(np.arange(n) / n) @ np.linalg.solve(powers(x), y)

    for keys, groups in ((("g",), [1, None, 2, 3]), ((), [1])):
        source = df if keys else df.where("g = 1")
        s = strided.add_window_correlation(Series(source, ("t",), keys), "a", "b", 12, 0.25, "pearson", kind)
        assert s.df.columns == ["g", "t", "a", "b", "window_corr_a_b_12w_25ovlp"]
        got = s.df.collect()
        assert len(got) == source.count()
        for g in groups:
            own = sorted((r.t, r.window_corr_a_b_12w_25ovlp) for r in got if r.g == g)
            a, b = (np.array([r[k] for r in rows if r[0] == g]) for k in (2, 3))
            assert np.allclose([v for _, v in own], expected(a, b))
    with pytest.raises(ValueError, match="unknown interpolation"):
        strided.add_window_correlation(Series(df, ("t",), ("g",)), "a", "b", interpolation="nearest")


def test_transforms_invert(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1e9, -250.0, -1.5, 0.0, 0.3, 7.0, 1e6)], "x double")
    for t in (X.SignedLog(), X.SinhArcsinh(0.1, 0.5), X.YeoJohnson(lam=0.6, standardize=False), X.Pipeline((X.SignedLog(), X.SinhArcsinh(0, 0.4)))):
        for r in df.select("x", t.inverse(t.apply(F.col("x"))).alias("y")).collect():
            assert r.y == pytest.approx(r.x, rel=1e-6, abs=1e-9), t
    with pytest.raises(ValueError):
        X.Clip(2, 1)
    with pytest.raises(ValueError):
        X.SinhArcsinh(0, 0)
    small = df.where("abs(x) < 1e3")
    fitted = X.YeoJohnson().fit(small, "x")
    mean, std = small.agg(F.avg(fitted.apply(F.col("x"))), F.stddev_pop(fitted.apply(F.col("x")))).first()
    assert abs(mean) < 1e-9 and std == pytest.approx(1)
    assert X.match_derived(["ab_lag_4", "abc_std", "z"], ["ab", "abc"]) == {"ab_lag_4": "ab", "abc_std": "abc"}


def test_forecast_metrics(spark):
    df = spark.createDataFrame([(-10.0, -15.0), (-60.0, -55.0), (-80.0, -75.0), (-20.0, -25.0), (-100.0, -90.0), (None, 1.0)], "t double, p double")
    r = metrics.forecast_metrics(df, "t", "p").first()
    assert r.mae == 6 and r.rmse == pytest.approx(math.sqrt(40)) and (r.f1_score, r.precision, r.recall) == (1, 1, 1)
    calm = metrics.forecast_metrics(df.where("t > -50"), "t", "p").first()
    assert (calm.precision, calm.recall) == (1, 1)


def test_relative_errors_of_a_truth_of_zero(spark):
    df = spark.createDataFrame([("miss", 0.0, -15.0), ("miss", -60.0, -55.0), ("hit", 0.0, 0.0), ("hit", -60.0, -55.0), ("other", -50.0, -55.0)], "k string, t double, p double")
    mape = {r.k: r.mape for r in metrics.forecast_metrics(df, "t", "p", by=("k",)).collect()}
    assert mape["miss"] == math.inf and math.isnan(mape["hit"]) and mape["other"] == pytest.approx(10)


def test_entity_metrics_and_risk(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(zip([0, 1, 1, 0, 0, 1, 1, 1], [0, 1, 1, 0, 1, 1, 1, 0], strict=True))]
    s = Series(spark.createDataFrame(rows, "t int, y int, p int"), ("t",))
    r = metrics.boundary_metrics(s, "y", "p", 1).first()
    assert (r.n_true, r.n_pred, r.exact_precision, r.overlap_recall) == (2, 2, 0.5, 1.0)
    q = spark.createDataFrame([([-100.0, -60.0, 10.0],), ([0.0, 5.0, 9.0],), ([10.0, -60.0, -70.0],)], "q array<double>")
    levels = [0.1, 0.5, 0.9]
    got = {m: [x[0] for x in q.select(metrics.storm_risk(F.col("q"), levels, -50, m)).collect()] for m in ("interpolation", "conservative", "proportion")}
    assert np.allclose(got["proportion"], [2 / 3, 0, 2 / 3]) and np.allclose(got["conservative"], [0.5, 0, 0.1])
    assert np.allclose(got["interpolation"], [0.9, 0, 1 - (0.1 + 60 / 70 * 0.4)])


def test_gradients_are_derivatives(spark):
    df = spark.createDataFrame([(1, 0.7), (0, -0.4), (1, -1.2)], "y int, m double")
    h = 1e-5
    g = metrics.focal_gradient(F.col("y"), F.col("m"))[0]
    numeric = (metrics.focal_loss(F.col("y"), F.col("m") + h) - metrics.focal_loss(F.col("y"), F.col("m") - h)) / (2 * h)
    for r in df.select(g.alias("g"), numeric.alias("n")).collect():
        assert r.g == pytest.approx(r.n, rel=1e-5)


def test_decompose_recovers_a_season(spark):
    season = [3, 1, -4, 0, 2, -1, -1]
    s = decompose.decompose(series(spark, [0.5 * k + season[k % 7] for k in range(42)]), "x", 7)
    assert np.allclose(column(s, "x_seasonal"), [season[k % 7] for k in range(42)]) and np.allclose(column(s, "x_resid"), 0, atol=1e-9)
    assert column(decompose.decompose(series(spark, range(5)), "x", 7), "x_trend") == [None] * 5


def test_chunks_give_what_one_task_gives(spark):
    s = series(spark, np.random.default_rng(9).random(500))
    whole = [r.m for r in s.df.select("t", F.sum("x").over(s.last(12)).alias("m")).orderBy("t").collect()]
    cut = chunked(s, 64, 11)
    assert np.allclose([r.m for r in drop_halo(cut.with_columns(m=F.sum("x").over(cut.last(12)))).orderBy("t").collect()], whole)


def test_ingest(spark, tmp_path):
    (tmp_path / "a.fmt").write_text(" FORMAT OF THE SUBSETTED FILE\n 1 YEAR I4\n 2 DOY I4\n 3 Hour I3\n 4 Alpha/Prot. ratio F6.2\n")
    (tmp_path / "a.lst").write_text("2001 1 0 0.5\n2001 366 23 9.99\nbad 2 3 x\n")
    rows = ingest.read_observations(spark, str(tmp_path / "a.fmt"), str(tmp_path / "a.lst")).collect()
    assert [str(r.full_date) for r in rows] == ["2001-01-01 00:00:00", "None", "None"] and rows[2]["Alpha/Prot ratio"] is None
    out = ingest.process(ingest.read_observations(spark, str(tmp_path / "a.fmt"), str(tmp_path / "a.lst")))
    assert [r["Alpha/Prot ratio"] for r in out.collect()] == [0.5, None, None]


def test_clean(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 4.0, 5.0)], "t int, a double, b double")
    assert [r.t for r in clean.filter_by_completeness(df, 60, ("t",)).collect()] == [3]
    with pytest.raises(ValueError):
        clean.temporal_split(df, "none", 2)
    before, after = clean.temporal_split(df, "t", 2)
    assert before.count() == 1 and after.count() == 2
    assert clean.clean_column_name("BZ, nT (GSM)") == "BZ_nT_GSM"


@pytest.mark.parametrize("values", [[], [1.0], [None, None], [2.0, 2.0, 2.0]])
def test_edges_do_not_fail(spark, values):
    s = series(spark, values)
    s = s.with_columns(a=rolling.rolling_std(s, "x", 3), b=rolling.rolling_median(s, "x", 3), c=rolling.ewm(s, "x", 3), d=convolution.normalise(s, "x", "gradient"))
    s = strided.add_cdf_trend(s, "x", 3, 0.3)
    s = strided.add_enhanced_rolling_std(s, "x", 3)
    s = state.storm_peaks(s, "x")
    s = state.loading_state(s, "x", 2.0, "e")
    assert s.df.count() == len(values)
    assert events.entities(s.with_columns(l=events.storm_flag("x")), "l").count() == 0


def test_daily_values_must_be_complete(spark):
    from auroral.sources import ingest

    rows = spark.sql("SELECT timestamp_ntz '2024-01-01 05:00:00' AS t UNION ALL SELECT timestamp_ntz '2024-01-02 23:00:00'")
    daily = spark.sql("SELECT date '2024-01-01' AS day, 1.5D AS flux UNION ALL SELECT date '2024-01-02', 2.5D")
    assert sorted(r.flux for r in ingest.join_daily(rows, daily, "t", "day", complete=True).collect()) == [1.5, 2.5]
    assert [r.flux for r in ingest.join_daily(rows, daily.limit(1), "t", "day").orderBy("t").collect()] == [1.5, None]
    with pytest.raises(ValueError):
        ingest.join_daily(rows, daily.limit(1), "t", "day", complete=True).count()


def test_null_series_keep_their_peaks_and_matches(spark):
    x = [float(v) for v in (0, -10, -80, -90, -70, -20, 0, -60, -75, -10, 5, 0, -3, -90, -2)]
    rows = [(u, k, v) for u in (1, None) for k, v in enumerate(x)]
    s = Series(spark.createDataFrame(rows, "u int, t int, d double"), ("t",), ("u",))
    for filters in ({"height": 50, "prominence": 15, "width": 1}, {"distance": 4, "prominence": 5}):
        got = state.with_peaks(s, "d", {"p": filters}).df.where("p").collect()
        assert sorted(r.t for r in got if r.u == 1) == sorted(r.t for r in got if r.u is None) == state.find_peaks(1 - np.array(x), **filters).tolist()
    storms = state.storm_periods(s, "d", threshold=-30, min_duration=2).collect()
    assert [(r.start, r.end) for r in storms if r.u == 1] == [(r.start, r.end) for r in storms if r.u is None] != []
    labelled = s.with_columns(y=(F.col("d") <= -50).cast("int"))
    m = metrics.boundary_metrics(labelled, "y", "y").first()
    assert (m.exact_precision, m.exact_recall, m.n_true) == (1.0, 1.0, 6)


def test_normal_distribution_as_columns(spark):
    from statistics import NormalDist

    normal = NormalDist()
    z = [-38.0, -9.0, -7.2, -7.0, -3.3, -1.0, -1e-9, 0.0, 0.4, 2.5, 6.9, 7.5, 8.2, None]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", events.normal_cdf("z").alias("p")).collect()
    assert all(r.p is None if r.z is None else r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-12, abs=1e-15) for r in got)
    p = [1e-10, 1e-4, 0.001, 0.0249, 0.075, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.95, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(v,) for v in [*p, 0.0, 1.0, -1.0, 2.0, None]], "p double").select("p", events.normal_quantile("p").alias("z")).collect()
    assert all(r.z is None if r.p not in p else r.z == pytest.approx(normal.inv_cdf(r.p), rel=1e-12, abs=1e-12) for r in got)


@pytest.mark.parametrize("causal", [True, False])
def test_ranks_of_long_frames(spark, causal):
    from auroral.scan import framed

    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=400), 1)
    x[rng.random(400) < 0.1] = np.nan
    rows = [(u, k, None if np.isnan(v) else float(v)) for u in ("a", None) for k, v in enumerate(x[: 400 if u else 37])]
    s = Series(spark.createDataFrame(rows, "u string, t int, x double"), ("t",), ("u",))
    before, after = (47, 0) if causal else (24, 24)
    small = framed(s, before, after, lambda v: [events._rolling_ranks(v, before, after, 10)], "x", ["r"], rows=50, tasks=3).df.collect()
    whole = {(r.u, r.t): r.r for r in events.severity_rank(s, "x", 48, causal, name="r").df.collect()}
    assert len(small) == len(whole) == 437
    for r in small:
        v = x[: 400 if r.u else 37]
        some = v[max(0, r.t - before) : r.t + after + 1]
        some = some[~np.isnan(some)]
        want = None if np.isnan(v[r.t]) or len(some) < 10 else (some <= v[r.t]).sum() / len(some)
        assert r.r == whole[r.u, r.t] == want
    assert events.adaptive_severity(s, "x", 2).df.where("x is null and severity is not null").count() == 0
