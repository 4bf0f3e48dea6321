"""Long series over tasks against the same series whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auroral.operators import peaks, state
from auroral.scan import Recursion, recursions
from auroral.series import Series

SHAPES = {
    "noise": lambda rng, n: rng.integers(-40, 5, n).astype(float),
    "walk": lambda rng, n: np.cumsum(rng.integers(-3, 4, n)).astype(float),
    "steps": lambda rng, n: np.repeat(rng.integers(-9, 3, n // 25 + 1), 25)[:n].astype(float),
    "wave": lambda rng, n: np.round(60 * np.sin(np.arange(n) / 90.0)),
    "slope": lambda rng, n: -np.abs(np.arange(n) - n / 2.0) + rng.integers(0, 3, n),
    "flat": lambda rng, n: np.zeros(n),
}


def frame(spark, values, keys=("a",)):
    rows = [(u, k, None if v != v else float(v)) for u, x in zip(keys, values, strict=True) for k, v in enumerate(x)]
    return Series(spark.createDataFrame(rows, "u string, t int, d double"), ("t",), ("u",))


@pytest.mark.parametrize("shape", list(SHAPES))
@pytest.mark.parametrize("gaps", [0.0, 0.02])
def test_peaks_over_tasks_equal_peaks_of_the_whole_series(spark, shape, gaps):
    rng = np.random.default_rng(len(shape))
    x = SHAPES[shape](rng, 400)
    x[rng.random(400) < gaps] = np.nan
    other = SHAPES[shape](rng, 60)
    filters = {"p": {"height": 5.0, "prominence": 4.0, "width": 2}, "q": {"prominence": 1.0}, "r": {"width": 30.5}}
    got = peaks.long_peaks(frame(spark, [x, other, other], ["a", None, "b"]), "d", filters, tasks=7).df.collect()
    for key, values in (("a", x), (None, other), ("b", other)):
        rows = sorted((r for r in got if r.u == key), key=lambda r: r.t)
        assert len(rows) == len(values)
        for name, f in filters.items():
            assert [r.t for r in rows if r[name]] == state.find_peaks(-values + 1, **f).tolist(), (shape, key, name)


def test_a_width_that_is_just_its_limit_does_not_depend_on_tasks(spark):
    """Half heights are crossed halfway to equal neighbours: 0 + 0.5 less a rounding error isn't 1.5, 1 + that is."""
    d = np.tile(50 - np.array([15.87, 106.06]), 50)
    x = 1 - d
    level = x[1] - (x[1] - x[0]) / 2
    share = (level - x[0]) / (x[1] - x[0])
    assert (2 - share) - (0 + share) < 1
    want = [k for k in range(1, 99, 2) if (k + 2 - share) - (k + share) >= 1]  # row numbers k and k + 2
    assert 1 in want
    for tasks in (1, 7, 30):
        got = peaks.long_peaks(frame(spark, [d, d[:3]], ["a", "b"]), "d", {"p": {"height": 50.0, "prominence": 15.0, "width": 1}}, tasks=tasks).df.where("p").collect()
        assert sorted(r.t for r in got if r.u == "a") == want == state.find_peaks(x, height=50, prominence=15, width=1).tolist()
        assert [r.t for r in got if r.u == "b"] == [1]


def test_recovery_follows_a_peak_whose_width_is_just_its_limit(spark, tmp_path):
    from auroral import catalogue

    values = [15.87, 106.06, 15.87, 2.78, 42.77, 22.06, 99.56]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id) AS ts", "7L AS user_id", "'view' AS event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = [r.recovery for r in catalogue.queries()["recovery_state"](spark, str(tmp_path)).orderBy("event_id").collect()]
    assert got == [None, None, 1.920625, 4.386667, 0.943125, 1.8925, 2.365625]  # as its SQL gives


def test_recursions_over_tasks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    x[rng.random(300) < 0.03] = np.nan
    x[:4] = np.nan
    wanted = [Recursion("d", "load", np.exp(-1 / 8.5)), Recursion("d", "mean", 0.75, hold=True, seed=True), Recursion("d", "slow", 0.999)]
    values = {"a": x, None: x[50:90], "b": np.full(7, np.nan), "c": x[:1]}
    for tasks in (1, 6):
        got = recursions(frame(spark, list(values.values()), list(values)), wanted, tasks).df.collect()
        for key, v in values.items():
            rows = sorted((r for r in got if r.u == key), key=lambda r: r.t)
            for r in wanted:
                s, want = None, []
                for y in v:
                    if np.isnan(y):
                        s = s if r.hold else None
                    else:
                        s = y if s is None and r.seed else r.keep * (s or 0) + (1 - r.keep) * y
                    want.append(s)
                assert [np.nan if q[r.name] is None else q[r.name] for q in rows] == pytest.approx([np.nan if w is None else w for w in want], rel=1e-9, nan_ok=True), (key, r.name)
    empty = frame(spark, [np.zeros(0)])
    assert recursions(empty, wanted).df.count() == 0 and peaks.long_peaks(empty, "d", {"p": {"width": 1}}).df.count() == 0


def test_a_long_series_is_read_in_linear_time(spark):
    """A million rows, of which one task never sees more than a share."""
    n = 10**6
    rows = spark.range(n).select(F.lit(1).alias("u"), F.col("id").alias("t"), (-100 * F.abs(F.sin(F.col("id") / 500)) - F.pmod(F.col("id") * 7919, F.lit(13))).alias("d"))
    got = peaks.long_peaks(Series(rows, ("t",), ("u",)), "d", {"p": state.storm_filter(-50, 60, 2)}, tasks=16).df.where("p").select("t").collect()
    x = np.array([-100 * abs(np.sin(k / 500)) - k * 7919 % 13 for k in range(n)])
    assert sorted(r.t for r in got) == np.flatnonzero(_fast_peaks(-x + 1)).tolist() and len(got) > 500


def _fast_peaks(x):
    """height 50, prominence 60, width 2 with arrays: lows() on both sides, then the half heights."""
    low_l, _ = peaks.lows(x)
    low_r = peaks.lows(x[::-1])[0][::-1]
    out = np.zeros(len(x), bool)
    for p, _ in peaks.tops(x, (0, None, 0, None)):
        depth = x[p] - max(low_l[p], low_r[p])
        if x[p] >= 50 and depth >= 60:
            level = x[p] - depth / 2
            a, b = peaks.crossing(x, p, -1, level), peaks.crossing(x, p, 1, level)
            out[p] = peaks._edge(b, x[b], x[b - 1], level, 1) - peaks._edge(a, x[a], x[a + 1], level, -1) >= 2
    return out
