"""The causal operators over streams: a series' state is its last rows, its accumulators and the rows that wait for the watermark.

A row waits until the watermark has passed its time; all rows of its series up to that time are there then, and go on in
order of time. So the result is that of one batch over the same rows, however they are cut into batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auroral.operators.convolution import kernel

_HELD = "held array<double>, load double, last long, times array<long>, ties array<long>, waiting array<double>"


def causal_features(stream: DataFrame, series: str, time: str, value: str, lags: tuple[int, ...] = (4, 8), window: int = 24, kernel_name: str = "storm_onset_short", tau: float = 8.5, watermark: str = "1 hour", tie: str | None = None, idle_seconds: float | None = None) -> DataFrame:
    """(series, time, value, lag_k..., mean, conv, state) of each row: lags, the mean of the last ``window`` rows, the convolution and the loading state.

    Rows come out once the watermark has passed their time, in order of time, then of the integral column ``tie``, then of value (missing last). Rows that
    arrive behind the watermark or have no time are left out. With ``idle_seconds`` a series is forgotten, and begins anew, once the watermark is so far
    beyond its last row.
    """
    k = np.array(kernel(kernel_name))[::-1]
    keep = max(max(lags, default=0), window - 1, len(k) - 1)
    alpha = 1 - math.exp(-1 / tau)
    kind = stream.schema[series].dataType.simpleString()
    columns = ["mean", "conv", "state"]
    schema = f"`{series}` {kind}, `{time}` timestamp, `{value}` double, " + "".join(f"lag_{n} double, " for n in lags) + ", ".join(f"{c} double" for c in columns)
    names = [series, time, value, *[f"lag_{n}" for n in lags], *columns]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, load, last, times, ties, waiting = state.get if state.exists else ([], 0.0, None, [], [], [])
        held, rest = list(held), list(zip(times, ties, [math.nan if x is None else x for x in waiting], strict=True))
        for frame in frames:
            at = pd.to_datetime(frame["_t"]).to_numpy("datetime64[us]").astype("int64")
            rest += zip(at.tolist(), frame["_k"].tolist(), [math.nan if x is None else float(x) for x in frame["_x"]], strict=True)
        now = state.getCurrentWatermarkMs()
        rest.sort(key=lambda r: (r[0], r[1], math.isnan(r[2]), r[2] if r[2] == r[2] else 0.0))
        ready = [r for r in rest if r[0] <= now * 1000]
        rest = rest[len(ready) :]
        out = []
        for at, _, x in ready:
            past = np.array([*held, x])
            load = 0.0 if math.isnan(x) else (1 - alpha) * load + alpha * x
            recent = past[-window:]
            recent = recent[~np.isnan(recent)]
            newest = past[::-1][: len(k)]
            out.append((key[0], pd.Timestamp(at, unit="us"), x, *[past[-1 - n] if len(past) > n else math.nan for n in lags], recent.mean() if len(recent) else math.nan, float(newest @ k[: len(newest)]), math.nan if math.isnan(x) else load))
            held, last = past[-keep:].tolist() if keep else [], at
        over = None if idle_seconds is None or last is None else int(last // 1000 + idle_seconds * 1000)
        if not rest and over is not None and over <= now:
            state.remove()
        else:
            state.update((held, load, last, [r[0] for r in rest], [r[1] for r in rest], [r[2] for r in rest]))
            wake = -(-rest[0][0] // 1000) if rest else over
            if wake is not None:
                state.setTimeoutTimestamp(max(wake, now + 1))
        yield pd.DataFrame(out, columns=names)

    ready = stream.select(series, F.col(time).cast("timestamp").alias("_t"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("_k"), F.col(value).cast("double").alias("_x"))
    ready = ready.where("_t is not null").withColumn("_k", F.coalesce("_k", F.lit(0))).withWatermark("_t", watermark)
    return ready.groupBy(series).applyInPandasWithState(step, schema, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_stats(stream: DataFrame, time: str, value: str, length: str = "1 hour", slide: str | None = None, by: tuple[str, ...] = (), watermark: str = "1 hour") -> DataFrame:
    """Count, mean and deviation in event-time windows, told once the watermark has passed a window's end."""
    ready = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    return ready.groupBy(F.window(time, length, slide or length), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
