"""Peaks with prominence and width of series of any length.

A task finds the peaks of its rows and, with two stacks, the least value on each side before something higher. Where nothing higher
stands in the task, the summaries of all tasks tell which task has it and what lies between; that task is asked for the rest, and again for where the
half height is crossed. What is asked are peaks that overtop their task's rows on one side, few for each task.

Widths are differences of places in the series, counted from 1 as row numbers are. Doubles round by their size, so a width that is just its limit
depends on the count, which must not begin anew in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auroral.scan import Chain, chains, deal, numbers, stretches, whole_task
from auroral.series import Series, checkpointed

_PEAK = "_row long, chain int, place int, at long, v double, low_l double, low_r double, ask_l int, ask_r int"
_KINDS = [("_row", pa.int64()), ("chain", pa.int32()), ("place", pa.int32()), ("at", pa.int64()), ("v", pa.float64()), ("low_l", pa.float64()), ("low_r", pa.float64()), ("ask_l", pa.int32()), ("ask_r", pa.int32())]


def tops(x: np.ndarray, around: tuple[int, float | None, int, float | None]) -> list[tuple[int, int]]:
    """(middle, a place on it) of maxima and plateaus whose middle (rounded down) is in ``x``; ``around`` says how the first and last run go on, as Chain.around()."""
    if not len(x):
        return []
    change = np.flatnonzero(x[1:] != x[:-1])
    begin, end = np.append(0, change + 1), np.append(change, len(x) - 1)
    v = x[begin]
    rows_l, before, rows_r, after = around
    left, right = np.append(np.nan if before is None else before, v[:-1]), np.append(v[1:], np.nan if after is None else after)
    found = np.flatnonzero((left < v) & (right < v))
    lo, hi = begin.copy(), end.copy()
    lo[0] -= rows_l
    hi[-1] += rows_r
    middle = (lo[found] + hi[found]) // 2
    keep = (middle >= 0) & (middle < len(x))
    return list(zip(middle[keep].tolist(), begin[found][keep].tolist(), strict=True))


def lows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the least value from it back to the first higher or missing one, and whether there is such a one."""
    least, closed = np.empty(len(x)), np.zeros(len(x), bool)
    stack: list[tuple[float, float]] = []
    barred = False
    for i, v in enumerate(x.tolist()):
        if v != v:
            stack, barred = [], True
            least[i] = v
            continue
        m = v
        while stack and stack[-1][0] <= v:
            m = min(m, stack.pop()[1])
        least[i], closed[i] = m, barred or bool(stack)
        stack.append((v, m))
    return least, closed


def crossing(x: np.ndarray, start: int, step: int, level: float) -> int | None:
    """The first place from ``start`` on, by ``step``, with a value of at most ``level``; None if there is none."""
    width = 64
    while 0 <= start < len(x):
        some = x[max(start - width + 1, 0) : start + 1][::-1] if step < 0 else x[start : start + width]
        hit = np.flatnonzero(some <= level)
        if len(hit):
            return start + step * int(hit[0])
        start += step * len(some)
        width *= 4
    return None


def _edge(i: float, here: float, inner: float, level: float, step: int) -> float:
    """Where the line from ``here`` at ``i`` to ``inner``, next to it towards the peak, crosses the level."""
    return i - step * (level - here) / (inner - here) if here < level else float(i)


def _passes(name_filters: dict[str, dict], v: float, depth: float, wide: float | None) -> list[bool]:
    return [
        (f.get("height") is None or v >= f["height"]) and (f.get("prominence") is None or depth >= f["prominence"]) and (f.get("width") is None or (wide is not None and wide >= f["width"])) for f in name_filters.values()
    ]


def long_peaks(series: Series, column: str, peaks: dict[str, dict], sign: float = -1.0, offset: float = 1.0, tasks: int | None = None) -> Series:
    """For each name in ``peaks``, a flag of the peaks of sign * x + offset that pass its filters (height, prominence, width at half prominence), in each series.

    Equal to looking at each series whole; rows are dealt out by ``_row``, so null keys and repeated orders keep their flags. Missing values end a
    peak's sides. Jobs run while this is called.
    """
    if any(set(f) - {"height", "prominence", "width"} for f in peaks.values()):
        raise ValueError("only height, prominence and width can be asked of long series")
    source = deal(series, tasks).withColumn("_x", sign * F.col(column).cast("double") + offset)
    held, place = chains(source, "_x")
    context = series.df.sparkSession.sparkContext
    sent = context.broadcast((held, place))
    names = list(peaks)
    floor = min((f.get("height") if f.get("height") is not None else -np.inf) for f in peaks.values()) if peaks else np.inf
    steep = min((f.get("prominence") if f.get("prominence") is not None else -np.inf) for f in peaks.values()) if peaks else np.inf
    flags = ", ".join(f"f{k} boolean" for k in range(len(names)))
    kinds = [*_KINDS, *[(f"f{k}", pa.bool_()) for k in range(len(names))]]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_task(batches)
        if table is None:
            return
        found, places = sent.value
        task, row, values = table.column("_task")[0].as_py(), table.column("_row").to_numpy(), numbers(table, "_x")
        parts = stretches(table.column("_series").to_numpy())
        out = []
        for k, (lo, hi) in enumerate(parts):
            x = values[lo:hi]
            side = "head" if k == 0 else "tail" if k == len(parts) - 1 else None
            where = places[task][side] if side else None
            chain: Chain | None = found[where[0]] if where else None
            begin = int(chain.offset[where[1]]) if chain else 0
            some = [t for t in tops(x, chain.around(where[1]) if chain else (0, None, 0, None)) if x[t[1]] >= floor]
            if not some:
                continue
            low_l, shut_l = lows(x)
            low_r, shut_r = (a[::-1] for a in lows(x[::-1]))
            for middle, on in some:
                v = float(x[middle])
                low, asks = [float(low_l[middle]), float(low_r[middle])], [None, None]
                for s, (step, shut) in enumerate(((-1, shut_l), (1, shut_r))):
                    if shut[middle] or chain is None:
                        continue
                    other = chain.nearest(where[1], step, lambda c: (c.most > v) | (c.gap > 0))  # noqa: B023
                    stop = other if other is not None else -1 if step < 0 else len(chain.n)
                    between = chain.least[stop + 1 : where[1]] if step < 0 else chain.least[where[1] + 1 : stop]
                    low[s] = min([low[s], *between.tolist()])
                    asks[s] = other
                passed = [None] * len(names)
                if asks == [None, None]:
                    depth = v - max(low)
                    if depth < steep:
                        continue
                    level = v - depth / 2
                    edges = [(i, crossing(x, middle, step, level)) for i, step in enumerate((-1, 1))]
                    if all(e is not None for _, e in edges):
                        left, right = edges[0][1], edges[1][1]
                        wide = _edge(begin + right + 1, x[right], x[right - 1], level, 1) - _edge(begin + left + 1, x[left], x[left + 1], level, -1) if left != right else 0.0
                        passed = _passes(peaks, v, depth, wide)
                        if not any(passed):
                            continue
                out.append((int(row[lo + middle]), where[0] if where else None, where[1] if where else None, begin + middle, v, *low, *asks, *passed))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    rows = source.select("_task", "_row", "_series", "_x")
    first = checkpointed(rows.mapInArrow(find, f"{_PEAK}, {flags}"))
    marked = first.where("f0 is not null").select("_row", *[f"f{k}" for k in range(len(names))])
    rest = first.where("f0 is null").drop(*[f"f{k}" for k in range(len(names))])
    if rest.limit(1).count():
        marked = marked.unionByName(_across(rows, rest, sent, peaks, steep))
    some = marked.withColumnRenamed("_row", "_at")
    out = source.join(some, F.col("_row") == F.col("_at"), "left").select(*series.df.columns, *[F.coalesce(F.col(f"f{k}"), F.lit(False)).alias(n) for k, n in enumerate(names)])
    return Series(out, series.order_by, series.partition_by)


def _across(rows: DataFrame, rest: DataFrame, sent, peaks: dict[str, dict], steep: float) -> DataFrame:
    """(_row, f0, f1, ...) of peaks whose sides or half heights lie in other tasks."""

    def stretch(table: pa.Table, side: int) -> np.ndarray:
        """The values of the task's last series (asked from the right of it) or first."""
        lo, hi = stretches(table.column("_series").to_numpy())[-1 if side < 0 else 0]
        return numbers(table, "_x")[lo:hi]

    def least(x: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(x):
            for row, side, v in zip(asked.column("_row").to_pylist(), asked.column("side").to_pylist(), asked.column("v").to_pylist(), strict=True):
                values = stretch(x, side)
                stops = np.flatnonzero(~(values <= v))
                some = values[stops[-1] + 1 :] if side < 0 else values[: stops[0]]
                out.append((row, side, float(some.min()) if len(some) else float("inf")))
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64()))], ["_row", "side", "low"])

    task_of = lambda c: F.element_at("tasks", c + 1)
    spark = rows.sparkSession
    found = sent.value[0]
    lists = spark.createDataFrame([(c, [int(t) for t in chain.task]) for c, chain in enumerate(found) if len(chain.task) > 1], "chain int, tasks array<int>")
    placed = rest.join(lists.hint("broadcast"), "chain")  # a number a task
    asks = [placed.where(f"ask_{s} is not null").select("_row", F.lit(side).alias("side"), "v", task_of(F.col(f"ask_{s}")).alias("_task")) for s, side in (("l", -1), ("r", 1))]
    sorted_rows = rows.select("_task", "_row", "_series", "_x")

    def by_task(x: pa.Table, asked: pa.Table) -> pa.Table:
        return least(x.sort_by("_row"), asked) if len(asked) else least(x.slice(0, 0), asked)

    lows_ = sorted_rows.groupBy("_task").cogroup(asks[0].unionByName(asks[1]).groupBy("_task")).applyInArrow(by_task, "_row long, side int, low double")
    low = lows_.groupBy("_row").agg(F.min(F.when(F.col("side") < 0, F.col("low"))).alias("more_l"), F.min(F.when(F.col("side") > 0, F.col("low"))).alias("more_r"))
    told = rest.join(low, "_row", "left").select("_row", "chain", "place", "at", "v", *[F.least(f"low_{s}", F.coalesce(f"more_{s}", f"low_{s}")).alias(f"low_{s}") for s in "lr"])
    deep = checkpointed(told.withColumn("depth", F.col("v") - F.greatest("low_l", "low_r")).where(F.col("depth") >= (steep if np.isfinite(steep) else -1.0)).withColumn("level", F.col("v") - F.col("depth") / 2))

    def target(side: int):
        """The stretch of the chain in which the level is crossed: the peak's own, if its rows on that side get as low, else the next that does."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, _ = sent.value
            for batch in batches:
                out = []
                for chain, place, level in zip(*(batch.column(c).to_pylist() for c in ("chain", "place", "level")), strict=True):
                    other = held[chain].nearest(place, side, lambda c: c.least <= level)  # noqa: B023
                    out.append(None if other is None else int(held[chain].task[other]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "other"])

        return run

    schema = deep.select("*").schema.add("other", "integer")
    own = F.element_at("tasks", F.col("place") + 1)
    wanted = None
    for side in (-1, 1):
        aimed = deep.mapInArrow(target(side), schema).join(lists.hint("broadcast"), "chain").withColumn("own", own)
        both = aimed.select("_row", "chain", "level", F.lit(side).alias("side"), F.explode(F.array(F.struct(F.col("own").alias("_task"), F.lit(True).alias("mine")), F.struct(F.col("other").alias("_task"), F.lit(False).alias("mine")))).alias("t")).select("_row", "chain", "level", "side", "t.*").where("_task is not null")
        wanted = both if wanted is None else wanted.unionByName(both)

    def cross(x: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(x) and len(asked):
            x = x.sort_by("_row")
            held, places = sent.value
            row, values, parts = x.column("_row").to_numpy(), numbers(x, "_x"), stretches(x.column("_series").to_numpy())
            task = x.column("_task")[0].as_py()
            for peak, chain, level, side, mine in zip(*(asked.column(c).to_pylist() for c in ("_row", "chain", "level", "side", "mine")), strict=True):
                lo, hi = parts[0] if places[task]["head"][0] == chain and (places[task]["tail"][0] != chain or side > 0 or len(parts) == 1) else parts[-1]
                part = values[lo:hi]
                where = places[task]["head" if (lo, hi) == parts[0] else "tail"][1]
                start = int(np.searchsorted(row[lo:hi], peak)) if mine else len(part) - 1 if side < 0 else 0
                i = crossing(part, start, side, level)
                if i is None:
                    continue
                inner = i - side
                beside = float(part[inner]) if 0 <= inner < len(part) else float(held[chain].last[where - 1] if side > 0 else held[chain].first[where + 1])
                at = int(held[chain].offset[where]) + i + 1
                if mine and i == start:
                    out.append((peak, side, mine, float(at)))
                elif beside > level:  # else the peak's own rows get as low before
                    out.append((peak, side, mine, _edge(at, float(part[i]), beside, level, side)))
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.float64()))], ["_row", "side", "mine", "edge"])

    edges = sorted_rows.groupBy("_task").cogroup(wanted.groupBy("_task")).applyInArrow(cross, "_row long, side int, mine boolean, edge double")
    # the peak's own rows come first, then the other task's
    best = edges.groupBy("_row").agg(*[F.max_by(F.when(F.col("side") == side, F.col("edge")), F.when(F.col("side") == side, F.col("mine"))).alias(n) for side, n in ((-1, "left"), (1, "right"))])
    sized = deep.join(best, "_row").withColumn("wide", F.col("right") - F.col("left"))
    flags = []
    for k, f in enumerate(peaks.values()):
        ok = F.lit(True)
        for c, limit in (("v", f.get("height")), ("depth", f.get("prominence")), ("wide", f.get("width"))):
            if limit is not None:
                ok = ok & (F.col(c) >= limit)
        flags.append(ok.alias(f"f{k}"))
    return sized.select("_row", *flags)
