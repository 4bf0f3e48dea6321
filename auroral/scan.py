"""Long series without a task for a whole series: rows dealt out in order, and what tasks must know of each other.

deal() sorts rows by series and order into tasks and writes them down, so that every later pass sees the same tasks. A pass returns
at most two summaries of a task, of the series that may go on before it and after it; the driver strings these together (a few numbers a
task, whatever the rows) and sends them to the next pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auroral.series import Series, checkpointed


def deal(series: Series, tasks: int | None = None) -> DataFrame:
    """The rows in order of series and order over tasks, with ``_task``, ``_row`` (a number of its own) and ``_series`` (equal for rows of one series, null keys included)."""
    keys = [*series.partition_by, *series.order_by]
    spread = series.df.repartitionByRange(tasks, *keys) if tasks else series.df.repartitionByRange(*keys)
    name = F.xxhash64(*series.partition_by) if series.partition_by else F.lit(0).cast("long")
    return checkpointed(spread.sortWithinPartitions(*keys).withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id(), "_series": name}))


def whole_task(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a task in order; none for an empty one."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles, nulls as NaN."""
    column = table.column(name).cast(pa.float64())
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def stretches(series: np.ndarray) -> list[tuple[int, int]]:
    """Where each series begins and ends in a task."""
    cut = np.flatnonzero(np.append(True, series[1:] != series[:-1]))
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(series)], strict=True))


# --- affine recursions


@dataclass(frozen=True)
class Recursion:
    """s = keep * s before + (1 - keep) * x. A missing x begins anew (state missing there), or with ``hold`` leaves s as it is; with ``seed`` the first x is s, else s begins at 0."""

    column: str
    name: str
    keep: float
    hold: bool = False
    seed: bool = False


def _steps(x: list[float], r: Recursion, state: float | None) -> tuple[list[float | None], float | None]:
    """The states from ``state`` on (None: nothing before)."""
    keep, gain, out = r.keep, 1 - r.keep, []
    for v in x:
        if v != v:
            if not r.hold:
                state = None
            out.append(state)
        else:
            state = v if state is None and r.seed else keep * (state or 0.0) + gain * v
            out.append(state)
    return out, state


def _effect(x: np.ndarray, r: Recursion) -> tuple[bool, float, float | None]:
    """What a stretch does to the state before it: (anew, share, end). ``end`` is the state after it if nothing came before; a state s before adds share * s, for a
    seeded recursion share * (s - first value), as the first value isn't the seed then. ``anew``: what came before no longer matters."""
    known = ~np.isnan(x)
    if not r.hold and not known.all():
        tail = x[np.flatnonzero(~known)[-1] + 1 :]
        return True, 0.0, _steps(tail.tolist(), r, None)[1]
    return False, r.keep ** int(known.sum()), _steps(x.tolist(), r, None)[1]


def recursions(series: Series, wanted: list[Recursion], tasks: int | None = None) -> Series:
    """The series with all the recursions, each linear in the rows: a pass that sums up tasks, and one that carries states on.

    Rows are written down once; jobs run while this is called.
    """
    dealt = deal(series, tasks)
    names = sorted({r.column for r in wanted})
    inner = ", ".join(f"anew{k} boolean, share{k} double, end{k} double, first{k} double" for k in range(len(wanted)))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_task(batches)
        if table is None:
            return
        codes = table.column("_series").to_numpy()
        last = stretches(codes)[-1]
        row = {"task": table.column("_task")[0].as_py(), "head": int(codes[0]), "tail": int(codes[-1]), "whole": last[0] == 0}
        for k, r in enumerate(wanted):
            x = numbers(table, r.column)[last[0] : last[1]]
            row[f"anew{k}"], row[f"share{k}"], row[f"end{k}"] = _effect(x, r)
            known = x[~np.isnan(x)]
            row[f"first{k}"] = float(known[0]) if len(known) else None
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("task", pa.int32()), ("head", pa.int64()), ("tail", pa.int64()), ("whole", pa.bool_()), *[(f"{n}{k}", pa.bool_() if n == "anew" else pa.float64()) for k in range(len(wanted)) for n in ("anew", "share", "end", "first")]]))

    told = sorted(dealt.select("_task", "_series", *names).mapInArrow(sum_up, f"task int, head long, tail long, whole boolean, {inner}").collect(), key=lambda t: t.task)  # a row a task
    carried, state, before = {}, [None] * len(wanted), None
    for t in told:
        if t.head != before:
            state = [None] * len(wanted)
        carried[t.task] = state
        after = []
        for k, r in enumerate(wanted):
            s, end = state[k] if t.whole else None, t[f"end{k}"]
            if s is None or t[f"anew{k}"]:
                after.append(end)
            elif end is None:
                after.append(s)
            else:
                after.append(end + t[f"share{k}"] * (s - (t[f"first{k}"] if r.seed else 0.0)))
        state, before = after, t.tail
    sent = series.df.sparkSession.sparkContext.broadcast(carried)
    columns = series.df.columns
    schema = dealt.select(*columns).schema
    for r in wanted:
        schema = schema.add(r.name, "double")

    def carry_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("_series").to_numpy()
            if state is None:
                state, before = list(sent.value[batch.column("_task")[0].as_py()]), int(codes[0])
            out: list[list[float | None]] = [[] for _ in wanted]
            for lo, hi in stretches(codes):
                if int(codes[lo]) != before:
                    state, before = [None] * len(wanted), int(codes[lo])
                for k, r in enumerate(wanted):
                    some, state[k] = _steps(numbers(batch, r.column)[lo:hi].tolist(), r, state[k])
                    out[k] += some
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[pa.array(o, pa.float64()) for o in out]], schema.names)

    return Series(dealt.mapInArrow(carry_on, schema), series.order_by, series.partition_by)


# --- chains: a series over several tasks


@dataclass
class Chain:
    """A series' stretches in order, an entry each: task, rows, largest and least value, whether one is missing, first and last value, length of the first and last run
    of equal values, the value after the first run and before the last one, rows before."""

    task: np.ndarray
    n: np.ndarray
    most: np.ndarray
    least: np.ndarray
    gap: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lead: np.ndarray
    trail: np.ndarray
    after_lead: np.ndarray
    before_trail: np.ndarray

    def __post_init__(self):
        self.offset = np.cumsum(self.n) - self.n

    def around(self, k: int) -> tuple[int, float | None, int, float | None]:
        """For the stretch ``k``: how many rows of the run that it begins with stand before it, the value before that run (None: the series begins), and the same to the right."""
        out = []
        for step, value, edge, run, beyond in ((-1, self.first[k], self.last, self.trail, self.before_trail), (1, self.last[k], self.first, self.lead, self.after_lead)):
            rows, other, j = 0, None, k + step
            while 0 <= j < len(self.n):
                if edge[j] != value:
                    other = float(edge[j])
                    break
                rows += int(run[j])
                if run[j] < self.n[j]:
                    other = float(beyond[j])
                    break
                j += step
            out += [rows, other]
        return tuple(out)

    def nearest(self, k: int, step: int, hit: Callable[[Chain], np.ndarray]) -> int | None:
        """The next stretch from ``k`` on (to the left or right) for which ``hit`` holds."""
        found = np.flatnonzero(hit(self))
        found = found[found < k] if step < 0 else found[found > k]
        return int(found[-1] if step < 0 else found[0]) if len(found) else None


_SUMMARY = "task int, head boolean, tail boolean, series long, n long, most double, least double, gap boolean, first double, last double, lead long, trail long, after_lead double, before_trail double"


def chains(dealt: DataFrame, column: str) -> tuple[list[Chain], dict[int, dict[str, tuple[int, int]]]]:
    """The chains of all series at the edges of tasks, and for each task where in them its first (``head``) and last (``tail``) series stand."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_task(batches)
        if table is None:
            return
        codes, x, task = table.column("_series").to_numpy(), numbers(table, column), table.column("_task")[0].as_py()
        parts = stretches(codes)
        rows = []
        for k in sorted({0, len(parts) - 1}):
            lo, hi = parts[k]
            v = x[lo:hi]
            known = v[~np.isnan(v)]
            change = np.flatnonzero(v[1:] != v[:-1])
            lead, trail = (int(change[0]) + 1, len(v) - 1 - int(change[-1])) if len(change) else (len(v), len(v))
            rows.append({"task": task, "head": k == 0, "tail": k == len(parts) - 1, "series": int(codes[lo]), "n": len(v), "most": known.max() if len(known) else -np.inf, "least": known.min() if len(known) else np.inf, "gap": len(known) < len(v),
                         "first": v[0], "last": v[-1], "lead": lead, "trail": trail, "after_lead": v[lead] if lead < len(v) else np.nan, "before_trail": v[-trail - 1] if trail < len(v) else np.nan})
        kinds = {"task": pa.int32(), "head": pa.bool_(), "tail": pa.bool_(), "gap": pa.bool_(), "series": pa.int64(), "n": pa.int64(), "lead": pa.int64(), "trail": pa.int64()}
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, kinds.get(c, pa.float64())) for c in rows[0]]))

    told = sorted(dealt.select("_task", "_series", column).mapInArrow(sum_up, _SUMMARY).collect(), key=lambda r: (r.task, not r.head))  # two rows a task at most
    groups: list[list] = []
    for r in told:
        if not (groups and r.head and groups[-1][-1].tail and groups[-1][-1].series == r.series):
            groups.append([])
        groups[-1].append(r)
    names = ("task", "n", "most", "least", "gap", "first", "last", "lead", "trail", "after_lead", "before_trail")
    found = [Chain(*(np.array([np.nan if r[c] is None else r[c] for r in g]) for c in names)) for g in groups]
    place: dict[int, dict[str, tuple[int, int]]] = {}
    for c, g in enumerate(groups):
        for k, r in enumerate(g):
            for side in ("head", "tail"):
                if r[side]:
                    place.setdefault(r.task, {})[side] = (c, k)
    return found, place


# --- frames of bounded size


def framed(series: Series, before: int, after: int, compute: Callable[[np.ndarray], list[np.ndarray]], column: str, names: list[str], rows: int = 1 << 16, tasks: int | None = None) -> Series:
    """The series with double columns ``names`` that ``compute`` makes of the values of ``column`` in order (missing as NaN), where a row's results
    depend on the ``before`` rows before it and the ``after`` rows after it in its series, no further.

    All rows are numbered and cut into chunks of ``rows``, to which the rows that their frames reach are copied; a chunk may hold many series.
    """
    dealt = deal(series, tasks)
    counts = sorted((r._task, r["count"]) for r in dealt.groupBy("_task").count().collect())  # a row a task
    begin, offsets = 0, []
    for task, n in counts:
        offsets.append((task, begin))
        begin += n
    spark = series.df.sparkSession
    placed = dealt.join(F.broadcast(spark.createDataFrame(offsets, "_task int, _begin long")), "_task")
    at = F.col("_begin") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))  # monotonically_increasing_id() counts below bit 33
    own = F.floor(F.col("_at") / rows)
    copied = placed.withColumn("_at", at).withColumn("_chunk", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("_at") - after) / rows)), F.floor((F.col("_at") + before) / rows)))).withColumn("_own", F.col("_chunk") == own)
    columns = series.df.columns
    schema = series.df.select("*").schema
    for name in names:
        schema = schema.add(name, "double")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        x, codes = numbers(table, column), table.column("_series").to_numpy()
        out = [np.empty(len(x)) for _ in names]
        for lo, hi in stretches(codes):
            for whole, some in zip(out, compute(x[lo:hi]), strict=True):
                whole[lo:hi] = some
        table = pa.table([*[table.column(c) for c in columns], *[pa.array(o, from_pandas=True) for o in out], table.column("_own")], [*columns, *names, "_own"])
        return table.filter(table.column("_own")).drop_columns(["_own"])

    return Series(copied.groupBy("_chunk").applyInArrow(run, schema), series.order_by, series.partition_by)


def running_totals(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``df`` with, for each (name, column), the sum of the column over all rows up to this one in the order of a unique column.

    Rows are dealt out by range and written down; what tasks sum up to is a row a task.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    dealt = checkpointed(df.repartitionByRange(by).withColumn("_task", F.spark_partition_id()))
    tasks = dealt.groupBy("_task").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("_task").collect()
    rows, before = [], [0] * len(sums)
    for t in tasks:
        rows.append((t._task, *before))
        before = [b + (t[n] or 0) for b, n in zip(before, sums, strict=True)]
    kinds = {f.name: f.dataType.simpleString() for f in dealt.agg(*[F.sum(c).alias(n) for n, c in sums.items()]).schema}
    offsets = dealt.sparkSession.createDataFrame(rows, "_task int, " + ", ".join(f"`_off_{n}` {kinds[n]}" for n in sums))
    upto = Window.partitionBy("_task").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(offsets), "_task").withColumns({n: F.sum(c).over(upto) + F.col(f"_off_{n}") for n, c in sums.items()}).drop("_task", *[f"_off_{n}" for n in sums])
