"""Benchmark decontamination with a generalised suffix automaton over words.

The items' words build one automaton per shard of bounded size; each shard is one
streaming pass over the documents that tracks the longest match ending at every
word. Stretches in which fewer consecutive words than the shortest window occur
anywhere in the items cannot hold an occurrence and are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialise
from .tokens import WORDS, chunks

#: Words of items in one automaton; more items make more shards, each a pass of its own.
SHARD_WORDS = 200_000
#: Shards that one job passes the documents through, and that the driver holds, at once.
PASSES = 8


class SuffixAutomaton:
    """All word sequences of several items; knows which windows of ``window`` words (or whole shorter items) belong to which items."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.window = window
        #: (state, words) of each window and the items that hold it
        self.owners: dict[tuple[int, int], set[str | None]] = {}
        for item, words in items:
            size = min(window, len(words))
            state = length = 0
            for word in words:
                state, length = self.step(state, length, word)
                if length >= size > 0:
                    self.owners.setdefault((self._at(state, size), size), set()).add(item)
        sizes = sorted({size for _, size in self.owners})
        self.sizes = sizes
        self.shortest = sizes[0] if sizes else 0

    def _copy(self, of: int, length: int) -> int:
        self.next.append(dict(self.next[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.next) - 1

    def _redirect(self, state: int, word: int, old: int, new: int) -> None:
        while state != -1 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # another item went this way
            there = self.next[last][word]
            if self.length[there] == self.length[last] + 1:
                return there
            twin = self._copy(there, self.length[last] + 1)
            self.link[there] = twin
            self._redirect(last, word, there, twin)
            return twin
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, state = len(self.next) - 1, last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state != -1:
            there = self.next[state][word]
            if self.length[there] != self.length[state] + 1:
                twin = self._copy(there, self.length[state] + 1)
                self.link[there] = twin
                self._redirect(state, word, there, twin)
                there = twin
            self.link[new] = there
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest suffix of what was read that occurs in an item, after one more word."""
        move = self.next[state]
        if word in move:
            return move[word], length + 1
        while state and word not in self.next[state]:
            state = self.link[state]
        if word not in self.next[state]:
            return 0, 0
        return self.next[state][word], self.length[state] + 1

    def _at(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words of a longer match."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[str | None]]]:
        """(end, length, items) of windows that end at each word, one for each window size."""
        state = length = 0
        for at, word in enumerate(words):
            state, length = self.step(state, length, word)
            if length >= self.shortest:
                for size in self.sizes:
                    if size > length:
                        break
                    owners = self.owners.get((self._at(state, size), size))
                    if owners:
                        yield at + 1, size, owners


def item_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kind = WORDS[data] > 0
    lower = data + np.where((data >= 0x41) & (data <= 0x5A), 32, 0).astype(np.uint8)
    return np.where(kind, lower, 32).astype(np.uint8).tobytes().split(b" ") if len(data) else []


def _shards(items: DataFrame, shard_words: int, window: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items of about ``shard_words`` words in all. A longer item is cut; its parts overlap by a window less a word, so that each window is in one."""
    held, words = [], 0
    for item, text in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        whole = [w for w in item_words(text) if w]
        for at in range(0, len(whole), shard_words):
            own = whole[at : at + shard_words + window - 1]
            if at and len(own) < window:
                break
            if held and words + len(own) > shard_words:
                yield held
                held, words = [], 0
            held.append((item, own))
            words += len(own)
    if held:
        yield held


def _scanner(shard, window: int, extra: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell: dict[bytes, int] = {}
        items = [(item, [spell.setdefault(w, len(spell)) for w in words]) for item, words in shard.value] if shard else []
        automaton = SuffixAutomaton(items, window)
        words = list(spell)
        column = pa.array([b.decode("utf-8", "surrogatepass") for b in words], pa.string())
        hashes = np.zeros(len(words), np.uint64)
        for chunk in chunks(column):
            hashes[chunk.lo : chunk.hi] = chunk.tokens(WORDS)[2]
        order = np.argsort(hashes)
        known = hashes[order]
        for batch in batches:
            spans_before, items_before = (batch.column(k).to_pylist() for k in (3, 4))
            for chunk in chunks(batch.column(1)):
                n = chunk.hi - chunk.lo
                starts, ends, own, rows = chunk.tokens(WORDS, lower=True)
                first = np.searchsorted(rows, np.arange(n + 1))
                spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                found: list[set] = [set() for _ in range(n)]
                if len(own) and len(known):
                    at = np.searchsorted(known, own)
                    at[at == len(known)] = 0
                    ids = np.where(known[at] == own, order[at], -1)
                    lower = chunk.data + np.where((chunk.data >= 0x41) & (chunk.data <= 0x5A), 32, 0).astype(np.uint8)
                    flags = np.concatenate([[False], ids >= 0, [False]])
                    for run_lo, run_hi in _runs(flags, rows, automaton.shortest):
                        row = rows[run_lo]
                        text = lower[starts[run_lo] : ends[run_hi - 1]].tobytes()
                        base = starts[run_lo]
                        run_ids = [i if text[s - base : e - base] == words[i] else -1 for i, s, e in zip(ids[run_lo:run_hi].tolist(), starts[run_lo:run_hi].tolist(), ends[run_lo:run_hi].tolist(), strict=True)]
                        for end, size, owners in automaton.matches(run_ids):
                            hi = run_lo - int(first[row]) + end
                            lo = hi - size
                            if spans[row] and spans[row][-1][1] >= lo:
                                while spans[row] and spans[row][-1][1] >= lo:
                                    a, b = spans[row].pop()
                                    lo, hi = min(a, lo), max(b, hi)
                            spans[row].append((lo, hi))
                            found[row] |= owners
                sizes = np.diff(first)
                rows_out = batch.slice(chunk.lo, n)
                merged = [_union(x, [(y["lo"], y["hi"]) for y in old or []]) for x, old in zip(spans, spans_before[chunk.lo : chunk.hi], strict=True)]
                names = [sorted({x for x in f if x is not None} | set(old or [])) for f, old in zip(found, items_before[chunk.lo : chunk.hi], strict=True)]
                columns = [rows_out.column(0), rows_out.column(1), pa.array(sizes, pa.int64()), pa.array([[{"lo": a, "hi": b} for a, b in x] for x in merged], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array(names, pa.list_(pa.string()))]
                columns += [rows_out.column(5 + k) for k in range(len(extra))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_words", "spans", "items", *extra])

    return run


def _runs(flags: np.ndarray, rows: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Stretches of at least ``shortest`` flagged tokens of one row."""
    inner = flags[1:-1]
    begin = inner & ~(flags[:-2] & np.append(False, rows[1:] == rows[:-1]))
    close = inner & ~(flags[2:] & np.append(rows[1:] == rows[:-1], False))
    lo, hi = np.flatnonzero(begin), np.flatnonzero(close) + 1
    keep = hi - lo >= max(shortest, 1)
    return list(zip(lo[keep].tolist(), hi[keep].tolist(), strict=True))


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*a, *b]):
        if out and out[-1][1] >= lo:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _in_turn(passes: list):
    """The passes one after the other in one Python worker; as operators of their own each would have a worker for every task, which lives on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in passes:
            batches = one(batches)
        yield from batches
        give_back()

    return run


def _passes(docs: DataFrame, items: DataFrame, window: int, shard_words: int, extra: tuple[str, ...]) -> tuple[DataFrame, list, str]:
    """Rows, the passes of scan() over them that are still to be made, and the schema these give."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    rows = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), *extra)
    context = docs.sparkSession.sparkContext
    held, found = [], None
    for shard in _shards(items, shard_words, window):
        if len(held) == PASSES:  # what these found is written down before the next are read; what it was made of goes
            out = rows.mapInArrow(_in_turn([_scanner(h, window, extra) for h in held]), schema)
            before, found = found, materialise(out, "decontaminate-found")
            if before is not None:
                discard(before)
            rows = found
            for done in held:
                done.destroy()
            held = []
        held.append(context.broadcast(shard))
    return rows, [_scanner(h, window, extra) for h in held or [None]], schema


def scan(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Where benchmark windows occur in documents.

    ``docs`` has doc_id and text, ``items`` item_id and text; further columns are left out, but for those in ``extra``. A window is
    ``window`` consecutive words of an item, or a whole item of fewer words. Returns a row for each row of
    ``docs``: doc_id, text, n_words, spans array<struct<lo int, hi int>> (disjoint, ascending runs of words
    that windows cover, ``hi`` excluded), items array<string> (ids of the items with a window here, sorted).
    Null texts have no words; items without words match nothing; hits of items with a null id have spans but
    no id; repeated item ids count once; an empty items table gives no spans.
    """
    rows, passes, schema = _passes(docs, items, window, shard_words, extra)
    return rows.mapInArrow(_in_turn(passes), schema)


def _remover(min_words: int, max_coverage: float, extra: tuple[str, ...]):
    kept = ["doc_id", "text", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            hit = [[s for s in x if s["hi"] - s["lo"] >= min_words] for x in spans]
            clean = np.array([not x for x in hit], bool)
            yield batch.filter(pa.array(clean)).select(kept)
            for i in np.flatnonzero(~clean).tolist():
                one = batch.slice(i, 1)
                chunk = next(chunks(one.column("text")))
                starts, ends, _, _ = chunk.tokens(WORDS, lower=True)
                if sum(s["hi"] - s["lo"] for s in hit[i]) > max_coverage * len(starts):
                    continue
                data, out, at = chunk.data.tobytes(), [], 0
                for s in hit[i]:
                    out.append(data[at : starts[s["lo"]]])
                    at = ends[s["hi"] - 1]
                out.append(data[at:])
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), pa.array([b"".join(out).decode("utf-8", "replace")], pa.string()), *[one.column(c) for c in extra]], kept)

    return run


def remove_spans(scanned: DataFrame, min_words: int = 10, max_coverage: float = 0.8, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *extra) without the spans of scan() that have at least ``min_words`` words; shorter spans stay.

    A document of which such spans cover more than ``max_coverage`` of the words is dropped whole. Texts
    without such a span stay as they are, byte for byte; elsewhere a span goes with its inner separators.
    """
    kind = scanned.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{c}` {scanned.schema[c].dataType.simpleString()}" for c in extra)
    return scanned.select("doc_id", "text", "spans", *extra).mapInArrow(_remover(min_words, max_coverage, extra), f"doc_id {kind}, text string{more}")


def scan_and_remove(docs: DataFrame, items: DataFrame, window: int = 10, min_words: int = 10, max_coverage: float = 0.8, shard_words: int = SHARD_WORDS, extra: tuple[str, ...] = ()) -> DataFrame:
    """remove_spans(scan()) with one Python worker for a task."""
    rows, passes, _ = _passes(docs, items, window, shard_words, extra)
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    return rows.mapInArrow(_in_turn([*passes, _remover(min_words, max_coverage, extra)]), f"doc_id {kind}, text string{more}")


def digest(scanned: DataFrame) -> DataFrame:
    """scan() as counts and a digest of the item ids."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: digest(scan(documents, benchmark)) in DuckDB's SQL
ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM iw WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM wins),
dwin AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes)),
hits AS (SELECT d.doc_id, d.size, d.i, s.item_id FROM dwin d JOIN wins s ON d.size = s.size AND d.win = s.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
