"""N-gram Jaccard join with Bayesian candidate pruning, and its classes.

Documents with equal shingle sets are one node. Bands of MinHash values put nodes
into buckets; only nodes that meet in a bucket can be similar. A node's anchor is
the least node that a few steps from bucket to bucket reach, so that a group of
copies has one, and the nodes of one anchor make chunks of bounded size. Two chunks that meet in a bucket are a job, and so is each chunk by
itself: its pairs are compared by a few MinHash values at a time, dropping a pair
once the posterior probability that it reaches the threshold is below the
tolerance, and the pairs left exactly, by their shingle sets. A job returns the
number of links of each node and what they connect, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, give_back, join_each, materialise
from .tokens import WHITESPACE, chunks, mix

_EMPTY = np.uint64(0x5DEECE66D)


@dataclass(frozen=True)
class Settings:
    """With 42 bands of 6 values a pair of similarity 0.8 shares no band with a probability of 3 in a million."""

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 42
    band_rows: int = 6
    compare: tuple[int, ...] = (16, 32, 64, 128)
    tolerance: float = 1e-7
    chunk_nodes: int = 2048
    chunk_shingles: int = 1 << 20
    task_shingles: int = 1 << 19


def shingles(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, distinct shingle hashes in order of row and value, their rows); texts of fewer words are one shingle."""
    for chunk in chunks(column):
        _, _, h, r = chunk.tokens(WHITESPACE)
        n_rows = chunk.hi - chunk.lo
        count = np.bincount(r, minlength=n_rows)
        keys, owners = [], []
        for k in range(1, size + 1):
            # whole texts of k words; from `size` words on, every window
            n = len(h) - k + 1
            if n <= 0:
                continue
            start = np.flatnonzero((r[:n] == r[k - 1 :]) & ((count[r[:n]] == k) if k < size else True))
            acc = np.full(len(start), k, np.uint64)
            for j in range(k):
                acc = mix(acc + h[start + j])
            keys.append(acc)
            owners.append(r[start])
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((key, own))
        key, own = key[order], own[order]
        new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))[: len(key)]
        yield chunk.lo, n_rows, key[new], own[new]


def node_ids(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One hash for the shingle set of each row, and the set's size."""
    size = np.bincount(rows, minlength=n)
    total = np.zeros(n, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        total[full] = np.add.reduceat(mix(keys ^ _EMPTY), np.searchsorted(rows, full))
    return mix(total + size.astype(np.uint64)).astype(np.int64), size


def minhashes(keys: np.ndarray, rows: np.ndarray, n: int, count: int) -> np.ndarray:
    """(n, count) MinHash values of 32 bits; all bits set for empty rows."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.full((n, count), 0xFFFFFFFF, np.uint32)
    full = np.unique(rows)
    if len(full):
        start = np.searchsorted(rows, full)
        for k in range(count):
            out[full, k] = (np.minimum.reduceat(keys * factors[k] + shifts[k], start) >> np.uint64(32)).astype(np.uint32)
    return out


def fewest_matches(settings: Settings) -> list[int]:
    """For each number of compared values: the fewest matches at which, with a uniform prior, the posterior probability of the threshold is not below the tolerance."""

    def posterior(matches: int, of: int) -> float:
        t = settings.threshold
        return sum(math.comb(of + 1, k) * t**k * (1 - t) ** (of + 1 - k) for k in range(matches + 1))

    return [next(m for m in range(of + 1) if posterior(m, of) >= settings.tolerance) for of in settings.compare]


def _sketcher(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, keys, rows in shingles(batch.column(2), settings.shingle):
                node, size = node_ids(keys, rows, n)
                values = minhashes(keys, rows, n, settings.bands * settings.band_rows).astype(np.uint64).reshape(n, settings.bands, settings.band_rows)
                band = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), (n, settings.bands)).copy()
                for k in range(settings.band_rows):
                    band = mix(band + values[:, :, k])
                flat = pa.array(band.astype(np.int64).ravel())
                at = np.arange(n + 1) * settings.bands
                at[1:] = np.cumsum(np.where(size > 0, settings.bands, 0))  # a text without words meets only its copies
                if (size == 0).any():
                    flat = pa.array(band[size > 0].astype(np.int64).ravel())
                bands = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
                row, doc_id, text = (batch.column(k).slice(lo, n) for k in range(3))
                yield pa.RecordBatch.from_arrays([row, doc_id, pa.array(node), pa.array(size, pa.int32()), bands, text], ["row", "doc_id", "node", "size", "bands", "text"])
        give_back()

    return run


def _linker(settings: Settings):
    least = fewest_matches(settings)

    def links(sets: list[np.ndarray], values: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
        """Boolean matrix of the pairs (left, right) that reach the threshold."""
        of = settings.compare[0]
        matches = np.zeros((len(left), len(right)), np.int16)
        for k in range(of):
            matches += values[left, k][:, None] == values[right, k][None, :]
        alive = matches >= least[0]
        if same:
            alive &= np.tri(len(left), k=-1, dtype=bool).T
        a, b = np.nonzero(alive)
        m = matches[a, b].astype(np.int32)
        for step in range(1, len(settings.compare)):
            more = settings.compare[step]
            for at in range(0, len(a), 1 << 16):
                part = slice(at, at + (1 << 16))
                m[part] += (values[left[a[part]], of:more] == values[right[b[part]], of:more]).sum(axis=1)
            keep = m >= least[step]
            a, b, m, of = a[keep], b[keep], m[keep], more
        out = np.zeros((len(left), len(right)), bool)
        if len(a):
            out[a, b] = exact(sets, left, right, a, b)
        return out

    def exact(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = np.array([len(s) for s in sets])
        if len(a) < 64:
            common = np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)) for i, j in zip(a, b, strict=True)])
        else:  # shared shingles of many pairs at once: products of incidence matrices, some columns at a time
            ua, ub = np.unique(a), np.unique(b)
            both = np.concatenate([left[ua], right[ub]])
            flat = np.concatenate([sets[k] for k in both])
            owner = np.repeat(np.arange(len(both)), size[both])
            _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
            keep = times[column] > 1
            _, column = np.unique(column[keep], return_inverse=True)
            owner = owner[keep]
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            product = np.zeros((len(ua), len(ub)), np.float32)
            width = 4096
            for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                i, j = np.searchsorted(column, [lo, lo + width])
                block = np.zeros((len(both), width), np.float32)
                block[owner[i:j], column[i:j] - lo] = 1
                product += block[: len(ua)] @ block[len(ua) :].T
            common = product[np.searchsorted(ua, a), np.searchsorted(ub, b)]
        whole = size[left[a]] + size[right[b]] - common
        return common >= settings.threshold * whole - 1e-6

    def run(table: pa.Table) -> pa.Table:
        jobs, side = np.array(table.column("job").to_pylist(), np.int64), np.array(table.column("side").to_pylist(), np.int64)
        wanted = np.array(table.column("node").to_pylist(), np.int64)
        sets: list[np.ndarray] = []
        values = []
        for _, n, keys, rows in shingles(table.column("text"), settings.shingle):
            sets += np.split(keys, np.searchsorted(rows, np.arange(1, n)))
            values.append(minhashes(keys, rows, n, settings.compare[-1]))
        values = np.concatenate(values) if values else np.zeros((0, settings.compare[-1]), np.uint32)
        out_node, out_links, out_root = [], [], []
        for job in np.unique(jobs):
            own = np.flatnonzero(jobs == job)
            left, right = own[side[own] != 2], own[side[own] != 1]
            same = not (side[own] == 1).any() and not (side[own] == 2).any()
            if not len(left) or not len(right):
                continue
            met = links(sets, values, left, right, same)
            if same:
                met |= met.T
            members = left if same else np.concatenate([left, right])
            degree = met.sum(axis=1) if same else np.concatenate([met.sum(axis=1), met.sum(axis=0)])
            root = wanted[members].copy()
            rows, cols = np.nonzero(met)
            if not same:
                cols = cols + len(left)
            while len(rows):  # the least node that the links lead to
                before = root.copy()
                np.minimum.at(root, rows, root[cols])
                np.minimum.at(root, cols, root[rows])
                if (root == before).all():
                    break
            hit = degree > 0
            out_node += wanted[members[hit]].tolist()
            out_links += degree[hit].tolist()
            out_root += root[hit].tolist()
        sets, values = [], None
        give_back()
        return pa.table({"node": pa.array(out_node, pa.int64()), "links": pa.array(out_links, pa.int64()), "root": pa.array(out_root, pa.int64())})

    return run


def similarity_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for every row of (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of ``settings.shingle``-word shingles (words between
    ASCII white space, unchanged; a text of fewer words is one shingle) is at least the threshold. class_id is the least doc_id of all documents
    that links and equal sets connect with this one; n_links is the number of other distinct shingle sets linked with this
    one's; n_copies is the number of rows with this set. Null and empty texts and those of white space are copies of one
    another, without links. Rows of equal ids, or of none, are documents of their own; a null doc_id is no class_id, so that
    a class of such rows alone has none. Further columns are left out. Jobs run while this is called; the result is read
    from the shared folder.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    sketches = materialise(numbered.mapInArrow(_sketcher(settings), f"row long, doc_id {kind}, node long, size int, bands array<long>, text string"), "near-sketches")
    members = materialise(sketches.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("rep"), F.max("size").alias("size"), F.count("*").alias("n_copies")), "near-members")
    n_rows, n_nodes = sketches.count(), members.count()
    # nodes that meet others, and where
    bands = sketches.select("row", "node", "bands").join(members.select("row").hint("merge"), "row", "left_semi").select("node", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("__n")).where(F.col("__n") > 1)
    ties = materialise(join_each(bands, buckets, "key", settings.bands * n_nodes), "near-ties")
    n_ties = ties.count()
    # chunks of the nodes of one anchor
    anchors = ties.groupBy("node").agg(F.min("low").alias("anchor"))
    for _ in range(2):
        reach = ties.select("key", "node").join(anchors.hint("merge"), "node").groupBy("key").agg(F.min("anchor").alias("anchor"), F.count("*").alias("__n"))
        passed = join_each(ties.select("key", "node"), reach, "key", n_ties).groupBy("node").agg(F.min("anchor").alias("anchor"))
        anchors = materialise(passed, "near-anchors")
    tied = anchors.join(members.select("node", "row", "size").hint("merge"), "node")
    share = tied.groupBy("anchor").agg(F.greatest(F.ceil(F.count("*") / settings.chunk_nodes), F.ceil(F.sum("size") / settings.chunk_shingles), F.lit(1)).alias("parts"), F.count("*").alias("__n"))
    placed = materialise(join_each(tied, share, "anchor", n_nodes).select("node", "row", "size", F.xxhash64("anchor", F.pmod(F.xxhash64("node"), "parts")).alias("chunk")), "near-chunks")
    # a job for each chunk of several nodes and for each two chunks that meet in a bucket
    met = ties.join(placed.select("node", "chunk").hint("merge"), "node").select("key", "chunk").distinct()
    both = met.select("key", F.col("chunk").alias("a")).join(met.select("key", F.col("chunk").alias("b")).hint("merge"), "key").where("a <= b").select("a", "b").distinct()
    filled = placed.groupBy("chunk").agg(F.sum("size").alias("size"), F.count("*").alias("nodes"))
    side = lambda c: filled.select(F.col("chunk").alias(c), F.col("size").alias(f"size_{c}"), F.col("nodes").alias(f"nodes_{c}")).hint("merge")
    jobs = both.join(side("a"), "a").join(side("b"), "b").where("a < b or nodes_a > 1")
    jobs = materialise(jobs.select("a", "b", F.xxhash64("a", "b").alias("job"), (F.col("size_a") + F.when(F.col("a") < F.col("b"), F.col("size_b")).otherwise(0)).alias("weight")), "near-jobs")
    # small jobs share tasks
    small = jobs.where(F.col("weight") < settings.task_shingles).agg(F.sum("weight")).first()[0] or 0
    task = F.when(F.col("weight") < settings.task_shingles, F.pmod("job", F.lit(max(8, math.ceil(small / settings.task_shingles))))).otherwise(F.col("job"))
    dealt = jobs.select("a", "b", "job", task.alias("task"))
    left = dealt.select(F.col("a").alias("chunk"), "task", "job", F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("side"))
    right = dealt.where("a < b").select(F.col("b").alias("chunk"), "task", "job", F.lit(2).alias("side"))
    asked = placed.join(left.unionByName(right).hint("merge"), "chunk").select("row", "node", "task", "job", "side")
    work = sketches.select("row", "text").join(asked.hint("merge"), "row").select("task", "job", "side", "node", "text")
    found = materialise(work.groupBy("task").applyInArrow(_linker(settings), "node long, links long, root long"), "near-links")
    n_links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "near-classes")
    named = members.join(classes.hint("merge"), "node", "left").select("node", "rep", "n_copies", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("__n"))
    told = join_each(named, least, "component", n_nodes).join(n_links.hint("merge"), "node", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies", F.col("n_copies").alias("__n"))
    out = materialise(join_each(sketches.select("doc_id", "node"), told, "node", n_rows).select("doc_id", "class_id", "n_links", "n_copies"), "near-result")
    for used in (sketches, members, ties, anchors, placed, jobs, found, classes):
        discard(used)
    return out


#: similarity_classes(documents) in DuckDB's SQL; classes by recursion over links between distinct sets
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d),
n AS (SELECT g, min(doc_id) AS rep, count(*) AS n_copies FROM s GROUP BY g),
x AS (SELECT rep, len(g) AS size, unnest(g) AS t FROM n),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.size) AS na, any_value(b.size) AS nb FROM x a JOIN x b ON a.t = b.t AND a.rep <> b.rep GROUP BY a.rep, b.rep),
l AS MATERIALIZED (SELECT a, b FROM p WHERE c * 10 >= 8 * (na + nb - c)),
r AS (SELECT rep, rep AS other FROM n UNION SELECT r.rep, l.b FROM r JOIN l ON r.other = l.a),
k AS (SELECT rep, min(other) AS class_id FROM r GROUP BY rep),
q AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT s.doc_id, k.class_id, CAST(coalesce(q.n_links, 0) AS BIGINT) AS n_links, n.n_copies
FROM s JOIN n ON s.g = n.g JOIN k ON n.rep = k.rep LEFT JOIN q ON n.rep = q.a
"""
