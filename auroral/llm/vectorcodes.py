"""Product codes of vectors: integer Lloyd rounds with a kd-tree for each part's codebook.

A vector is cut into equal parts; each part has a codebook of ``entries`` integer vectors, which are few
and go to the tasks as kd-trees in a broadcast each round. A part's nearest entry is found by branch and
bound: the parts of a batch first go down to the leaf where they lie, then each node is searched by those
whose best distance its box doesn't exceed. Equal bounds are visited too, so that of equally near entries the
lowest index wins. Tasks return sums and counts for each entry; Spark adds them up and the driver keeps the codebooks alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_each, materialise

SCALE = 1024
LEAF = 32
#: Vectors that walk the trees at a time.
BATCH = 1 << 12


def number_type(bound: int, width: int) -> type:
    """The fastest type in which squared distances of ``width`` components within +-bound are exact."""
    most = 4 * width * bound**2  # also what |x|^2 - 2 x c + |c|^2 is made of
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


@dataclass
class KdTree:
    """Nodes as arrays: bounding box, children (-1: leaf), the dimension and value that part them and, for leaves, ``LEAF`` entry indexes at most (-1: none), ascending."""

    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    members: np.ndarray
    dim: np.ndarray
    split: np.ndarray

    @classmethod
    def build(cls, entries: np.ndarray) -> KdTree:
        """Halves the entries at the median of the dimension in which they spread most."""
        low, high, left, right, members, dims, splits = [], [], [], [], [], [], []

        def grow(index: np.ndarray) -> int:
            node = len(low)
            some = entries[index]
            low.append(some.min(0))
            high.append(some.max(0))
            left.append(-1)
            right.append(-1)
            members.append(np.full(LEAF, -1))
            dim = int(np.argmax(high[node] - low[node]))
            order = index[np.argsort(some[:, dim], kind="stable")]
            dims.append(dim)
            splits.append(entries[order[(len(order) - 1) // 2], dim])
            if len(index) <= LEAF:
                members[node][: len(index)] = np.sort(index)
            else:
                left[node] = grow(order[: (len(order) + 1) // 2])
                right[node] = grow(order[(len(order) + 1) // 2 :])
            return node

        grow(np.arange(len(entries)))
        return cls(entries, np.array(low), np.array(high), np.array(left), np.array(right), np.array(members), np.array(dims), np.array(splits))

    def _bound(self, x: np.ndarray, node: int) -> np.ndarray:
        """Squared distances of the vectors to the node's box."""
        off = np.maximum(self.low[node] - x, x - self.high[node])
        np.maximum(off, 0, out=off)
        return (off * off).sum(1) if x.dtype == object else np.einsum("ij,ij->i", off, off)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each vector's nearest entry, the lowest among equals, and the squared distance. ``x`` and the entries have one type."""
        n, kind = len(x), x.dtype
        best = np.full(n, np.iinfo(np.int64).max if kind == np.int64 else math.inf, kind)
        index = np.full(n, len(self.entries))
        everyone = np.arange(n)

        def compare(node: int, rows: np.ndarray) -> None:
            tips = self.members[node]
            tips = tips[tips >= 0]
            some, entries = x[rows], self.entries[tips]
            # exact, as the type was chosen to hold four times what these terms can be
            apart = (some * some).sum(1)[:, None] - 2 * (some @ entries.T) + (entries * entries).sum(1)
            which = apart.argmin(1)  # the first of equals: tips ascend
            least, which = apart[np.arange(len(rows)), which], tips[which]
            better = ((least < best[rows]) | (least == best[rows]) & (which < index[rows])).astype(bool)
            best[rows[better]], index[rows[better]] = least[better], which[better]

        def descend(node: int, rows: np.ndarray) -> None:
            """To the leaf in whose direction each vector lies: a first distance to prune by."""
            if not len(rows):
                return
            if self.left[node] < 0:
                compare(node, rows)
                return
            left = (x[rows, self.dim[node]] <= self.split[node]).astype(bool)
            descend(self.left[node], rows[left])
            descend(self.right[node], rows[~left])

        def search(node: int, rows: np.ndarray) -> None:
            """Every node whose bound is the best distance or less, equal ones included."""
            rows = rows[(self._bound(x[rows], node) <= best[rows]).astype(bool)]
            if not len(rows):
                return
            if self.left[node] < 0:
                compare(node, rows)
                return
            search(self.left[node], rows)
            search(self.right[node], rows)

        if n:
            descend(0, everyone)
            search(0, everyone)
        return index, best


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of all components, a vector a row: int64, or Python integers where that is too small."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    if not x.size or np.abs(x).max() < 2.0**52:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE) for v in r] for r in x.tolist()], object).reshape(-1, width)


def largest(*arrays: np.ndarray) -> int:
    return max((max(abs(int(a.min())), abs(int(a.max()))) for a in arrays if a.size), default=0)


def _assigned(x: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part, the entries' indexes and squared distances (Python integers where int64 is too small)."""
    width = x.shape[1] // len(books)
    for p, book in enumerate(books):
        part = x[:, p * width : (p + 1) * width]
        exact = number_type(largest(part, book), width)
        tree = KdTree.build(book.astype(exact))
        index, apart = tree.nearest(part.astype(exact))
        yield index, apart if exact is object else apart.astype(np.int64)


def finite(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _sums(rows: DataFrame, books, parts: int, width: int) -> DataFrame:
    """(part, entry, n, sums array<string>): what this round adds to each entry, a row for each task and used entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = books.value
        size = len(held[0])
        sums, counts = np.zeros((parts, size, width), object), np.zeros((parts, size), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                x = integers(batch.column(0).slice(lo, BATCH), parts * width)
                if largest(x) >= 1 << 62 - BATCH.bit_length():
                    x = x.astype(object)  # a batch's sums might not fit
                for p, (index, _) in enumerate(_assigned(x, held)):
                    order = np.argsort(index, kind="stable")
                    used, first = np.unique(index[order], return_index=True)
                    sums[p, used] += np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0).astype(object)
                    counts[p] += np.bincount(index, minlength=size)
        part, entry = np.nonzero(counts)
        said = [[str(v) for v in sums[p, e]] for p, e in zip(part.tolist(), entry.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), pa.array(said, pa.list_(pa.string()))], ["part", "entry", "n", "sums"])
        give_back()

    return rows.mapInArrow(run, "part int, entry int, n long, sums array<string>")


def train(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """The codebooks, an array (entries, width) of integers for each part; none where no vector is kept.

    They start as the parts of the ``entries`` vectors of least key (ties: lesser vector); a round replaces each entry by the floor of its
    parts' mean, unused ones stay. Vectors that are null, hold a null or non-finite component, or have another length than the first
    are left out. ValueError if that length is no multiple of ``parts``. Sums are exact at any number of rows. A round reads the vectors once.
    """
    kept = vectors.where(finite(vector))
    first = kept.select(vector, key).orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).collect()
    if not first:
        return []
    length = len(first[0][0])
    if not length or length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    width = length // parts
    start = integers(pa.array([r[0] for r in first if len(r[0]) == length], pa.list_(pa.float64())), length)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    rows = kept.where(F.size(vector) == length).select(vector)
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(books)
        added = _sums(rows, sent, parts, width).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)])
        fresh = [b.astype(object) for b in books]
        for r in added.collect():  # parts x entries rows
            fresh[r.part][r.entry] = [int(r[f"s{k}"]) // r.n for k in range(width)]
        sent.unpersist()
        books = [b.astype(np.int64) if largest(b) < 1 << 62 else b for b in fresh]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """``vectors`` with code (two hex digits of the entry for each part, in order) and error (squared distances, summed over the parts).

    Vectors that can't be compared with the codebooks (null, non-finite, of another length) are left out. An error beyond a long fails.
    """
    length = sum(b.shape[1] for b in books)
    kept = vectors.where(finite(vector) & (F.size(vector) == length))
    if not books:
        return kept.limit(0).withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})
    digits = np.array([f"{k:02x}" for k in range(len(books[0]))])
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    at = kept.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                rows = batch.slice(lo, BATCH)
                x = integers(rows.column(at), length)
                code, error = np.full(len(x), "", object), np.zeros(len(x), object)
                for index, apart in _assigned(x, sent.value):
                    code += digits[index].astype(object)
                    error += apart.astype(object)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(code.tolist(), pa.string()), pa.array(error.tolist(), pa.int64())], [*rows.schema.names, "code", "error"])
        give_back()

    schema = kept.select("*").schema.add("code", "string").add("error", "long")
    return kept.mapInArrow(run, schema)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector kept: train() and encode(), with the errors of equal labels summed (null is a label).

    Rows of repeated keys are rows of their own; no rows give no rows. Labels that many rows share are joined apart.
    """
    vectors = vectors.select(key, F.col(vector).alias("__v"), F.when(F.col(label).isNotNull(), F.concat(F.lit("="), F.col(label).cast("string"))).otherwise("").alias("__k"))
    books = train(vectors, "__v", key, parts, entries, rounds)
    coded = materialise(encode(vectors, books, "__v").select(key, "__k", "code", "error"), "vector-codes")
    sums = materialise(coded.groupBy("__k").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")), "vector-labels")
    total = sums.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return join_each(coded, sums, "__k", total).select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same in SQL by comparing every part with every entry; components must be small enough for exact doubles."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
        book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""met{k} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
                SELECT vec_id, label, cut.p, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM cut JOIN book{k} USING (p)) GROUP BY vec_id, label, p, x)"""
        )
        if k < rounds:
            steps.append(
                f"""mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(v) / count(*)) AS m FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM met{k}) GROUP BY p, e, i) GROUP BY p, e),
                book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)"""
            )
    steps.append(
        f"""coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM met{rounds} GROUP BY vec_id, label),
        said AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, generate_subscripts(c, 1) AS i, unnest(c) AS v FROM book{rounds}))"""
    )
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, said"
