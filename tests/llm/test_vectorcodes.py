"""Vector codes against plain loops over all entries."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from auroral.llm import queries, vectorcodes

SCHEMA = "vec_id long, embedding array<double>, label int, code int, n long, `__k` string"


def plain(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label), unique ids; the contract word by word."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        sums = [{} for _ in range(parts)]
        for x in cut:
            for p in range(parts):
                sums[p].setdefault(assign(p, x[p])[1], []).append(x[p])
        for p in range(parts):
            for e, some in sums[p].items():
                books[p][e] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    found = [[assign(p, x[p]) for p in range(parts)] for x in cut]
    errors, labels = [sum(d for d, _ in f) for f in found], {}
    for (_, _, y), e in zip(kept, errors, strict=True):
        labels[y] = labels.get(y, 0) + e
    return sorted((i, "".join(f"{e:02x}" for _, e in f), e, labels[y], digest) for (i, _, y), f, e in zip(kept, found, errors, strict=True))


def test_registered_query_equals_plain_loops(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = queries.queries()["op13_vector_codes"](spark, folder)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = plain_fast(rows)
    assert sorted(map(tuple, got.collect())) == want


def plain_fast(rows, parts=4, entries=256, rounds=4):
    """plain() with every distance in one array: argmin takes the first of equals."""
    kept = sorted((i, v, y) for i, v, y in rows)
    x = np.floor(1024 * np.array([v for _, v, _ in kept])).astype(np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        apart = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        index = apart.argmin(2)
        for p in range(parts) if k < rounds else ():
            for e in np.unique(index[:, p]):
                some = x[index[:, p] == e, p]
                books[p, e] = some.sum(0) // len(some)
    errors = apart.min(2).sum(1)
    labels = {y: int(sum(e for e, (_, _, z) in zip(errors, kept, strict=True) if z == y)) for y in {y for _, _, y in kept}}
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for e in f), int(d), labels[y], digest) for (i, _, y), f, d in zip(kept, index.tolist(), errors, strict=True))


@pytest.mark.parametrize("grid", [2, 5, 40])
def test_ties_nulls_and_negative_numbers(spark, grid):
    rng = random.Random(grid)
    rows = [(k, [rng.randrange(-grid, grid) / 1024 for _ in range(8)], rng.choice([None, 0, 1, 2])) for k in range(150)]
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 7, 1), (1002, [math.nan] + [0.0] * 7, 1), (1003, [math.inf] + [0.0] * 7, None), (1004, [-0.0] * 8, 7)]
    vectors = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    got = vectorcodes.compress(vectors, entries=20, rounds=3)
    assert sorted(map(tuple, got.collect())) == plain(rows, entries=20, rounds=3)


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    for scale in (1e4, 1e6):  # beyond exact doubles; beyond int64 inside a distance
        rows = [(k, [rng.uniform(-scale, scale) for _ in range(8)], k) for k in range(60)]
        vectors = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
        assert sorted(map(tuple, vectorcodes.compress(vectors, entries=12, rounds=2).collect())) == plain(rows, entries=12, rounds=2)
    rows = [(0, [1e300] * 4, 0), (1, [-1e300] * 4, 0)]
    assert vectorcodes.integers(pa.array([rows[0][1]]), 4)[0, 0] == int(1e300) * 1024
    tree = vectorcodes.KdTree.build(np.array([[int(1e300)], [-int(1e300)]], object))
    assert tree.nearest(np.array([[5], [-5], [0]], object))[0].tolist() == [0, 1, 0]


def test_repeated_keys_few_rows_and_none(spark):
    rows = [(1, [0.5] * 4, None), (1, [0.25] * 4, None), (None, [0.125] * 4, 3), (2, [0.5] * 4, 3), (2, [0.5] * 4, 3), (9, [0.5] * 3, 3), (9, [], 3)]
    vectors = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = vectorcodes.compress(vectors, entries=3)
    # the codebooks start as 256, 512, 512; the third stays unused, the first becomes (256 + 128) // 2
    assert sorted(((r.vec_id, r.code, r.error) for r in got.collect()), key=str) == sorted([(1, "00000000", 4 * 64**2), (1, "01010101", 0), (2, "01010101", 0), (2, "01010101", 0), (None, "00000000", 4 * 64**2)], key=str)
    assert vectorcodes.compress(vectors.limit(0)).collect() == []
    assert vectorcodes.compress(vectors.where("vec_id = 77")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vectorcodes.train(spark.createDataFrame([(1, [0.5] * 6, 1, 1, 2, "x")], SCHEMA))


def test_trees_find_the_lowest_of_equally_near_entries():
    rng = np.random.default_rng(4)
    for width, grid, entries in ((1, 3, 256), (2, 4, 200), (16, 2, 256), (3, 1000, 9)):
        book = rng.integers(-grid, grid, (entries, width))
        x = rng.integers(-grid, grid, (500, width))
        apart = ((x[:, None, :] - book[None]) ** 2).sum(2)
        for kind in (np.float64, np.int64, object):
            index, least = vectorcodes.KdTree.build(book.astype(kind)).nearest(x.astype(kind))
            assert (index == apart.argmin(1)).all() and (least == apart.min(1)).all()
