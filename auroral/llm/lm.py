"""Stupid-backoff language-model scores of documents.

Documents are dealt into blocks of bounded size. A block sends its distinct
n-grams and their counts to the count table, which is partitioned by n-gram hash;
the table adds up the blocks' counts and answers each block, in the order in which
it asked; the block joins the answers to its documents' n-grams and sums the
scores of each document. A frequent n-gram is asked for once by a block however
often the block holds it, so it makes no partition large. N-grams of one block and
one part of the table travel in one row of the two; a part of which a block has
none gets no row, so that there are never more rows than n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count
from .tokens import WHITESPACE, chunks, mix

ALPHA = 0.4


def _grams(texts: pa.ChunkedArray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each k up to order: hash of the k-gram that ends at each token (0 where its document begins later); the row of each token."""
    hashes, rows = [], []
    for chunk in chunks(texts):
        _, _, h, r = chunk.tokens(WHITESPACE)
        hashes.append(h)
        rows.append(r + chunk.lo)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    out = [mix(h) | np.uint64(1)]
    for k in range(2, order + 1):
        key = np.zeros(len(h), np.uint64)
        n = len(h) - k + 1
        if n > 0:
            acc = np.full(n, k, np.uint64)
            for j in range(k):
                acc = mix(acc + h[j : j + n])
            key[k - 1 :] = np.where(r[:n] == r[k - 1 :], acc | np.uint64(1), np.uint64(0))
        out.append(key)
    return out, r


def _split(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins among sorted keys: a part is a range of hashes."""
    edges = np.array([(k << 64) // parts for k in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _asker(order: int, parts: int, counted: bool):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        grams, rows = _grams(table.column("text"), order)
        out = []
        for k, keys in enumerate(grams):
            unique, count = np.unique(keys[keys != 0], return_counts=True)
            at = _split(unique, parts)
            for p in np.flatnonzero(np.diff(at)).tolist():
                own = slice(at[p], at[p + 1])
                out.append((p, block, k + 1, unique[own].tobytes(), count[own].astype(np.uint32).tobytes() if counted else b""))
        return _rows(out, [("part", pa.int32()), ("block", pa.int32()), ("k", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    return run


def _table(ask: pa.Table) -> pa.Table:
    """The counts of one part's n-grams over all blocks, for each block that asked."""
    orders = np.array(ask.column("k").to_pylist())
    out = []
    for k in sorted(set(orders.tolist())):
        own = np.flatnonzero(orders == k)
        keys = [np.frombuffer(ask.column("keys")[i].as_py(), np.uint64) for i in own]
        counts = [np.frombuffer(c, np.uint32) if (c := ask.column("counts")[i].as_py()) else np.zeros(len(x), np.uint32) for i, x in zip(own, keys, strict=True)]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts))[at].astype(np.uint64)
        wide = bool(total.max() >= 1 << 32)
        told = total if wide else total.astype(np.uint32)
        ends = np.cumsum([len(x) for x in keys])
        for i, end, x in zip(own, ends, keys, strict=True):
            out.append((ask.column("block")[i].as_py(), ask.column("part")[i].as_py(), k, told[end - len(x) : end].tobytes(), wide))
    return _rows(out, [("block", pa.int32()), ("part", pa.int32()), ("k", pa.int32()), ("counts", pa.binary()), ("wide", pa.bool_())])


def _scorer(order: int, min_count: int, alpha: float, tokens: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        grams, rows = _grams(table.column("text"), order)
        n = table.num_rows
        by: dict[int, list[tuple[int, np.ndarray]]] = {k: [] for k in range(1, order + 1)}
        for part, k, data, wide in zip(*(answers.column(c).to_pylist() for c in ("part", "k", "counts", "wide")), strict=True):
            by[k].append((part, np.frombuffer(data, np.uint64 if wide else np.uint32)))
        counts = []
        for k, keys in enumerate(grams):
            unique, at = np.unique(keys, return_inverse=True)
            none = int(len(unique) > 0 and unique[0] == 0)
            told = [c for _, c in sorted(by[k + 1], key=lambda x: x[0])]
            told = np.concatenate([np.zeros(none), *told]) if told else np.zeros(len(unique))
            counts.append(told[at].astype(np.float64))
        # from the longest n-gram down: the first that is frequent enough decides
        first = np.searchsorted(rows, np.arange(n))
        place = np.arange(len(rows)) - first[rows] if len(rows) else rows
        score = np.zeros(len(rows))
        open_ = np.ones(len(rows), bool)
        for k in range(order, 0, -1):
            longest = np.minimum(place + 1, order)
            can = open_ & (longest >= k)
            if k > 1:
                context = np.append(0.0, counts[k - 2][:-1])
                hit = can & (counts[k - 1] >= max(min_count, 1))
                value = counts[k - 1][hit] / np.maximum(context[hit], 1)
            else:
                hit = can
                value = np.maximum(counts[0][hit], 1) / max(tokens, 1)
            score[hit] = np.log(value) + (longest[hit] - k) * np.log(alpha)
            open_ &= ~hit
        total = np.bincount(rows, weights=score, minlength=n)
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(np.bincount(rows, minlength=n), pa.int64()), pa.array(total, pa.float64())], ["doc_id", "n_words", "log_score"])

    return run


def score(docs: DataFrame, corpus: DataFrame | None = None, order: int = 2, min_count: int = 2, alpha: float = ALPHA, block_bytes: int = 7 << 20) -> DataFrame:
    """(doc_id, n_words, log_score) of every row's whole text: the sum of its words' log stupid-backoff scores.

    Counts are of all words (between ASCII white space) of ``corpus``, by default of ``docs`` themselves. A word's score is
    the count of the longest n-gram that ends with it (up to ``order`` words, within its document) and has at least
    ``min_count`` occurrences, divided by the count of that n-gram without its last word, times ``alpha`` for each word
    by which a longer one was possible; for a single word it is its count (1 at least) over the number of all words.
    Null and empty texts have no words and a sum of 0. Repeated rows count and score each. Further columns are left out.
    """
    n_blocks = block_count(docs, block_bytes)
    parts = max(8, n_blocks // 2)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(df: DataFrame, n: int) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        return df.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("int").alias("block")).repartition("block")

    own = blocks(docs, n_blocks)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    tokens = (docs if corpus is None else corpus).agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    ask = "part int, block int, k int, keys binary, counts binary"
    asked = own.groupBy("block").applyInArrow(_asker(order, parts, corpus is None), ask)
    if corpus is not None:
        told = blocks(corpus.select("doc_id", "text"), block_count(corpus, block_bytes)).groupBy("block").applyInArrow(_asker(order, parts, True), ask)
        asked = asked.unionByName(told.withColumn("block", -1 - F.col("block")))
    answers = asked.groupBy("part").applyInArrow(_table, "block int, part int, k int, counts binary, wide boolean")
    if corpus is not None:
        answers = answers.where("block >= 0")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(order, min_count, alpha, tokens), f"doc_id {kind}, n_words long, log_score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """score() with its mean per word (null without words); both rounded, as sums of doubles depend on their order."""
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(F.try_divide("log_score", "n_words"), 6).alias("mean_log_score"))


#: perplexity(score(documents)) in DuckDB's SQL
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
p AS (SELECT doc_id, i, ws[i] AS b, CASE WHEN i > 1 THEN ws[i - 1] END AS a FROM t),
c1 AS (SELECT b, count(*) AS n FROM p GROUP BY b),
c2 AS (SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY a, b),
total AS (SELECT count(*) AS n FROM p),
s AS (
  SELECT p.doc_id, CASE WHEN p.a IS NULL THEN ln(c1.n / total.n) WHEN c2.n >= 2 THEN ln(c2.n / ca.n) ELSE ln(c1.n / total.n) + ln(0.4) END AS v
  FROM p CROSS JOIN total JOIN c1 ON p.b = c1.b LEFT JOIN c2 ON p.a = c2.a AND p.b = c2.b LEFT JOIN c1 ca ON p.a = ca.b),
d AS (SELECT doc_id, count(*) AS n_words, sum(v) AS log_score FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, round(coalesce(log_score, 0), 4) AS log_score, round(log_score / n_words, 6) AS mean_log_score
FROM w LEFT JOIN d USING (doc_id)
"""
