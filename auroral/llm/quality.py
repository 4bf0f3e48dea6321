"""Quality classifier: logistic regression over hashed word n-grams.

Weights are learned with follow-the-regularised-leader (proximal, per-coordinate)
updates in one streaming task over a bounded sample of labelled documents; a
score is a sparse dot product of a document's n-gram shares with the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import labelled_sample
from .tokens import SIGNS, chunks, mix


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled sample. A document's values are n-gram shares times ``scale``."""

    bits: int = 18
    orders: tuple[int, ...] = (1, 2)
    max_rows: int = 6000
    epochs: int = 3
    scale: float = 16.0
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05


_TWICE = np.uint64(0xD6E8FEB86659FD93)


def features(column: pa.Array, settings: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, slot of each n-gram, its row) for each chunk. Words and runs of signs are tokens, case matters."""
    shift = np.uint64(64 - settings.bits)
    for chunk in chunks(column):
        _, _, hashes, rows = chunk.tokens(SIGNS)
        slots, owners = [], []
        for order in settings.orders:
            n = len(hashes) - order + 1
            if n <= 0:
                continue
            key = np.full(n, order, np.uint64)
            for k in range(order):
                key = mix(key + hashes[k : k + n])
            if order > 1:  # a token said twice in a row is a feature of its own, whatever the token
                key[hashes[:n] == hashes[1 : n + 1]] = _TWICE
            same = rows[:n] == rows[order - 1 :]
            slots.append((key[same] >> shift).astype(np.int64))
            owners.append(rows[:n][same])
        yield chunk.lo, chunk.hi - chunk.lo, np.concatenate(slots) if slots else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


def _order(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()[::-1])


def _trainer(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, n, slots, rows in features(batch.column(1), settings):
                order = np.argsort(rows, kind="stable")
                parts = np.split(slots[order], np.cumsum(np.bincount(rows, minlength=n))[:-1])
                for k, part in enumerate(parts):
                    where, count = np.unique(part, return_counts=True)
                    examples.append((_order(ids[lo + k]), where.astype(np.int32), (count * (settings.scale / max(len(part), 1))).astype(np.float32), float(labels[lo + k] > 0)))
        examples.sort(key=lambda e: (e[0], len(e[1])))  # any order of rows gives the same model
        size = (1 << settings.bits) + 1  # the last is the bias
        z, n = np.zeros(size), np.zeros(size)

        def weights(i):
            zi = z[i]
            return np.where(np.abs(zi) <= settings.l1, 0.0, (np.sign(zi) * settings.l1 - zi) / ((settings.beta + np.sqrt(n[i])) / settings.alpha + settings.l2))

        for _ in range(settings.epochs):
            for _, where, value, label in examples:
                i = np.append(where, size - 1)
                x = np.append(value, np.float32(1))
                w = weights(i)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
                s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / settings.alpha
                z[i] += g - s * w
                n[i] += g * g
        out = weights(np.arange(size)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str, use: Column, settings: Settings = Settings()) -> np.ndarray:
    """Weights (the last is the bias) from at most ``settings.max_rows`` labelled documents where ``use`` holds on ``labels``.

    Without any such document all weights are 0. Labels over 0 count as 1.
    """
    sample = labelled_sample(docs, labels, label, use, settings.max_rows)
    rows = sample.mapInArrow(_trainer(settings), "weights binary").collect()  # one row of a fixed size
    return np.frombuffer(max((bytes(r[0]) for r in rows), default=b""), np.float32) if rows else np.zeros((1 << settings.bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings(), extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *extra, score) of every row's whole text: the probability of label 1.

    Null texts are empty; texts without tokens get the bias alone. Repeated rows each get their score.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = model.value[:-1], float(model.value[-1])
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for lo, n, slots, rows in features(batch.column(batch.num_columns - 1), settings):
                total = np.bincount(rows, weights=w[slots], minlength=n)
                out[lo : lo + n] += settings.scale * total / np.maximum(np.bincount(rows, minlength=n), 1)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))), pa.float64())], [*names, "score"])

    names = ["doc_id", *extra]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col("text").alias("__text")).mapInArrow(run, f"{schema}, score double")
