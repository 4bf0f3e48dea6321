"""Toxicity: bags of subwords under a linear softmax.

A word is its own hash and those of its character n-grams (with word ends); a
document is the average of all its subwords' embeddings. Embeddings and softmax
are trained jointly in numpy, in one task over a bounded labelled sample, so that
a misspelling shares most of its vectors with the word that it hides.

For scoring, each slot's embedding is multiplied with the softmax weights once:
the average of products is the product of the average.
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
from .tokens import SIGNS, _byte_values, chunks, mix, LOWER, span_hashes


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled sample; ``prior`` subwords of no meaning join every average, so that a short text needs proof too.

    Subwords in fewer than ``min_docs`` sampled documents are not learned; 1 leaves none out.
    """

    bits: int = 18
    dim: int = 8
    min_n: int = 3
    max_n: int = 5
    max_rows: int = 8000
    epochs: int = 6
    rate: float = 0.5
    batch: int = 16
    scale: float = 100.0
    decay: float = 1e-2
    prior: float = 600.0
    min_docs: int = 1


def subwords(column: pa.Array, settings: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, word of each subword of the chunk's distinct words, its slot, distinct word of each token, its row)."""
    shift = np.uint64(64 - settings.bits)
    for chunk in chunks(column):
        starts, ends, hashes, rows = chunk.tokens(SIGNS, lower=True)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        data = LOWER[chunk.data]
        # the words laid out with a mark before and after each
        size = e - s + 2
        at = np.cumsum(size) - size
        laid = np.full(int(size.sum()), 0x20, np.uint8)
        body = np.ones(len(laid), bool)
        body[at] = body[at + size - 1] = False
        laid[body] = data[np.repeat(s - (np.cumsum(e - s) - (e - s)), e - s) + np.arange((e - s).sum())]
        values = _byte_values()[laid]
        # n-grams begin and end at characters, not inside their bytes
        head = np.flatnonzero((laid & 0xC0) != 0x80)
        owner = np.searchsorted(at, head, side="right") - 1
        edges = np.append(head, len(laid))
        words, slots = [np.arange(len(unique))], [(mix(unique) >> shift).astype(np.int64)]
        for n in range(settings.min_n, settings.max_n + 1):
            m = len(head) - n + 1
            if m <= 0:
                break
            ok = owner[:m] == owner[n - 1 :]
            grams = span_hashes(values, head[:m][ok], edges[n : n + m][ok])
            words.append(owner[:m][ok])
            slots.append((mix(grams + np.uint64(n)) >> shift).astype(np.int64))
        yield chunk.lo, chunk.hi - chunk.lo, np.concatenate(words), np.concatenate(slots), inverse, rows


def _trainer(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, n, words, slots, tokens, rows in subwords(batch.column(1), settings):
                order = np.argsort(words, kind="stable")
                by_word = slots[order]
                count = np.bincount(words)
                begin = np.cumsum(count) - count
                for k in range(n):
                    own, times = np.unique(tokens[rows == k], return_counts=True)
                    size = count[own]
                    at = np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    where, group = np.unique(by_word[at], return_inverse=True)
                    value = np.bincount(group, weights=np.repeat(times, size)) if len(where) else np.zeros(0)
                    examples.append((zlib.crc32(str(ids[lo + k]).encode()[::-1]), where.astype(np.int32), (value / (value.sum() + settings.prior)).astype(np.float32), int(labels[lo + k] > 0)))
        examples.sort(key=lambda x: (x[0], len(x[1])))
        spread = np.bincount(np.concatenate([x[1] for x in examples]), minlength=1 << settings.bits) if examples else np.zeros(1 << settings.bits, int)
        known = spread >= settings.min_docs
        examples = [(x[0], x[1][known[x[1]]], x[2][known[x[1]]], x[3]) for x in examples]
        rng = np.random.default_rng(7)
        table = (rng.normal(0, 0.01, (1 << settings.bits, settings.dim)) * known[:, None]).astype(np.float32)
        head = rng.normal(0, 0.5, (settings.dim, 2)).astype(np.float32)
        bias = np.zeros(2, np.float32)
        seen = np.full(1 << settings.bits, 1e-6, np.float32)  # squared gradients, for the rates of slots (AdaGrad)
        if examples:
            rate1 = sum(x[3] for x in examples) / len(examples)
            bias[:] = np.log([max(1 - rate1, 1e-3), max(rate1, 1e-3)])
        steps, step = settings.epochs * len(examples), 0
        for _ in range(settings.epochs):
            for k in rng.permutation(len(examples)):
                _, where, value, label = examples[k]
                rate = settings.rate * (1 - step / steps)
                step += 1
                if not len(where):
                    continue
                rows = table[where]
                mean = settings.scale * (value @ rows)
                logits = mean @ head + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[label] -= 1
                back = settings.scale * (head @ p)
                head -= 0.02 * rate * np.outer(mean, p).clip(-5, 5)
                bias -= 0.02 * rate * p
                pull = value[:, None] * back
                seen[where] += (pull * pull).mean(axis=1)
                table[where] -= 0.1 * rate * (pull / np.sqrt(seen[where])[:, None] + settings.decay * rows)
        # a slot's pull from class 0 to class 1, and the biases' difference
        pulls = (settings.scale * table @ (head[:, 1] - head[:, 0])).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(pulls, bias[1] - bias[0]).astype(np.float32).tobytes()], pa.binary())], ["weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str, use: Column, settings: Settings = Settings()) -> np.ndarray:
    """Each slot's embedding times the softmax weights (class 1 less class 0), then the bias, from at most ``settings.max_rows`` labelled documents.

    Without any such document all are 0. Labels over 0 count as 1.
    """
    sample = labelled_sample(docs, labels, label, use, settings.max_rows)
    rows = sample.mapInArrow(_trainer(settings), "weights binary").collect()  # one row of a fixed size
    return np.frombuffer(max((bytes(r[0]) for r in rows), default=b""), np.float32) if rows else np.zeros((1 << settings.bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of every row's whole text: the softmax probability of label 1.

    Null texts are empty; texts without words get the bias alone. Repeated rows each get their score.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)  # of a fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pulls, bias = model.value[:-1], float(model.value[-1])
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for lo, n, words, slots, tokens, rows in subwords(batch.column(1), settings):
                total, size = np.bincount(words, weights=pulls[slots]), np.bincount(words).astype(float)
                if len(tokens):
                    out[lo : lo + n] += np.bincount(rows, weights=total[tokens], minlength=n) / (np.bincount(rows, weights=size[tokens], minlength=n) + settings.prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, score double")
