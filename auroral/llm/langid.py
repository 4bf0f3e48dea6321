"""Language identification with bit-sliced Bloom filters.

One array of bit masks holds a Bloom filter for every language: bit L of a slot
belongs to language L's filter, so that the masks at an n-gram's slots, and-ed,
are all languages that contain it. A mask has 64 bits; for every 64 languages there
is one more array. A text's count for a language is the number of
its n-grams with that bit, less the false positives that the filter's fill makes
likely; the largest corrected count decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .tokens import LOWER, CHUNK_BYTES, chunks, classes, mix

#: Languages of one mask.
WORD = 64
#: Letters and non-ASCII bytes stay, everything else is one gap.
_LETTERS = classes((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0x80, 0xFF, 1))


@dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the sampled documents of a language (in expectation); ``bits`` and ``probes`` size the filters.

    By default a filter holds every n-gram of its language's sample. ``share`` leaves out those whose share in the language is
    under that part of their largest share in any, ``min_count`` those that occur less often.
    """

    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 21
    probes: int = 2
    per_language: int = 1500
    share: float = 0.0
    min_count: int = 1


@dataclass
class Model:
    """``masks`` holds 2**bits slots for every 64 languages, one array after the other."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray


def grams(column: pa.Array, settings: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, hash of each byte n-gram, its row) for each chunk; n-grams hold at most one gap, and no row's end."""
    for chunk in chunks(column, CHUNK_BYTES):
        data = np.where(_LETTERS[chunk.data] > 0, LOWER[chunk.data], 0x20).astype(np.uint64)
        n_rows = chunk.hi - chunk.lo
        rows = np.repeat(np.arange(n_rows), np.diff(chunk.offsets))
        keep = np.ones(len(data), bool)
        keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20) | (rows[1:] != rows[:-1])
        data, rows = data[keep], rows[keep]
        keys, owners = [], []
        for size in settings.sizes:
            n = len(data) - size + 1
            if n <= 0:
                continue
            key = np.full(n, size, np.uint64)
            for k in range(size):
                key = (key << np.uint64(8)) | data[k : k + n]
            same = rows[:n] == rows[size - 1 :]
            keys.append(key[same])
            owners.append(rows[:n][same])
        empty = np.zeros(0, np.uint64)
        yield chunk.lo, n_rows, np.concatenate(keys) if keys else empty, np.concatenate(owners) if owners else empty.astype(np.int64)


def _slots(keys: np.ndarray, settings: Settings) -> list[np.ndarray]:
    h = mix(keys)
    mask = np.uint64((1 << settings.bits) - 1)
    return [(h >> np.uint64(k * settings.bits) & mask).astype(np.int64) for k in range(settings.probes)]


def _counter(settings: Settings):
    """Counts of n-grams by language, summed for each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, n, keys, rows in grams(batch.column(1), settings):
                own = langs[lo : lo + n]
                for lang in set(own.tolist()):
                    key, count = np.unique(keys[(own == lang)[rows]], return_counts=True)
                    before = held.setdefault(lang, [])
                    before.append((key, count))
                    if len(before) > 8:
                        held[lang] = [_sum(before)]
        for lang, parts in held.items():
            key, count = _sum(parts)
            for at in range(0, len(key), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key[part]), pa.string()), pa.array(key[part].astype(np.int64)), pa.array(count[part].astype(np.int64))], ["lang", "gram", "n"])

    return run


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


def train(docs: DataFrame, use: Column, settings: Settings = Settings()) -> Model:
    """Filters from a bounded sample of the documents where ``use`` holds and lang and text are not null.

    A language's sample is the rows whose hash falls into a share that gives ``settings.per_language`` of them; a
    language with fewer is used whole. Masks take 8 * 2**bits bytes for every 64 languages; no language gives a model that answers ``und``.
    """
    rows = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = dict(rows.groupBy("lang").count().collect())  # a row for each language
    languages = sorted(counts)
    size = 1 << settings.bits
    if not languages:
        return Model([], np.zeros(size, np.uint64), np.zeros(0))
    told = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]
    chosen = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), told(counts)) < settings.per_language
    kept = rows.where(chosen).select("lang", "text").mapInArrow(_counter(settings), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    if settings.min_count > 1 or settings.share > 0:
        total = {r[0]: float(r[1]) for r in kept.groupBy("lang").agg(F.sum("n")).collect()}
        shares = kept.withColumn("p", F.col("n") / told(dict.fromkeys(languages, 1.0) | total))
        best = shares.groupBy("gram").agg(F.max("p").alias("best"))
        kept = shares.join(best, "gram").where((F.col("p") >= settings.share * F.col("best")) & (F.col("n") >= settings.min_count))
    # each n-gram sets at most `probes` of the slots of each array
    placed = kept.withColumns({"word": told({lang: k // WORD for k, lang in enumerate(languages)}), "bit": told({lang: k % WORD for k, lang in enumerate(languages)})})
    mask = placed.groupBy("gram", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    words = math.ceil(len(languages) / WORD)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.zeros(words * size, np.uint64)
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.uint64)
            base = batch.column(1).to_numpy().astype(np.int64) * size
            own = batch.column(2).to_numpy().astype(np.uint64)
            for at in _slots(keys, settings):
                np.bitwise_or.at(masks, base + at, own)
        where = np.flatnonzero(masks)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(masks[where].astype(np.int64))], ["slot", "mask"])

    slots = mask.mapInArrow(build, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    got = slots.toArrow()  # at most 2**bits rows for every 64 languages
    masks = np.zeros(words * size, np.uint64)
    masks[got.column(0).to_numpy()] = got.column(1).to_numpy().astype(np.uint64)
    fill = np.array([np.count_nonzero(masks[k // WORD * size :][:size] >> np.uint64(k % WORD) & np.uint64(1)) / size for k in range(len(languages))])
    return Model(languages, masks, fill**settings.probes)


def predict(docs: DataFrame, model: Model, settings: Settings = Settings(), extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *extra, lang_pred, score) of every row's whole text.

    ``und`` with score 0 if the text is null or has no letter; else the language of the largest corrected count (the
    first in order among equals), and its share of all languages' corrected counts (1 / languages where all are 0).
    """
    narrow = np.uint8 if len(model.languages) <= 8 else np.uint64
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.languages, model.masks.astype(narrow), model.false_rate))  # 2**bits slots for every 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        count, slots = len(m.languages), m.masks
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            letters = np.zeros(batch.num_rows, bool)
            scores = np.zeros((batch.num_rows, max(count, 1)))
            for chunk in chunks(texts):
                ascii_letters = np.append(0, np.cumsum(classes((0x41, 0x5A, 1), (0x61, 0x7A, 1))[chunk.data]))
                letters[chunk.lo : chunk.hi] = np.diff(ascii_letters[chunk.offsets]) > 0
            for i in np.flatnonzero(~letters).tolist():
                letters[i] = any(c.isalpha() for c in texts[i].as_py() or "")
            for lo, n, keys, rows in grams(texts, settings):
                probes = _slots(keys, settings)
                total = np.bincount(rows, minlength=n)
                for first in range(0, count, WORD):
                    base = first // WORD << settings.bits
                    mask = slots[base + probes[0]]
                    for at in probes[1:]:
                        mask = mask & slots[base + at]
                    for k in range(first, min(first + WORD, count)):
                        hits = np.bincount(rows[(mask >> mask.dtype.type(k - first) & mask.dtype.type(1)).astype(bool)], minlength=n)
                        f = m.false_rate[k]
                        scores[lo : lo + n, k] = np.maximum((hits - total * f) / max(1 - f, 1e-9), 0)
            best = scores.argmax(axis=1)
            whole = scores.sum(axis=1)
            share = np.where(whole > 0, scores[np.arange(len(best)), best] / np.where(whole > 0, whole, 1), 1 / max(count, 1))
            named = [m.languages[b] if ok and count else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(named, pa.string()), pa.array(np.where(letters & (count > 0), share, 0.0), pa.float64())], [*names, "lang_pred", "score"])

    names = ["doc_id", *extra]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col("text").alias("__text")).mapInArrow(run, f"{schema}, lang_pred string, score double")
