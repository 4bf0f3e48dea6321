"""Alignment of two tokenizers over documents, and how the corpus agrees on it.

Both tokenizers encode a space and the text. Byte offsets where tokens of both end cut a document into
groups; the two tokens that end there are a link. How often two ids are linked is counted over the corpus
by a cogroup of posting lists:

1. Blocks of documents are encoded and written down: a row for each document, and for each block and id of
   side B a posting list (ids of side A, documents, multiplicities).
2. Pairs of ids are counted (there are as many as two vocabularies allow, whatever the corpus).
3. Counts and posting lists of an id come together, sorted so that the counts are first: Spark's sort spills, and a
   task passes along the sorted stream. It holds the counts of one id, finds their maximum, and turns each posting list into
   contributions to its documents. An id with many postings is dealt out over parts by block, each of which gets its counts.
4. Contributions are summed block by block and meet their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepairs import BytePairCodec, Vocabulary, codec_of, flat_table, gather, long_and_short, vocabulary
from .common import give_back, materialise
from .pieces import PieceCodec

#: A block of documents ends with the document that reaches one of these.
BLOCK_CHARS = 6 << 20
BLOCK_DOCS = 1 << 14
#: Postings of an id in one part, about.
PART_POSTINGS = 1 << 20
#: Contributions that a task holds before it adds them up and hands them on.
HELD = 1 << 21


class Aligner:
    """Encodes texts with both tokenizers and finds where tokens end together."""

    def __init__(self, a: BytePairCodec, b: PieceCodec):
        self.a, self.b = a, b
        self.n_a, self.n_b = len(a.raw[2]), b.n
        # ids of both sides in decimal, each with a place for the sign that follows
        self.decimal = flat_table([b"%d," % i for i in range(self.n_a)] + [b"%d," % i for i in range(self.n_b)])

    def pieces(self, text: str, size: int) -> Iterator[str]:
        """The text in pieces of about ``size`` characters, cut at spaces after something else than white space.

        That space is left out, as both encoders put one before what they are given; both end a token there whatever follows. No piece is empty.
        """
        lo = 0
        while self.b.by_words and len(text) - lo > size:
            cut = text.find(" ", lo + size)
            while 0 < cut < len(text) - 1 and self.a.kind[ord(text[cut - 1])] == 0:
                cut = text.find(" ", cut + 1)
            if not 0 < cut < len(text) - 1:
                break
            yield text[lo:cut]
            lo = cut + 1
        yield text[lo:]

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of side A and B, flat, their numbers for each part, and which parts both sides spell byte for byte. Other parts have no ids."""
        ids_a, of_a = self.a.encode_flat([" " + p for p in parts])
        ids_b, of_b = self.b._encode(parts)
        said = "".join(" " + p for p in parts).encode()
        sizes = np.array([1 + len(p.encode()) for p in parts], np.int64)
        right = np.ones(len(parts), bool)
        for ids, counts, raw in ((ids_a, of_a, self.a.raw), (ids_b, of_b, self.b.raw)):
            spelled, ends = gather(*raw, ids)
            cut = np.append(0, ends)[np.append(0, np.cumsum(counts))]
            if len(spelled) == len(said) and (np.diff(cut) == sizes).all() and spelled.tobytes() == said:
                continue
            place, spelled = np.append(0, np.cumsum(sizes)), spelled.tobytes()
            right &= [spelled[cut[k] : cut[k + 1]] == said[place[k] : place[k + 1]] for k in range(len(parts))]
        if not right.all():
            ids_a, ids_b = ids_a[np.repeat(right, of_a)], ids_b[np.repeat(right, of_b)]
            of_a, of_b = np.where(right, of_a, 0), np.where(right, of_b, 0)
        return ids_a, of_a, ids_b, of_b, right

    def meet(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of side A and B that end together, in order."""
        ends_a, ends_b = np.cumsum(self.a.raw[2][ids_a]), np.cumsum(self.b.raw[2][ids_b])
        if not len(ends_a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
        hit = ends_b[at] == ends_a
        return np.flatnonzero(hit), at[hit]

    def written(self, ids_a: np.ndarray, at_a: np.ndarray, ids_b: np.ndarray, at_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The groups as ``a1,a2|b1;a3|b2;`` and where each group ends in it."""
        size_a, size_b = np.diff(np.append(-1, at_a)), np.diff(np.append(-1, at_b))
        size = size_a + size_b
        begin = np.cumsum(size) - size
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        sign = np.full(len(ids), ord(","), np.uint8)
        ids[np.repeat(begin - (np.cumsum(size_a) - size_a), size_a) + np.arange(len(ids_a))] = ids_a
        ids[np.repeat(begin + size_a - (np.cumsum(size_b) - size_b), size_b) + np.arange(len(ids_b))] = ids_b + self.n_a
        sign[begin + size_a - 1], sign[begin + size - 1] = ord("|"), ord(";")
        said, ends = gather(*self.decimal, ids)
        said[ends - 1] = sign
        return said.tobytes(), ends[begin + size - 1]


class Block:
    """What is known of a block's documents while their pieces pass."""

    def __init__(self, texts: list[str], aligner: Aligner):
        n = len(texts)
        self.aligner = aligner
        self.n_a, self.n_b, self.n_links = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.good = np.array([bool(t) for t in texts], bool)
        self.begun = np.zeros(n, bool)
        self.hashes = [hashlib.sha256() for _ in texts]
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        for rows, parts in long_and_short(texts, aligner.pieces):
            self._add(np.array(rows), parts)
        for k in np.flatnonzero(~self.good).tolist():
            self.n_a[k] = self.n_b[k] = self.n_links[k] = 0

    def _add(self, rows: np.ndarray, parts: list[str]) -> None:
        some = np.array([bool(p) for p in parts], bool)
        rows, parts = rows[some], [p for p in parts if p]
        if not parts:
            return
        ids_a, of_a, ids_b, of_b, right = self.aligner.encode(parts)
        self.good[rows[~right]] = False
        at_a, at_b = self.aligner.meet(ids_a, ids_b)
        part = np.repeat(np.arange(len(parts)), of_a)[at_a]
        links = np.bincount(part, minlength=len(parts))
        for total, counts in ((self.n_a, of_a), (self.n_b, of_b), (self.n_links, links)):
            np.add.at(total, rows, counts)
        if len(at_a):
            said, ends = self.aligner.written(ids_a, at_a, ids_b, at_b)
            cut = np.append(0, ends)[np.append(0, np.cumsum(links))]
            for k in np.flatnonzero(links).tolist():
                if self.begun[rows[k]]:
                    self.hashes[rows[k]].update(b";")
                self.hashes[rows[k]].update(said[cut[k] : cut[k + 1] - 1])
                self.begun[rows[k]] = True
            keys, times = np.unique((ids_b[at_b] * self.aligner.n_a + ids_a[at_a]) * BLOCK_DOCS + rows[part], return_counts=True)
            self.keys.append(keys)
            self.times.append(times)

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(b, a, document, multiplicity), in this order, of the documents that both sides spell."""
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        times = np.concatenate(self.times) if self.keys else np.zeros(0, np.int64)
        if len(self.keys) > 1:
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, times = keys[first], np.add.reduceat(times, first)
        pair, doc = keys // BLOCK_DOCS, keys % BLOCK_DOCS
        keep = self.good[doc]
        pair, doc, times = pair[keep], doc[keep], times[keep]
        return pair // self.aligner.n_a, pair % self.aligner.n_a, doc, times


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of about ``chars`` characters and ``BLOCK_DOCS`` documents at most."""
    ids, texts, held = [], [], 0
    for batch in batches:
        said = batch.column(1).to_pylist()
        lo = 0
        for k, text in enumerate(said):
            texts.append(text or "")
            held += len(texts[-1])
            if held >= chars or len(texts) == BLOCK_DOCS:
                yield pa.chunked_array([*ids, batch.column(0).slice(lo, k + 1 - lo)]).combine_chunks(), texts
                ids, texts, held, lo = [], [], 0, k + 1
        if lo < len(said):
            ids.append(batch.column(0).slice(lo))
    if texts:
        yield pa.chunked_array(ids).combine_chunks(), texts


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, kind))


def _postings(block: Block, number: int, names: list[str], id_type: pa.DataType, per_batch: int = 2000) -> Iterator[pa.RecordBatch]:
    """A row for each id of side B: its ids of side A, their links and how many documents each has; those documents and the multiplicities."""
    b, a, doc, times = block.postings()
    if not len(b):
        return
    pair = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1])))
    docs_of = np.diff(np.append(pair, len(b)))
    links_of = np.add.reduceat(times, pair)
    side = b[pair]
    first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
    for lo in range(0, len(first), per_batch):
        some = first[lo : lo + per_batch]
        hi = first[lo + per_batch] if lo + per_batch < len(first) else len(pair)
        pairs = slice(some[0], hi)
        rows = slice(pair[some[0]], pair[hi] if hi < len(pair) else len(b))
        ends = np.append(some[1:], hi) - some[0]
        doc_ends = np.cumsum(docs_of[pairs])[ends - 1]
        n = len(some)
        columns = {
            "block": pa.array(np.full(n, number), pa.int64()),
            "doc_id": pa.nulls(n, id_type),
            "b": pa.array(side[some], pa.int32()),
            "a": _lists(a[pair[pairs]], ends, pa.int32()),
            "links": _lists(links_of[pairs], ends, pa.int64()),
            "n_docs": _lists(docs_of[pairs], ends, pa.int32()),
            "docs": _lists(doc[rows], doc_ends, pa.int16()),
            "times": _lists(times[rows], doc_ends, pa.int64()),
        }
        kinds = {"doc": pa.int16(), "n_a": pa.int64(), "n_b": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}
        yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[c]) for c in names], names)


def encoded_blocks(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of documents (block, doc, doc_id, n_a, n_b, n_links, groups_sha256; ``b`` null) and posting lists (block, b, a, links, n_docs, docs, times; ``doc`` null).

    A block's number comes from its task and its place there: write the rows down before they are used twice.
    """
    words: Vocabulary = vocabulary(path_a)
    with open(path_b, "rb") as file:
        model = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc short, doc_id {kind}, n_a long, n_b long, n_links long, groups_sha256 string, b int, a array<int>, links array<long>, n_docs array<int>, docs array<short>, times array<long>"
    names = "block doc doc_id n_a n_b n_links groups_sha256 b a links n_docs docs times".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(codec_of(words, False), PieceCodec(model))
        number = TaskContext.get().partitionId() << 32
        lists = {"a": pa.int32(), "links": pa.int64(), "n_docs": pa.int32(), "docs": pa.int16(), "times": pa.int64()}
        for ids, texts in _blocks(batches, block_chars):
            block = Block(texts, aligner)
            n = len(texts)
            said = [h.hexdigest() if ok else "" for h, ok in zip(block.hashes, block.good.tolist(), strict=True)]
            known = [pa.array(np.full(n, number), pa.int64()), pa.array(np.arange(n), pa.int16()), ids, *(pa.array(x, pa.int64()) for x in (block.n_a, block.n_b, block.n_links)), pa.array(said, pa.string())]
            rest = [pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.list_(lists[c])) for c in names[8:])]
            yield pa.RecordBatch.from_arrays([*known, *rest], names)
            yield from _postings(block, number, names, ids.type)
            number += 1
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(b, a, links): how many links of the corpus hold each pair of ids; blocks add up first."""
    pairs = blocks.where("b is not null").select("b", F.explode(F.arrays_zip("a", "links")).alias("x"))
    return pairs.groupBy("b", F.col("x.a").alias("a")).agg(F.sum("x.links").alias("links"))


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists to (block, docs, best, sums). Rows are sorted by b and part, counts first: counts have no block."""
    names = ["block", "docs", "best", "sums"]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def added() -> pa.RecordBatch:
        key, best, total = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        best, total = np.add.reduceat(best[order], first), np.add.reduceat(total[order], first)
        block, doc = key[first] // BLOCK_DOCS, key[first] % BLOCK_DOCS
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        ends = np.append(cut[1:], len(block))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([numbers[k] for k in block[cut].tolist()], pa.int64()), _lists(doc, ends, pa.int16()), _lists(best, ends, pa.int64()), _lists(total, ends, pa.int64())], names)

    known = counts = np.zeros(0, np.int64)
    most = 0
    numbers: list[int] = []  # the blocks held, by place: keys stay small whatever a block's number is
    place: dict[int, int] = {}
    for batch in batches:
        block, a, links, n_docs, docs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("block", "a", "links", "n_docs", "docs", "times"))
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (a, links, n_docs, docs, times)]
        ends = [np.append(0, np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64) for c in (a, links, n_docs, docs, times)]
        for k, number in enumerate(block.to_pylist()):
            ids = flat[0][ends[0][k] : ends[0][k + 1]]
            if number is None:
                known, counts = ids, flat[1][ends[1][k] : ends[1][k + 1]]
                most = counts.max()
                continue
            count = counts[np.searchsorted(known, ids)]
            each, links_of = np.repeat(count, flat[2][ends[2][k] : ends[2][k + 1]]), flat[4][ends[4][k] : ends[4][k + 1]]
            if number not in place:
                place[number] = len(numbers)
                numbers.append(number)
            held.append((flat[3][ends[3][k] : ends[3][k + 1]].astype(np.int64) + place[number] * BLOCK_DOCS, np.where(each == most, links_of, 0), each * links_of))
            size += len(each)
            if size >= HELD:
                yield added()
                size, numbers, place = 0, [], {}
    if held:
        yield added()
    give_back()


def contributions(blocks: DataFrame, part_postings: int = PART_POSTINGS) -> DataFrame:
    """(block, docs, best, sums): what the ids of side B add to n_best and count_sum of the block's documents."""
    lists = blocks.where("b is not null")
    counts = pair_counts(blocks).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("a", "links"))).alias("x"))  # at most side A's vocabulary
    parts = lists.groupBy("b").agg(F.ceil(F.sum(F.size("docs")) / part_postings).cast("int").alias("parts"))  # at most side B's vocabulary
    none = F.lit(None)
    first = counts.join(F.broadcast(parts), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none.cast("long").alias("block"), F.col("x.a").alias("a"), F.col("x.links").alias("links"), none.cast("array<int>").alias("n_docs"), none.cast("array<short>").alias("docs"), none.cast("array<long>").alias("times"))
    then = lists.join(F.broadcast(parts), "b").select("b", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int").alias("part"), "block", "a", none.cast("array<long>").alias("links"), "n_docs", "docs", "times")
    met = first.unionByName(then).repartition("b", "part").sortWithinPartitions("b", "part", F.col("block").asc_nulls_first())
    return met.mapInArrow(_contribute, "block long, docs array<short>, best array<long>, sums array<long>")


def _document_sums(docs: pa.Table, added: pa.Table) -> pa.Table:
    place = np.zeros(BLOCK_DOCS, np.int64)
    place[docs.column("doc").to_numpy()] = np.arange(len(docs))
    out = []
    at = added.column("docs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    for name in ("best", "sums"):
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, place[at], added.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False))
        out.append(pa.array(total, pa.int64()))
    links = docs.column("n_links")
    return pa.table([docs.column("doc_id"), docs.column("n_a"), docs.column("n_b"), links, links, *out, docs.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS, part_postings: int = PART_POSTINGS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row's whole text.

    Side A is a byte-level BPE file and sees a space before the text, side B a SentencePiece BPE model, which adds it; strings of special tokens are plain text.
    As all tokens have bytes, a group has one link. n_best counts links whose pair is linked as often as any of its B id, count_sum adds up how often
    pairs are linked. Null and empty texts, and texts that a side doesn't spell byte for byte (with U+2581, say), have zeros and an empty digest and count
    nowhere. Rows of repeated or null ids are rows of their own; further columns are left out. What this writes to the shared folder stays there while the result reads it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = materialise(encoded_blocks(docs, path_a, path_b, block_chars), "alignment-blocks")
    rows = blocks.where("doc is not null").select("block", "doc", "doc_id", "n_a", "n_b", "n_links", "groups_sha256")
    added = contributions(blocks, part_postings)
    return rows.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(_document_sums, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups array<struct<a array<int>, b array<int>>>): the ids of each group of every row's text; none where align() has zeros."""
    words = vocabulary(path_a)
    with open(path_b, "rb") as file:
        model = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(codec_of(words, False), PieceCodec(model))
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py() or ""
                found = []
                for part in aligner.pieces(text, 1 << 20) if text else ():
                    ids_a, _, ids_b, _, right = aligner.encode([part])
                    if not right[0]:
                        found = []
                        break
                    at_a, at_b = aligner.meet(ids_a, ids_b)
                    found += [{"a": x.tolist(), "b": y.tolist()} for x, y in zip(np.split(ids_a, at_a + 1)[:-1], np.split(ids_b, at_b + 1)[:-1], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([found], pa.list_(pa.struct({"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32())})))], ["doc_id", "groups"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, groups array<struct<a: array<int>, b: array<int>>>")
