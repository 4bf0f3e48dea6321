"""SentencePiece BPE encoding and decoding with flat numpy arrays.

Texts become one array of symbols cut into words (no piece of the model reaches
across a word's end). In each round every unfinished word finds the least rank
among its adjacent pairs (a segmented minimum), the leftmost such pairs of all
words merge at once, and the arrays are compacted; the rounds end when no pair
is left. Where no longer piece that begins or ends with the merged one ranks
before it, all its disjoint occurrences in a word merge in the same round, as the
sequential algorithm would do one after the other.

Only distinct words are merged; what was merged lately is kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import mix, span_hashes, chunks

SPACE = 0x2581
CACHE_WORDS = 1 << 18
CHUNK = 1 << 20
_NONE = np.int64(1) << 40


def _gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated table slices of the ids, and where each ends."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = np.repeat(starts[ids] - (ends - size), size)
    at += np.arange(len(at))
    return table[at], ends


def _flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths


class PieceCodec:
    """Encoder and decoder for a serialised SentencePiece BPE model with byte fallback and no text normalisation.

    Raises ValueError for a model that it can't follow exactly (checked on probe texts against the library).
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        ordinary = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.unk, self.eos, self.bos = sp.unk_id(), sp.eos_id(), sp.bos_id()
        self.byte_ids = np.full(256, self.unk, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        symbols = {p: i for i, p in enumerate(self.pieces) if ordinary[i]}
        vocabulary = dict(symbols)
        for p in vocabulary:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.base = n + len(symbols) + len(self.pieces)
        scores = {p: sp.get_score(i) for p, i in vocabulary.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.by_char = np.full(0x110000, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.by_char[ord(p)] = i
        splits = {}
        safe = {p: True for p in vocabulary}
        for p, i in vocabulary.items():
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                if left in symbols and right in symbols:
                    splits[symbols[left] * self.base + symbols[right]] = i
                for part in (left, right):
                    if part in safe and scores[part] <= scores[p]:
                        safe[part] = False
        self.pair_keys = np.array(sorted(splits), np.int64)
        self.pair_ids = np.array([splits[k] for k in self.pair_keys.tolist()], np.int64)
        self.rank = np.full(n, _NONE, np.int64)
        self.safe = np.zeros(n, bool)
        for p, i in vocabulary.items():
            self.rank[i] = order[scores[p]]
            self.safe[i] = safe[p]
        #: No piece has the space mark after another character: words can be merged one by one.
        self.by_words = not any("▁" in p.lstrip("▁") for p in vocabulary)
        self.n = n
        self.decimal = _flat([b"%d " % i for i in range(n)])
        raw = []
        self.is_byte = np.zeros(n, bool)
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                raw.append(bytes([int(p[1:-1], 16)]))
                self.is_byte[i] = True
            elif sp.is_unknown(i):
                raw.append(" ⁇ ".encode())
            elif sp.is_control(i):
                raw.append(b"")
            else:
                raw.append(p.replace("▁", " ").encode())
        self.raw = _flat(raw)
        self._reset()
        probes = ["", " ", "a  b", "ﬁ Å Å é", "x\n\ty ▁z", "\U0001f600\x00", "Hello, world hello world."]
        for text in probes:
            if self.encode([text])[0].tolist() != sp.encode(text) or self.decode(self.encode([text]))[0] != sp.decode(sp.encode(text)):
                raise ValueError("this model normalises or segments text in a way that is not supported")

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at, self.known_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pieces, -1 where there is none."""
        out = np.full(len(left), -1, np.int64)
        ok = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[ok] * self.base + right[ok]
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        hit = self.pair_keys[at] == keys if len(self.pair_keys) else np.zeros(len(at), bool)
        out[ok[hit]] = self.pair_ids[at[hit]]
        return out

    def _merge(self, symbols: np.ndarray, words: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge rounds. Returns the symbols left, their words and where in the input each began, ordered by word and place."""
        origin = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pair = self._pairs(symbols[:-1], symbols[1:]) if len(symbols) else symbols
        if len(symbols):
            pair = np.append(pair, -1)
            pair[:-1][words[1:] != words[:-1]] = -1
        while len(symbols):
            rank = np.where(pair >= 0, self.rank[pair], _NONE)
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(words)))
            alive = best < _NONE
            if not alive.all():
                keep = np.repeat(alive, sizes)
                done.append((symbols[~keep], words[~keep], origin[~keep]))
                symbols, words, origin, pair, rank = symbols[keep], words[keep], origin[keep], pair[keep], rank[keep]
                best, sizes = best[alive], sizes[alive]
                if not len(symbols):
                    break
                first = np.cumsum(sizes) - sizes
            chosen = np.flatnonzero(rank == np.repeat(best, sizes))
            word = words[chosen]
            lead = np.append(True, word[1:] != word[:-1])
            # the leftmost pair of its word's least rank; with it, equal safe pairs that don't overlap
            target = pair[chosen[lead]]
            group = np.cumsum(lead) - 1
            ok = lead | (self.safe[target][group] & (pair[chosen] == target[group]))
            chosen, lead = chosen[ok], lead[ok]
            adjacent = np.append(False, (chosen[1:] == chosen[:-1] + 1) & ~lead[1:])
            if adjacent.any():  # runs such as aaaa: every other pair of a run
                starts = np.flatnonzero(~adjacent)
                odd = (np.arange(len(chosen)) - np.repeat(starts, np.diff(np.append(starts, len(chosen))))) % 2 == 1
                chosen = chosen[~odd]
            symbols[chosen] = pair[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[chosen] = True
            symbols, words, origin, pair, changed = symbols[keep], words[keep], origin[keep], pair[keep], changed[keep]
            redo = changed.copy()
            redo[:-1] |= changed[1:]
            at = np.flatnonzero(redo)
            right = np.minimum(at + 1, len(symbols) - 1)
            fresh = self._pairs(symbols[at], symbols[right])
            fresh[(right == at) | (words[right] != words[at])] = -1
            pair[at] = fresh
        symbols, words, origin = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(origin, kind="stable")
        return symbols[order], words[order], origin[order]

    def _words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words points[start:end], flat, and how many each has."""
        size = ends - starts
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        chars = points[at]
        symbols, words, origin = self._merge(self.by_char[chars].astype(np.int64), np.repeat(np.arange(len(starts)), size), len(starts))
        whole = (symbols >= 0) & (symbols < self.n)
        if whole.all():
            return symbols, np.bincount(words, minlength=len(starts))
        out, owner = [], []
        for i in np.flatnonzero(~whole).tolist():  # characters without a piece: their bytes
            data = np.frombuffer(chr(chars[origin[i]]).encode("utf-8", "surrogatepass"), np.uint8)
            out.append(self.byte_ids[data])
        sizes = np.ones(len(symbols), np.int64)
        sizes[~whole] = [len(x) for x in out]
        result = np.repeat(np.where(whole, symbols, 0), sizes)
        begin = np.cumsum(sizes) - sizes
        for i, x in zip(np.flatnonzero(~whole).tolist(), out, strict=True):
            result[begin[i] : begin[i] + len(x)] = x
        return result, np.bincount(words, weights=sizes, minlength=len(starts)).astype(np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the number of ids of each."""
        full = [("▁" + t.replace(" ", "▁")) if t else "" for t in texts]
        lengths = np.array([len(t) for t in full], np.int64)
        points = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), lengths
        begin = np.zeros(len(points), bool)
        offsets = np.cumsum(lengths) - lengths
        begin[offsets[lengths > 0]] = True
        if self.by_words:
            mark = points == SPACE
            begin[1:] |= mark[1:] & ~mark[:-1]
            alone = self.by_char[points] < 0
            begin |= alone
            begin[1:] |= alone[:-1]
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(points))
        hashes = span_hashes(mix(points.astype(np.uint64) + np.uint64(1)), starts, ends)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        at[at == len(self.known)] = 0
        new = self.known[at] != unique if len(self.known) else np.ones(len(unique), bool)
        if new.any():
            if len(self.known) + new.sum() > CACHE_WORDS:
                self._reset()
                new[:] = True
            ids, counts = self._words(points, starts[where[new]], ends[where[new]])
            known = np.concatenate([self.known, unique[new]])
            order = np.argsort(known, kind="stable")
            self.known_at = np.concatenate([self.known_at, np.cumsum(counts) - counts + len(self.known_ids)])[order]
            self.known_n = np.concatenate([self.known_n, counts])[order]
            self.known_ids = np.concatenate([self.known_ids, ids])
            self.known = known[order]
            at = np.searchsorted(self.known, unique)
        ids, _ = _gather(self.known_ids, self.known_at, self.known_n, at[inverse])
        per_word = self.known_n[at[inverse]]
        owner = np.searchsorted(offsets[lengths > 0], starts, side="right") - 1
        counts = np.zeros(len(texts), np.int64)
        counts[lengths > 0] = np.bincount(owner, weights=per_word, minlength=int((lengths > 0).sum())).astype(np.int64)
        return ids, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self._encode(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []

    def _bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, ends = _gather(*self.raw, ids)
        return data, np.append(0, ends)[np.append(0, np.cumsum(counts))]

    def _text(self, data: bytes, ids: np.ndarray) -> str:
        """One text from its pieces' bytes; the first space is the mark that encoding put there."""
        first = next((i for i in ids.tolist() if self.raw[2][i]), None)
        if first is not None and not self.is_byte[first] and data[:1] == b" " and first != self.unk:
            data = data[1:]
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return "".join(self._invalid(data))

    @staticmethod
    def _invalid(data: bytes) -> Iterator[str]:
        """UTF-8 where each byte that can't be decoded becomes U+FFFD."""
        at = 0
        while at < len(data):
            for k in (1, 2, 3, 4):
                try:
                    yield data[at : at + k].decode("utf-8")
                    at += k
                    break
                except UnicodeDecodeError:
                    pass
            else:
                yield "�"
                at += 1

    def decode(self, batches: list[np.ndarray]) -> list[str]:
        counts = np.array([len(b) for b in batches], np.int64)
        ids = np.concatenate(batches).astype(np.int64) if len(batches) and counts.sum() else np.zeros(0, np.int64)
        data, cut = self._bytes(ids, counts)
        data = data.tobytes()
        ends = np.cumsum(counts)
        return [self._text(data[cut[i] : cut[i + 1]], ids[ends[i] - counts[i] : ends[i]]) for i in range(len(batches))]


def _codec_runner(model: bytes, bos: bool, eos: bool, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            for chunk in chunks(batch.column(1), CHUNK):
                rows = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                flat, counts = codec._encode(texts)
                if bos or eos:
                    ends = np.cumsum(counts)
                    if eos:
                        flat = np.insert(flat, ends, codec.eos)
                    if bos:
                        flat = np.insert(flat, (ends - counts) + (np.arange(len(counts)) if eos else 0), codec.bos)
                    counts = counts + int(bos) + int(eos)
                ends = np.append(0, np.cumsum(counts))
                if digest:
                    said, cut = _gather(*codec.decimal, flat)
                    cut = np.append(0, cut)[ends]
                    said = said.tobytes()
                    ids = [hashlib.sha256(said[cut[i] : max(cut[i], cut[i + 1] - 1)]).hexdigest() for i in range(len(texts))]
                    out = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in codec.decode(np.split(flat, ends[1:-1]))]
                    columns = [rows.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([rows.column(0), ids], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model_path: str, bos: bool = False, eos: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text, as the sentencepiece library encodes it without sampling.

    Null texts are empty texts; an empty text has no id besides bos and eos. Rows, repeated ones and
    those with null ids too, give a row each; further columns of ``docs`` are left out.
    """
    model = open(model_path, "rb").read()  # noqa: SIM115  half a megabyte, shipped with the function
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_codec_runner(model, bos, eos, False), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>), as the library's decode(); null ids give an empty text."""
    model = open(model_path, "rb").read()  # noqa: SIM115
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                texts = codec.decode([np.array(x or [], np.int64) for x in rows.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() with an end id, then decode(), as digests in one pass."""
    model = open(model_path, "rb").read()  # noqa: SIM115
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_codec_runner(model, False, True, True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
