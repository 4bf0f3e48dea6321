"""Byte-level BPE encoding and decoding with segment trees over adjacent pairs.

A text is cut into words by character classes (letters, digits, white space, signs) that are
read off the tokenizer's own pre-tokenizer, one for each code point. The bytes of a word are the
leaves of a segment tree whose keys are (rank of the pair that begins here, place); the root is
the leftmost pair of least rank. Merging it changes three leaves at most, each of which is
updated up to the root, until the root holds no pair.

Words of up to ``SMALL`` bytes are merged many at a time, one tree a row of a matrix; longer ones
have a tree of their own. Only distinct words are merged; what was merged lately is kept in a
bounded cache. Long texts pass in pieces that end where a word ends for certain.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back
from .tokens import mix, span_hashes

SMALL = 64
CACHE_WORDS = 1 << 18
#: Code points that are encoded at a time.
CHUNK = 1 << 20
_NONE = np.int64(1) << 60
#: Character classes of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
_BLANK, _LETTER, _DIGIT, _SIGN = range(4)


@dataclass(frozen=True)
class Vocabulary:
    """What workers need of a tokenizer file: bytes of each id, merges in order, special strings, packed character classes."""

    raw: tuple[bytes, ...]
    byte_ids: tuple[int, ...]
    merges: np.ndarray
    special: tuple[tuple[str, int], ...]
    classes: bytes


def _byte_letters() -> dict[str, int]:
    """The visible characters that byte-level vocabularies write for bytes: itself where visible in Latin-1, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def _char_classes(pre_tokenizer) -> np.ndarray:
    """The class of every code point: that of ``a``, ``1`` or ``!`` if the pre-tokenizer doesn't part it from that one. Ranges are halved until they are of one class."""
    kind = np.full(0x110000, _BLANK, np.uint8)
    open_ranges = [(lo, lo + 0x800) for lo in range(0, 0x110000, 0x800) if lo != 0xD800]
    while open_ranges:
        lo, hi = open_ranges.pop()
        said = "".join(map(chr, range(lo, hi)))
        for lead, value in (("!", _SIGN), ("a", _LETTER), ("1", _DIGIT)):
            if len(pre_tokenizer.pre_tokenize_str(lead + said)) == 1:
                kind[lo:hi] = value
                break
        else:
            if hi - lo > 1:
                open_ranges += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
    return kind


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer file. ValueError for what can't be followed exactly: normalisers, other pre-tokenizers, unknown tokens, affixes, dropout."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        text = file.read()
    said = json.loads(text)
    model, pre = said["model"], said["pre_tokenizer"] or {}
    added = said.get("added_tokens", [])
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")]
    if model["type"] != "BPE" or any(odd) or said["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level BPE without normaliser, prefix space, dropout and affixes is supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take white space or whole words only are not supported")
    letters = _byte_letters()
    ids = model["vocab"]
    raw = [b""] * (1 + max([*ids.values(), *(t["id"] for t in added)]))
    for token, i in ids.items():
        raw[i] = bytes(letters[c] for c in token)
    for t in added:
        raw[t["id"]] = bytes(letters[c] for c in t["content"]) if all(c in letters for c in t["content"]) else t["content"].encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    byte_ids = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
    classes = _char_classes(Tokenizer.from_str(text).pre_tokenizer)
    return Vocabulary(tuple(raw), tuple(byte_ids), merges, tuple((t["content"], t["id"]) for t in added), zlib.compress(classes.tobytes()))


def gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated table slices of the ids, and where each ends."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = np.repeat(starts[ids] - (ends - size), size)
    at += np.arange(len(at))
    return table[at], ends


def flat_table(strings: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as one array, where each starts, and its length."""
    strings = list(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths


class BytePairCodec:
    """Encoder and decoder for a ``Vocabulary``. With ``special`` the strings of added tokens in a text are those tokens, else plain text."""

    def __init__(self, words: Vocabulary, special: bool = True):
        self.size = np.int64(len(words.raw))
        self.raw = flat_table(words.raw)
        self.decimal = flat_table(b"%d," % i for i in range(len(words.raw)))
        self.byte_ids = np.array(words.byte_ids, np.int64)
        self.kind = np.frombuffer(zlib.decompress(words.classes), np.uint8)
        keys = words.merges[:, 0] * self.size + words.merges[:, 1]
        order = np.argsort(keys, kind="stable")
        self.pair_keys = np.append(keys[order], -1)  # the last is never equal: no look-up falls off the end
        self.pair_ranks = np.append(order, 0)
        self.merged = words.merges[:, 2].copy()
        self.ranks = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.special = dict(words.special) if special else {}
        strings = sorted(self.special, key=len, reverse=True)
        # a text is cut into pieces only if no special string can be cut
        kinds = [self.kind[[ord(x) for x in t]] for t in strings]
        self.cuttable = not any(((k[:-1] != k[1:]) & (k[:-1] != _SIGN) & (k[1:] != _SIGN)).any() or (k == _BLANK).any() for k in kinds)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at, self.known_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int64)

    # --- words

    def word_starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marks where words begin; ``first`` marks where texts begin."""
        kind = self.kind[points]
        begin = first.copy()
        begin[1:] |= kind[1:] != kind[:-1]
        # of white space before something else the last character stands apart, and a space goes with what follows
        last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~first[1:])
        begin[last] = True
        begin[last[points[last] == 0x20] + 1] = False
        quote = np.flatnonzero((points == 0x27) & begin)
        if len(quote):
            padded, edge = np.append(points, (0, 0, 0)), np.append(first, (True, True, True))
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"]) & ~edge[quote + 1]
            long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))) & ~edge[quote + 1] & ~edge[quote + 2]
            for found, size in ((short, 2), (long, 3)):
                at = quote[found]
                begin[at + 1] = False
                after = at + size
                begin[after[after < len(begin)]] = True
        return begin

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 where there is no merge."""
        keys = left * self.size + right
        at = np.searchsorted(self.pair_keys[:-1], keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def _merge_rows(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of at most C bytes, one a row of ``symbols`` (C columns, a power of two), flat, and how many each has.

        Row r of ``tree`` is a segment tree: node 1 is the root, node k has the children 2k and 2k + 1, leaves begin at C.
        """
        rows, width = symbols.shape
        bits = width.bit_length() - 1
        places = np.arange(width)
        inside = places < sizes[:, None]
        tree = np.full((rows, 2 * width), _NONE)
        rank = self._ranks(symbols[:, :-1], symbols[:, 1:])
        leaf = tree[:, width : 2 * width - 1]
        np.copyto(leaf, (rank << bits) | places[:-1], where=inside[:, 1:] & (rank >= 0))
        half = width // 2
        while half:
            np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2], out=tree[:, half : 2 * half])
            half //= 2
        after = np.where(inside[:, 1:], places[1:], width)
        after = np.concatenate([after, np.full((rows, 2), width)], axis=1).ravel()  # width + 1 columns; width: none
        before = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy().ravel()
        flat, alive, nodes = symbols.ravel(), inside.ravel(), tree.ravel()
        row = np.arange(rows)
        while True:
            top = nodes[row * (2 * width) + 1]
            busy = top < _NONE
            row, top = row[busy], top[busy]
            if not len(row):
                break
            at, best = top & (width - 1), top >> bits
            link, sym, root = row * (width + 1), row * width, row * (2 * width)
            gone = after[link + at]
            following = after[link + gone]
            leading = before[link + at]
            made = self.merged[best]
            flat[sym + at] = made
            alive[sym + gone] = False
            after[link + at] = following
            before[link + following] = at
            nodes[root + width + gone] = _NONE
            rank = np.where(following < width, self._ranks(made, flat[sym + np.minimum(following, width - 1)]), -1)
            nodes[root + width + at] = np.where(rank >= 0, (rank << bits) | at, _NONE)
            led = np.maximum(leading, 0)
            rank = self._ranks(flat[sym + led], made)
            fresh = np.where(rank >= 0, (rank << bits) | led, _NONE)
            led = np.where(leading >= 0, led, at)
            nodes[root + width + led] = np.where(leading >= 0, fresh, nodes[root + width + at])
            for place in (gone, at, led):
                node = (width + place) >> 1
                for _ in range(bits):
                    nodes[root + node] = np.minimum(nodes[root + 2 * node], nodes[root + 2 * node + 1])
                    node >>= 1
        return flat[alive], alive.reshape(rows, width).sum(1)

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """Tokens of one long word: the same tree in lists."""
        n = len(symbols)
        bits = (n - 1).bit_length()
        width = 1 << bits
        none, size, ranks = int(_NONE), int(self.size), self.ranks
        tree = [none] * (2 * width)
        for k in range(n - 1):
            rank = ranks.get(symbols[k] * size + symbols[k + 1])
            if rank is not None:
                tree[width + k] = rank << bits | k
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < none:
            at = tree[1] & (width - 1)
            made = int(self.merged[tree[1] >> bits])
            gone = after[at]
            following = after[at] = after[gone]
            symbols[at], symbols[gone] = made, -1
            tree[width + gone] = tree[width + at] = none
            changed = [gone, at]
            if following < n:
                before[following] = at
                rank = ranks.get(made * size + symbols[following])
                if rank is not None:
                    tree[width + at] = rank << bits | at
            lead = before[at]
            if lead >= 0:
                rank = ranks.get(symbols[lead] * size + made)
                tree[width + lead] = none if rank is None else rank << bits | lead
                changed.append(lead)
            for place in changed:
                node = (width + place) >> 1
                while node:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    tree[node] = a if a < b else b
                    node >>= 1
        return [s for s in symbols if s >= 0]

    def _words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words points[start:end], flat, and how many each has."""
        chars = ends - starts
        at = np.repeat(starts - (np.cumsum(chars) - chars), chars) + np.arange(chars.sum())
        said = points[at]
        wide = 1 + (said >= 0x80).astype(np.int64) + (said >= 0x800) + (said >= 0x10000)
        sizes = np.add.reduceat(wide, np.cumsum(chars) - chars)
        data = self.byte_ids[np.frombuffer(said.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        begin = np.cumsum(sizes) - sizes
        counts = np.ones(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(sizes == 1), data[begin[sizes == 1]])]
        width = 2
        while width <= SMALL:
            some = np.flatnonzero((sizes > width // 2) & (sizes <= width))
            for lo in range(0, len(some), (1 << 20) // width):
                part = some[lo : lo + (1 << 20) // width]
                place = begin[part][:, None] + np.arange(width)
                ids, counts[part] = self._merge_rows(data[np.minimum(place, len(data) - 1)], sizes[part])
                found.append((part, ids))
            width *= 2
        for k in np.flatnonzero(sizes > SMALL).tolist():
            ids = np.array(self._merge_long(data[begin[k] : begin[k] + sizes[k]].tolist()), np.int64)
            counts[k] = len(ids)
            found.append((np.array([k]), ids))
        out = np.empty(counts.sum(), np.int64)
        first = np.cumsum(counts) - counts
        for part, ids in found:
            n = counts[part]
            out[np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        return out, counts

    # --- texts

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the number of ids of each."""
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        first = np.zeros(len(points), bool)
        offsets = (np.cumsum(lengths) - lengths)[lengths > 0]
        first[offsets] = True
        starts = np.flatnonzero(self.word_starts(points, first))
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
        words = at[inverse]
        ids, _ = gather(self.known_ids, self.known_at, self.known_n, words)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        counts = np.zeros(len(texts), np.int64)
        counts[lengths > 0] = np.bincount(owner, weights=self.known_n[words], minlength=len(offsets)).astype(np.int64)
        return ids, counts

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the number of ids of each, special strings included."""
        if self.special_pattern is None or not any(s in t for s in self.special for t in texts):
            return self._encode_plain(texts)
        parts, owner, ids = [], [], []
        for k, text in enumerate(texts):
            for part in self.special_pattern.split(text):
                token = self.special.get(part)
                parts.append("" if token is not None else part)
                ids.append(-1 if token is None else token)
                owner.append(k)
        flat, counts = self._encode_plain(parts)
        token = np.array(ids, np.int64)
        flat = np.insert(flat, np.cumsum(counts)[token >= 0], token[token >= 0])
        return flat, np.bincount(owner, weights=counts + (token >= 0), minlength=len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.encode_flat(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []

    def decode(self, batches: list[np.ndarray]) -> list[str]:
        """Texts of lists of ids; bytes that are no UTF-8 become U+FFFD."""
        counts = np.array([len(b) for b in batches], np.int64)
        ids = np.concatenate(batches).astype(np.int64) if counts.sum() else np.zeros(0, np.int64)
        data, ends = gather(*self.raw, ids)
        cut, data = np.append(0, ends)[np.append(0, np.cumsum(counts))], data.tobytes()
        return [data[cut[k] : cut[k + 1]].decode("utf-8", "replace") for k in range(len(batches))]

    def pieces(self, text: str, size: int = CHUNK) -> Iterator[str]:
        """The text in pieces of about ``size`` characters, each cut where a word ends whatever follows.

        That is before white space after something else, and between letters and digits. A longer run without such a place stays whole.
        """
        lo = 0
        while self.cuttable and len(text) - lo > size:
            hi, cut = lo + size, None
            while cut is None and hi < len(text):
                window = np.frombuffer(text[hi - 1 : hi + 4096].encode("utf-32-le"), np.uint32)
                kind = self.kind[window]
                left, right = kind[:-1], kind[1:]
                found = np.flatnonzero((left != _BLANK) & (right == _BLANK) | (left == _LETTER) & (right == _DIGIT) | (left == _DIGIT) & (right == _LETTER))
                if len(found):
                    cut = hi + int(found[0])
                hi += 4096
            if cut is None:
                break
            yield text[lo:cut]
            lo = cut
        yield text[lo:]


def long_and_short(texts: Iterable[str], cut, size: int = CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row, piece) of about ``size`` characters; ``cut(text, size)`` gives the pieces of a text. Each row has a piece at least."""
    rows, parts, held = [], [], 0
    for k, text in enumerate(texts):
        for part in cut(text, size) if len(text) > size else (text,):
            if held + len(part) > size and parts:
                yield rows, parts
                rows, parts, held = [], [], 0
            rows.append(k)
            parts.append(part)
            held += len(part)
    if parts:
        yield rows, parts


def _digests(codec: BytePairCodec, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
    n = [0] * len(texts)
    ids_hash, text_hash = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
    for rows, parts in long_and_short(texts, codec.pieces):
        ids, counts = codec.encode_flat(parts)
        cut = np.append(0, np.cumsum(counts))
        said, ends = gather(*codec.decimal, ids)
        at, said = np.append(0, ends)[cut], said.tobytes()
        for k, (row, text) in enumerate(zip(rows, codec.decode(np.split(ids, cut[1:-1])), strict=True)):
            if counts[k]:
                if n[row]:
                    ids_hash[row].update(b",")
                ids_hash[row].update(said[at[k] : at[k + 1] - 1])
                n[row] += int(counts[k])
            text_hash[row].update(text.encode())
    return n, [h.hexdigest() for h in ids_hash], [h.hexdigest() for h in text_hash]


@lru_cache(maxsize=2)
def _held(name: str, special: bool) -> list:
    return []


def codec_of(words: Vocabulary, special: bool = True) -> BytePairCodec:
    """The codec of this Python worker: workers are reused, and so is what it has merged."""
    name = hashlib.sha256(b"".join(words.raw) + words.merges.tobytes() + words.classes).hexdigest()
    held = _held(name, special)
    if not held:
        held.append(BytePairCodec(words, special))
    return held[0]


def encode(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text, as the tokenizers library encodes it without adding special tokens.

    Strings of special tokens in a text are those tokens, or plain text where ``special`` is false. Null and empty texts have no ids.
    Rows, repeated ones and those with null ids too, give a row each; further columns of ``docs`` are left out.
    """
    words = vocabulary(path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(words, special)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            parts: list[list[np.ndarray]] = [[] for _ in texts]
            for rows, group in long_and_short(texts, codec.pieces):
                for row, ids in zip(rows, codec.encode(group), strict=True):
                    parts[row].append(ids)
            ids = [np.concatenate(p) if len(p) > 1 else p[0] for p in parts]
            ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], ["doc_id", "ids"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>), special tokens included; null ids give an empty text, ids outside the vocabulary none."""
    words = vocabulary(path)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                ids = [np.array([i for i in x or [] if i is not None and 0 <= i < codec.size], np.int64) for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(codec.decode(ids), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode(), then decode(), as digests in one pass; null texts are empty ones.

    Neither the ids nor the decoded text of a long text is ever held whole.
    """
    words = vocabulary(path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(words)
        for batch in batches:
            n, ids, texts = _digests(codec, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
