"""Substring deduplication with repeated-phrase automata.

Documents are dealt into blocks of bounded size; what blocks tell each other are
rows keyed by a hash, one for each distinct key of a block, however often it
occurs there.

1. Phrases. Every window of ``window`` words selects one of its shorter word
   n-grams by least hash (winnowing), so that equal windows select equal phrases.
   Phrases that occur once in the corpus rule their windows out.
2. Confirmation. The windows left are grouped by a 128-bit key over all blocks:
   those that occur more than once are confirmed, and each block with such a
   window learns one place of it in the block, where its words can be read, and
   its leader, the first place of all.
3. Location. Runs of the places that confirmation gave are a block's passages.
   A pyahocorasick automaton over word numbers holds pieces of them, so placed that every
   window contains a whole piece; windows whose piece many passages share are
   keys of their own, in further automata of bounded size. All words of all
   the block's documents are streamed through these; a piece found is extended in both
   directions. This gives every occurrence of every confirmed window, and nothing else
   does: no window is looked up. Those that begin after their leader go.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_count, discard, give_back, materialise
from .tokens import WHITESPACE, chunks, mix, window_hashes

_SECOND = np.uint64(0xA0761D6478BD642F)
#: Bytes of text, and words, that are worked on at once: a block's arrays are held whole, what is reckoned on the way is not.
STEP = 1 << 16
#: Rows whose texts are Python strings at once.
ROWS = 256


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in its row of each word."""
    hashes, rows = [], []
    for chunk in chunks(texts, STEP):
        _, _, h, r = chunk.tokens(WHITESPACE)
        hashes.append(h)
        rows.append((r + chunk.lo).astype(np.int32))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    r = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    first = np.searchsorted(r, np.arange(len(texts), dtype=np.int32)).astype(np.int32)
    return h, r, np.arange(len(h), dtype=np.int32) - (first[r] if len(r) else np.int32(0))


def _windows(h: np.ndarray, r: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of the window that begins at each word; 0 where its document ends before. ``second`` gives another hash."""
    out = np.zeros(len(h), np.uint64)
    n = len(h) - size + 1
    for lo in range(0, n, STEP):
        hi = min(lo + STEP, n)
        own = h[lo : hi + size - 1]
        found = window_hashes(mix(own ^ _SECOND) if second else own, size) | np.uint64(1)
        out[lo:hi] = np.where(r[lo:hi] == r[lo + size - 1 : hi + size - 1], found, np.uint64(0))
    return out


def _anchors(h: np.ndarray, r: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor (a hash) of the window that begins at each word, 0 where there is no window, and where the anchor is."""
    grams = _windows(h, r, anchor)
    out, where = np.zeros(len(h), np.uint64), np.zeros(len(h), np.int32)
    n = len(h) - window + 1
    for lo in range(0, n, STEP):
        hi = min(lo + STEP, n)
        least, at = grams[lo:hi].copy(), np.arange(lo, hi, dtype=np.int32)
        for k in range(1, window - anchor + 1):
            next_ = grams[lo + k : hi + k]
            less = next_ < least
            at[less] = np.flatnonzero(less) + (lo + k)
            np.minimum(least, next_, out=least)
        out[lo:hi] = np.where(r[lo:hi] == r[lo + window - 1 : hi + window - 1], least, np.uint64(0))
        where[lo:hi] = at
    return out, where


def _selected(anchors: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Anchors once for each place that neighbouring windows select."""
    keep = anchors != 0
    if len(anchors):
        keep[1:] &= (anchors[1:] != anchors[:-1]) | (where[1:] != where[:-1])
    return anchors[keep]


def _lean(work, *tables: pa.Table) -> pa.Table:
    """work(*tables), with this worker's freed memory given back before and after: between two calls a worker holds little."""
    give_back()
    out = work(*tables)
    give_back()
    return out


def _in_order(table: pa.Table, extra: tuple[str, ...] = ()) -> pa.Table:
    """The rows of a block in the order of their documents."""
    return table.select(["doc_id", "text", "block", *extra]).sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _ask_phrases(window: int, phrase: int):
    """The block's distinct phrases, and whether it has more than one of each."""

    def run(table: pa.Table) -> pa.Table:
        h, r, _ = _tokens(table.column("text"))
        unique, count = np.unique(_selected(*_anchors(h, r, window, phrase)), return_counts=True)
        block = np.full(len(unique), table.column("block")[0].as_py(), np.int32)
        return pa.table({"phrase": unique.view(np.int64), "block": block, "many": count > 1})

    return lambda table: _lean(run, table)


_WINDOWS = [("k0", pa.int64()), ("k1", pa.int64()), ("block", pa.int32()), ("doc", pa.int64()), ("place", pa.int32()), ("at", pa.int32()), ("many", pa.bool_())]
#: A piece that more places share is not extended at each of them.
SHARED = 4
#: Windows that are keys of one automaton.
SHARD = 1 << 15


def _ask_windows(window: int, phrase: int):
    """The block's distinct windows whose phrases recur: key, first place (also as the number of the block's word), and whether it has more than one of each."""

    def run(table: pa.Table, phrases: pa.Table) -> pa.Table:
        if not table.num_rows or not phrases.num_rows:
            return pa.table([pa.array([], t) for _, t in _WINDOWS], [n for n, _ in _WINDOWS])
        table = _in_order(table)
        h, r, place = _tokens(table.column("text"))
        anchors, _ = _anchors(h, r, window, phrase)
        known = np.sort(phrases.column("phrase").to_numpy().view(np.uint64))
        begin = np.flatnonzero(anchors != 0)
        at = np.searchsorted(known, anchors[begin])
        begin = begin[known[np.minimum(at, len(known) - 1)] == anchors[begin]]
        del anchors, at
        k0, k1 = _windows(h, r, window)[begin], _windows(h, r, window, second=True)[begin]
        doc, place = table.column("doc_id").to_numpy()[r[begin]], place[begin]
        order = np.lexsort((place, doc, k1, k0))
        k0, k1 = k0[order], k1[order]
        first = np.flatnonzero(np.append(True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]))[: len(k0)])
        many = np.diff(np.append(first, len(k0))) > 1
        lead = order[first]
        block = np.full(len(first), table.column("block")[0].as_py(), np.int32)
        return pa.table({"k0": k0[first].view(np.int64), "k1": k1[first].view(np.int64), "block": block, "doc": doc[lead], "place": place[lead].astype(np.int32), "at": begin[lead].astype(np.int32), "many": many})

    return lambda table, phrases: _lean(run, table, phrases)


def _spelled(numbers: np.ndarray) -> str:
    """Each number as three characters, whose places have alphabets of their own: an automaton's node then has few children, and matches begin at words."""
    base = max(2, math.ceil((int(numbers.max(initial=0)) + 1) ** (1 / 3)))
    spelled = []
    for lo in range(0, len(numbers), STEP):
        own = numbers[lo : lo + STEP]
        places = np.stack([own // (base * base), base + own // base % base, 2 * base + own % base], axis=1)
        spelled.append((places.ravel() + 0x100).astype("<u4").tobytes().decode("utf-32-le"))
    return "".join(spelled)


def _numbered(words: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the distinct words that stand somewhere ``inside``, 0 for all others."""
    known = np.unique(words[inside])
    out = np.zeros(len(words), np.int32)
    for lo in range(0, len(words) if len(known) else 0, STEP):
        own = words[lo : lo + STEP]
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        out[lo : lo + STEP] = np.where(known[at] == own, at + 1, 0)
    return out


class Passages:
    """The passages of a block and the automata of their pieces.

    ``words`` are all words of the block as numbers; ``confirmed`` holds a place of each distinct confirmed window, in order.
    """

    def __init__(self, words: np.ndarray, confirmed: np.ndarray, window: int):
        self.window = window
        self.piece = (window * 3 + 4) // 5
        stride = window - self.piece + 1
        cut = np.flatnonzero(np.append(True, confirmed[1:] != confirmed[:-1] + 1))
        lows, highs = confirmed[cut], confirmed[np.append(cut[1:], len(confirmed)) - 1] + window
        self.runs = list(zip(lows.tolist(), highs.tolist(), strict=True))
        inside = np.zeros(len(words) + 1, np.int32)
        np.add.at(inside, lows, 1)
        np.add.at(inside, highs, -1)
        np.cumsum(inside, out=inside)
        self.text = _spelled(_numbered(words, inside[:-1] > 0))  # words of no passage are all 0
        del inside
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, (lo, hi) in enumerate(self.runs):
            for at in range(lo, hi - self.piece + 1, stride):
                pieces.setdefault(self.text[3 * at : 3 * (at + self.piece)], []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        whole = []  # windows whose one piece is shared
        for key, places in pieces.items():
            if len(places) <= SHARED:
                self.automaton.add_word(key, places)
                continue
            for number, at in places:
                lo, hi = self.runs[number]
                whole += range(max(lo, at - stride + 1), min(at, hi - window) + 1)
        self.automaton.make_automaton()
        self.whole = []
        for k in range(0, len(whole), SHARD):
            shard = ahocorasick.Automaton()
            for at in whole[k : k + SHARD]:
                shard.add_word(self.text[3 * at : 3 * (at + window)], at)
            shard.make_automaton()
            self.whole.append(shard)

    def occurrences(self, first: int, last: int):
        """(lo, hi, shift) of each stretch of a window or more of words[first:last] that equals words[lo - shift : hi - shift] of a passage.

        Takes time in proportion to the words and to what is returned: a place has ``SHARED`` extensions at most, and windows found whole are results.
        """
        t = self.text
        done: dict[tuple[int, int], int] = {}  # (passage, shift): compared up to here
        for end, places in self.automaton.iter(t[3 * first : 3 * last]) if len(self.automaton) else ():
            at = first + (end + 1) // 3 - self.piece
            for number, other in places:
                shift = at - other
                if done.get((number, shift), -1) > at:
                    continue
                a, b = self.runs[number]
                low, high = max(first, a + shift), min(last, b + shift)
                lo, hi = at, at + self.piece
                for step in (32, 4, 1):
                    while lo - step >= low and t[3 * (lo - step) : 3 * lo] == t[3 * (lo - step - shift) : 3 * (lo - shift)]:
                        lo -= step
                for step in (256, 32, 4, 1):
                    while hi + step <= high and t[3 * hi : 3 * (hi + step)] == t[3 * (hi - shift) : 3 * (hi + step - shift)]:
                        hi += step
                done[number, shift] = hi
                if hi - lo >= self.window:
                    yield lo, hi, shift
        for shard in self.whole:
            for end, other in shard.iter(t[3 * first : 3 * last]):
                hi = first + (end + 1) // 3
                yield hi - self.window, hi, hi - self.window - other


def _repeated(table: pa.Table, confirmed: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the block whether it goes, and the row of each word."""
    h, r, place = _tokens(table.column("text"))
    later = np.zeros(len(h), bool)
    if confirmed.num_rows and len(h) >= window:
        at = confirmed.column("at").to_numpy()
        order = np.argsort(at)
        at, lead_doc, lead_place = at[order], confirmed.column("doc").to_numpy()[order], confirmed.column("place").to_numpy()[order]
        number = np.zeros(len(h), np.int32)  # of the window that confirmation saw here
        number[at] = np.arange(len(at))
        passages = Passages(h, at.astype(np.int64), window)
        del h
        ids, own = table.column("doc_id").to_numpy(), np.bincount(r, minlength=table.num_rows)
        last = np.cumsum(own)
        for row in np.flatnonzero(own >= window).tolist():
            doc = ids[row]
            for lo, hi, shift in passages.occurrences(int(last[row] - own[row]), int(last[row])):
                said = number[lo - shift : hi - shift - window + 1]
                later[lo : hi - window + 1] |= (lead_doc[said] < doc) | ((lead_doc[said] == doc) & (lead_place[said] < place[lo : hi - window + 1]))
    # a word goes if one of the windows that cover it does
    so_far = np.cumsum(later, dtype=np.int32)
    gone = so_far > 0
    gone[window:] = so_far[window:] > so_far[:-window]
    return gone, r


def _remover(window: int, names: tuple[str, ...], layout: bool):
    def run(table: pa.Table, confirmed: pa.Table) -> pa.Table:
        table = _in_order(table, names)
        gone, r = _repeated(table, confirmed, window)
        give_back()
        size = np.bincount(r, minlength=table.num_rows)
        removed = np.bincount(r[gone], minlength=table.num_rows)
        last, kept = np.cumsum(size), []
        for lo in range(0, table.num_rows, ROWS):
            own = []
            for k, text in enumerate(table.column("text").slice(lo, ROWS).to_pylist(), lo):
                if layout and not removed[k]:
                    own.append(text)
                    continue
                words = text.encode("utf-8", "surrogatepass").split()
                if removed[k]:
                    words = [words[i] for i in np.flatnonzero(~gone[last[k] - size[k] : last[k]]).tolist()]
                own.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            kept.append(pa.array(own, pa.string()))
        columns = [table.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.chunked_array(kept, pa.string()), *[table.column(c) for c in names]]
        return pa.Table.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", *names])

    return lambda table, confirmed: _lean(run, table, confirmed)


def remove_repeats(docs: DataFrame, window: int = 20, block_bytes: int = 7 << 19, extra: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, *extra) of every row's whole text, kept being the words left, joined by one space;
    with ``layout`` a text of which nothing goes is kept as it is. ``extra`` names further columns to carry along, other than these.

    A word is a run of characters other than ASCII white space. A word goes if a window of ``window`` words that covers
    it also begins earlier: in a document of smaller doc_id, or earlier in the same one. Windows are judged on the input.
    doc_id is integral; null ids count as the largest. Of rows with equal ids, those of equal text keep one order (the
    place decides), so that equal windows at equal places of them all stay. Null texts have no words; texts of fewer words
    than a window stay whole. Phrases and confirmed windows are written to the shared folder while this is called.
    """
    n_blocks = block_count(docs, block_bytes)
    phrase = (window * 3 + 4) // 5
    text = F.coalesce("text", F.lit(""))
    names = tuple(f"extra{k}" for k in range(len(extra)))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")  # rows without an id or of one id are no single block
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), text.alias("text"), block.alias("block"), *[F.col(f"`{c}`").alias(n) for c, n in zip(extra, names, strict=True)])
    brief = own.select("doc_id", "text", "block").repartition("block").groupBy("block")
    asked = brief.applyInArrow(_ask_phrases(window, phrase), "phrase long, block int, many boolean")
    same = Window.partitionBy("phrase")
    recurs = (F.count("*").over(same) > 1) | F.max("many").over(same)
    phrases = materialise(asked.withColumn("recurs", recurs).where("recurs").select("block", "phrase"), "repeats-phrases")
    wanted = brief.cogroup(phrases.groupBy("block")).applyInArrow(_ask_windows(window, phrase), "k0 long, k1 long, block int, doc long, place int, at int, many boolean")
    same = Window.partitionBy("k0", "k1")
    led = wanted.withColumn("lead", F.min(F.struct("doc", "place")).over(same)).withColumn("recurs", (F.count("*").over(same) > 1) | F.max("many").over(same))
    confirmed = materialise(led.where("recurs").select("block", "at", "lead.doc", "lead.place"), "repeats-windows")
    discard(phrases)
    more = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(extra, names, strict=True))
    out = own.repartition("block").groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(_remover(window, names, layout), "doc_id long, n_words long, n_removed long, kept string" + more)
    doc_id = F.when(F.col("doc_id") != (1 << 63) - 1, F.col("doc_id")).alias("doc_id")
    return out.select(doc_id, "n_words", "n_removed", "kept", *[F.col(n).alias(c) for c, n in zip(extra, names, strict=True)])


def digest(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: digest(remove_repeats(documents)) in DuckDB's SQL
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE k > 1),
words AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS s FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
