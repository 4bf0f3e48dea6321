"""Alignment of two tokenizers against plain loops over both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from auroral.llm import alignment, bytepairs, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block int, b int, a int, n_a long, doc int"
ODD = [None, "", " ", "  ", "a", "  a  b ", "▁", "a ▁b", "<|endoftext|> x", "</s> <s> <unk>", "x" * 5000, "漢字かな交じり文 " * 200, "\n\n a\tb\r\n", "\x00", "é​　 \U0001f600�", "1a2b 's 'll"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    a.no_truncation()
    letters = bytepairs._byte_letters()
    return a, [None if (t := a.id_to_token(k)) is None else bytes(letters[c] for c in t) for k in range(a.get_vocab_size())], sentencepiece.SentencePieceProcessor(model_file=B)


def plain(rows, sides):
    a, raw_a, b = sides
    said = []
    for doc_id, text in rows:
        ids_a, ids_b, ok = [], [], False
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [raw_a[i] for i in ids_a]
            bytes_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
            ok = b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()
        if not ok:
            said.append((doc_id, [], [], [], ""))
            continue
        ends_a, ends_b, at = [], [], 0
        for x in bytes_a:
            ends_a.append(at := at + len(x))
        at = 0
        for x in bytes_b:
            ends_b.append(at := at + len(x))
        place_b = {e: k for k, e in enumerate(ends_b)}
        links, out, i, j = [], [], 0, 0
        for k, e in enumerate(ends_a):
            if e in place_b:
                links.append((ids_a[k], ids_b[place_b[e]]))
                out.append(",".join(map(str, ids_a[i : k + 1])) + "|" + ",".join(map(str, ids_b[j : place_b[e] + 1])))
                i, j = k + 1, place_b[e] + 1
        said.append((doc_id, ids_a, ids_b, links, ";".join(out)))
    count = Counter(x for s in said for x in s[3])
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((i, len(x), len(y), len(ls), len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if x else "") for i, x, y, ls, g in said), key=str)


def mixed(seed, n):
    rng = random.Random(seed)
    words = ["the", "cat's", "Überraschung", "año", "12,5", "e.g.", "\n", "  ", "foo_bar", "!!", "漢字", "naïve", "x" * 40, "▁" if seed == 2 else "z", "co-operate", "\t"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_registered_query_equals_plain_loops(spark, sides):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op12_alignment"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, sides)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows_many_blocks_and_parts(spark, sides, seed, monkeypatch):
    rows = [*enumerate(ODD), *((100 + k, t) for k, t in enumerate(mixed(seed, 120))), (None, "no id"), (3, "the cat"), (3, "the cat")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], SCHEMA).repartition(3)
    want = plain(rows, sides)
    assert sorted(map(tuple, alignment.align(docs, A, B).collect()), key=str) == want
    # small blocks, ids dealt out over many parts
    assert sorted(map(tuple, alignment.align(docs, A, B, block_chars=300, part_postings=2).collect()), key=str) == want
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_long_texts_pass_in_pieces(sides):
    aligner = alignment.Aligner(bytepairs.BytePairCodec(bytepairs.vocabulary(A), False), alignment.PieceCodec(open(B, "rb").read()))
    text = "\n".join(mixed(1, 150)) + "  tail "
    whole = alignment.Block([text, "two words"], aligner)
    for size in (10, 333):
        parts = list(aligner.pieces(text, size))
        assert " ".join(parts) == text and all(parts) and len(parts) > 5
        block = alignment.Block([""], aligner)
        for p in parts:
            block._add(alignment.np.array([0]), [p])
        block.good[:] = True
        assert block.hashes[0].hexdigest() == whole.hashes[0].hexdigest() and (block.n_a[0], block.n_b[0], block.n_links[0]) == (whole.n_a[0], whole.n_b[0], whole.n_links[0])
        b, a, doc, times = whole.postings()
        b2, a2, _, times2 = block.postings()
        own = doc == 0
        assert (b[own] == b2).all() and (a[own] == a2).all() and (times[own] == times2).all()


def test_contributions_are_handed_on_in_between(spark, sides, monkeypatch):
    rows = list(enumerate(mixed(1, 60)))
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)
    blocks = alignment.materialise(alignment.encoded_blocks(docs, A, B, 200), "test-blocks")
    parts = alignment.contributions(blocks).collect()
    monkeypatch.setattr(alignment, "HELD", 7)
    counts = {(r.b, r.a): r.links for r in alignment.pair_counts(blocks).collect()}
    most = {}
    for (b, _), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    lists = [r for r in blocks.where("b is not null").collect()]
    import pyarrow as pa

    stream = []
    for b in sorted({r.b for r in lists}):
        ids = sorted(x for y, x in counts if y == b)
        stream.append({"block": None, "a": ids, "links": [counts[b, x] for x in ids], "n_docs": None, "docs": None, "times": None})
        stream += [{"block": r.block, "a": r.a, "links": None, "n_docs": r.n_docs, "docs": r.docs, "times": r.times} for r in lists if r.b == b]
    schema = pa.schema({"block": pa.int64(), "a": pa.list_(pa.int32()), "links": pa.list_(pa.int64()), "n_docs": pa.list_(pa.int32()), "docs": pa.list_(pa.int16()), "times": pa.list_(pa.int64())})
    out = [r for batch in alignment._contribute(iter(pa.Table.from_pylist(stream, schema).to_batches(50))) for r in batch.to_pylist()]
    assert len(out) > len(parts)

    def sums(rows):
        total = Counter()
        for r in rows:
            for d, x, y in zip(r["docs"], r["best"], r["sums"], strict=True):
                total[r["block"], d] += complex(x, y)
        return total

    assert sums(out) == sums([r.asDict() for r in parts])


def test_groups(spark, sides):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in enumerate(ODD)], SCHEMA)
    want = {r[0]: r for r in plain(list(enumerate(ODD)), sides)}
    for r in alignment.groups(docs, A, B).collect():
        text = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups)
        assert len(r.groups) == want[r.doc_id][3] and (hashlib.sha256(text.encode()).hexdigest() if r.groups else "") == want[r.doc_id][7]
