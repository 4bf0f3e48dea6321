"""Byte-level BPE against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auroral.llm import bytepairs, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids int, label int, n_tokens long"
ODD = [None, "", " ", "  a  b ", "'s't'll 's\n's  'lls", "x" * 20000, "漢字かな" * 900, "a\n \n b", "<|endoftext|>", "<|endoftext|><|endoftext|>a <|endoftext|> b", "<|endoftext", "\x00▁�\U0001f600", "é​　 x", "1a2b ٣²½"]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def rows_of(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def noise(seed, n):
    rng = random.Random(seed)
    letters = [*"abcst'dmrvel  \n\t\r 　!?.12é漢", "<|endoftext|>", "'re", "'ll", "​", "̀", "  ", "▁", "\x85", "\x1c"]
    anything = [chr(c) for c in (rng.randrange(0x110000) for _ in range(3000)) if not 0xD800 <= c < 0xE000]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)] + ["".join(rng.choice(anything) for _ in range(100)) for _ in range(n // 10)]


def test_registered_query_equals_the_library(spark, library):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op11_byte_bpe"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == rows_of(library, docs)


def test_odd_rows(spark, library):
    rows = [*enumerate(ODD), (None, "no id"), (3, "  a  b "), (3, "  a  b ")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, bytepairs.round_trip_digest(docs, PATH).collect()), key=str) == rows_of(library, rows)
    encoded = bytepairs.encode(docs, PATH)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str) == sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in bytepairs.decode(encoded, PATH).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert bytepairs.round_trip_digest(docs.limit(0), PATH).count() == 0


def test_texts_and_pieces(library):
    codec = bytepairs.BytePairCodec(bytepairs.vocabulary(PATH))
    texts = noise(7, 4000)
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in codec.encode(texts)] == ids
    assert codec.decode([np.array(x, np.int64) for x in ids]) == library.decode_batch(ids, skip_special_tokens=False)
    whole = "".join(texts)
    for size in (40, 700):
        parts = list(codec.pieces(whole, size))
        assert "".join(parts) == whole and len(parts) > len(whole) / size / 20
        assert [i for x in codec.encode(parts) for i in x.tolist()] == library.encode(whole, add_special_tokens=False).ids
    rng = random.Random(3)
    ids = [[rng.randrange(50257) for _ in range(rng.randrange(30))] for _ in range(2000)]  # bytes that are no text
    assert codec.decode([np.array(x, np.int64) for x in ids]) == library.decode_batch(ids, skip_special_tokens=False)


def test_special_strings_as_plain_text(library):
    codec = bytepairs.BytePairCodec(bytepairs.vocabulary(PATH), special=False)
    other = Tokenizer.from_file(PATH)
    other.encode_special_tokens = True
    texts = noise(9, 500) + ["<|endoftext|>"]
    assert [x.tolist() for x in codec.encode(texts)] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def test_trees_of_both_kinds_agree():
    codec = bytepairs.BytePairCodec(bytepairs.vocabulary(PATH))
    rng = random.Random(5)
    for size in (2, 3, 8, 31, 64):
        words = np.array([[rng.choice(b"abcdeinrst") for _ in range(size)] for _ in range(50)])
        width = 1 << (size - 1).bit_length()
        rows = np.zeros((50, width), np.int64)
        rows[:, :size] = codec.byte_ids[words]
        flat, counts = codec._merge_rows(rows.copy(), np.full(50, size))
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [codec._merge_long(r[:size].tolist()) for r in rows]


def test_unsupported_files_are_refused(tmp_path):
    said = json.loads(open(PATH, encoding="utf-8").read())
    said["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(said))
    with pytest.raises(ValueError):
        bytepairs.vocabulary(str(tmp_path / "t.json"))
