"""Scores, updates and counts of the classifiers against plain loops over one token, document or n-gram at a time."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auroral.llm import langid, quality, tokens, toxicity

TEXTS = ["good plain words here", "BAD bad!! bad bad ###", "", None, "good Words again, again", "naïve 漢字 words", "a " * 400, "good plain words here"]
LABELS = [1, 0, 1, 0, 1, 1, 0, 1]


def hash_of(data: bytes) -> int:
    values = tokens._byte_values()[np.frombuffer(data, np.uint8)]
    return int(tokens.span_hashes(values, np.array([0]), np.array([len(values)]))[0])


def mixed(x: int) -> int:
    return int(tokens.mix(np.array([x % (1 << 64)], np.uint64))[0])


def signs(text) -> list[bytes]:
    """Runs of letters, digits and non-ASCII bytes, and runs of other visible bytes."""
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d ]+", (text or "").encode())


def gram_shares(text, settings) -> dict[int, float]:
    words = signs(text)
    slots = []
    for order in settings.orders:
        for k in range(len(words) - order + 1):
            key = order
            for w in words[k : k + order]:
                key = mixed(key + hash_of(w))
            if order > 1 and words[k] == words[k + 1]:
                key = int(quality._TWICE)
            slots.append(key >> (64 - settings.bits))
    return {s: slots.count(s) * settings.scale / len(slots) for s in set(slots)}


def test_follow_the_regularised_leader_step_by_step():
    settings = quality.Settings(bits=10, epochs=2)
    ids = list(range(len(TEXTS)))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(TEXTS, pa.string()), pa.array(LABELS)], ["doc_id", "text", "label"])
    (got,) = quality._trainer(settings)(iter([batch]))
    got = np.frombuffer(got.column(0)[0].as_py(), np.float32)
    z, n, bias = {}, {}, 1 << settings.bits

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= settings.l1:
            return 0.0
        return (math.copysign(settings.l1, zi) - zi) / ((settings.beta + math.sqrt(n.get(i, 0.0))) / settings.alpha + settings.l2)

    examples = [(zlib.crc32(str(i).encode()[::-1]), gram_shares(t, settings) | {bias: 1.0}, y) for i, t, y in zip(ids, TEXTS, LABELS, strict=True)]
    examples.sort(key=lambda e: (e[0], len(e[1])))
    for _ in range(settings.epochs):
        for _, x, y in examples:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / settings.alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = np.array([weight(i) for i in range(bias + 1)])
    assert np.abs(got - want).max() < 1e-4 and np.abs(want).max() > 0.1


def test_quality_scores_from_given_weights(spark):
    settings = quality.Settings(bits=10)
    w = np.random.default_rng(0).normal(size=(1 << 10) + 1).astype(np.float32)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, w, settings).collect()}
    for k, t in enumerate(TEXTS):
        total = float(w[-1]) + sum(float(w[s]) * x for s, x in gram_shares(t, settings).items())
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-4)


def bag(text, settings) -> dict[int, int]:
    """Slots of a text's words and their character n-grams with word ends, with counts."""
    out: dict[int, int] = {}
    for word in signs(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        slots = [mixed(hash_of(word))]
        chars = [c.encode() for c in f" {word.decode()} "]
        for n in range(settings.min_n, settings.max_n + 1):
            slots += [mixed(hash_of(b"".join(chars[k : k + n])) + n) for k in range(len(chars) - n + 1)]
        for s in slots:
            out[s >> (64 - settings.bits)] = out.get(s >> (64 - settings.bits), 0) + 1
    return out


def test_toxicity_scores_from_given_weights(spark):
    settings = toxicity.Settings(bits=10, prior=5.0)
    w = np.random.default_rng(1).normal(size=(1 << 10) + 1).astype(np.float32)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, w, settings).collect()}
    for k, t in enumerate(TEXTS):
        counts = bag(t, settings)
        total = float(w[-1]) + sum(float(w[s]) * n for s, n in counts.items()) / (sum(counts.values()) + settings.prior)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-4)


def test_embeddings_and_softmax_step_by_step():
    settings = toxicity.Settings(bits=8, dim=3, epochs=2, prior=5.0, min_docs=2)
    ids = list(range(len(TEXTS)))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(TEXTS, pa.string()), pa.array(LABELS)], ["doc_id", "text", "label"])
    (got,) = toxicity._trainer(settings)(iter([batch]))
    got = np.frombuffer(got.column(0)[0].as_py(), np.float32)
    bags = [bag(t, settings) for t in TEXTS]
    examples = [(zlib.crc32(str(i).encode()[::-1]), {s: c / (sum(b.values()) + settings.prior) for s, c in b.items()}, y) for i, b, y in zip(ids, bags, LABELS, strict=True)]
    examples.sort(key=lambda e: (e[0], len(e[1])))
    known = {s for s in range(256) if sum(s in b for b in bags) >= settings.min_docs}
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.01, (256, 3))
    table[[s for s in range(256) if s not in known]] = 0
    head, bias, seen = rng.normal(0, 0.5, (3, 2)), np.log([3 / 8, 5 / 8]), np.full(256, 1e-6)
    step, steps = 0, settings.epochs * len(examples)
    for _ in range(settings.epochs):
        for k in rng.permutation(len(examples)):
            _, x, y = examples[k]
            rate = settings.rate * (1 - step / steps)
            step += 1
            x = {s: v for s, v in x.items() if s in known}
            if not x:
                continue
            mean = [settings.scale * sum(v * table[s, d] for s, v in x.items()) for d in range(3)]
            logits = [sum(mean[d] * head[d, c] for d in range(3)) + bias[c] for c in range(2)]
            e = [math.exp(v - max(logits)) for v in logits]
            error = [e[c] / sum(e) - (c == y) for c in range(2)]
            back = [settings.scale * sum(head[d, c] * error[c] for c in range(2)) for d in range(3)]
            for d in range(3):
                for c in range(2):
                    head[d, c] -= 0.02 * rate * min(5, max(-5, mean[d] * error[c]))
            for c in range(2):
                bias[c] -= 0.02 * rate * error[c]
            for s, v in x.items():
                pull = [v * b for b in back]
                seen[s] += sum(g * g for g in pull) / 3
                for d in range(3):
                    table[s, d] -= 0.1 * rate * (pull[d] / math.sqrt(seen[s]) + settings.decay * table[s, d])
    want = np.append(settings.scale * table @ (head[:, 1] - head[:, 0]), bias[1] - bias[0])
    assert np.abs(got - want).max() < 1e-2 * np.abs(want).max() and np.abs(want).max() > 0.1


def test_language_counts_from_given_filters(spark):
    settings = langid.Settings(sizes=(2, 3), bits=9)
    rng = np.random.default_rng(3)
    masks = rng.integers(0, 8, 1 << 9).astype(np.uint64)
    rate = np.array([((masks >> np.uint64(k)) & np.uint64(1)).mean() ** settings.probes for k in range(3)])
    model = langid.Model(["aa", "bb", "cc"], masks, rate)
    texts = [*TEXTS, "x" * 5000, "?!", "the same the same", "ß"]
    docs = spark.createDataFrame([(k, t, "z", 0.5) for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang_pred string, score double")
    rows = {r.doc_id: r for r in langid.predict(docs, model, settings).collect()}
    assert len(rows) == len(texts) + 1 and rows[0][1:] == rows[len(texts)][1:]
    for k, t in enumerate(texts):
        data = re.sub(rb"[^a-z\x80-\xff]+", b" ", (t or "").encode().lower())
        counts, total = [0, 0, 0], 0
        for n in settings.sizes:
            for i in range(len(data) - n + 1):
                h = mixed(int.from_bytes(bytes([n]) + data[i : i + n], "big"))
                said = int(masks[h & 511]) & int(masks[h >> 9 & 511])
                total += 1
                for c in range(3):
                    counts[c] += said >> c & 1
        corrected = [max((counts[c] - total * rate[c]) / (1 - rate[c]), 0) for c in range(3)]
        if not any(c.isalpha() for c in t or ""):
            assert (rows[k].lang_pred, rows[k].score) == ("und", 0.0)
        else:
            assert rows[k].lang_pred == model.languages[int(np.argmax(corrected))]
            assert rows[k].score == pytest.approx(max(corrected) / sum(corrected) if sum(corrected) else 1 / 3)


def test_filters_hold_every_gram_of_every_language(spark):
    """More languages than a mask has bits; production settings but for the size."""
    spell = lambda k: "".join(chr(97 + d) for d in (k // 26, k % 26))
    own = [" ".join(f"{spell(k)}{w}{spell(k)}" for w in ("oqo", "uxu", "yjy")) for k in range(70)]
    rows = [(3 * k, f"shared beginning {t}", f"l{k:02}") for k, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = langid.Settings(bits=14)
    model = langid.train(docs, F.lit(True), settings)
    assert model.languages == [lang for _, _, lang in rows] and len(model.masks) == 2 << 14
    for k, (_, text, _) in enumerate(rows):
        for _, _, keys, _ in langid.grams(pa.array([text]), settings):
            for at in langid._slots(keys, settings):
                assert (model.masks[(k // 64 << 14) + at] >> np.uint64(k % 64) & np.uint64(1)).all()
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.select("doc_id", F.lit(None).cast("string").alias("lang"), "text"), model, settings).collect()}
    assert got == {i: lang for i, _, lang in rows}
