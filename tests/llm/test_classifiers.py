"""The two classifiers against plain versions of their features, training and scores."""

import collections
import math
import re

import numpy as np
import pytest
import xxhash

from weftline.llm import quality, toxicity

M32, M64 = (1 << 32) - 1, (1 << 64) - 1
TEXTS = ["the cat sat on the mat the cat", "Buy NOW!!! http://x.y/z buy now", "", None, "a", "ünï çödé 日本語 ünï", "one  two\tthree\nfour\x1cfive", "same same same same"]


def plain_features(text):
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    h = [xxhash.xxh64_intdigest(t) for t in tokens]
    out = set(x >> 44 for x in h)
    g = h
    for n in (1, 2):
        if len(h) <= n:
            break
        g = [(a * 0x9E3779B97F4A7C15 & M64) ^ b for a, b in zip(g, h[n:])]
        out |= {(x * 0xC2B2AE3D27D4EB4F & M64) >> 44 for x in g}
    return sorted(out)


def test_word_features():
    for t in TEXTS:
        assert quality.features(t).tolist() == plain_features(t)


def plain_ftrl(bags, labels, alpha=1.0, beta=0.1, l1=0.02, l2=0.1, rounds=2, seed=7):
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(bags)):
            x = {i: 1 / math.sqrt(max(1, len(bags[k]))) for i in bags[k]} | {1 << 20: 1.0}
            w = {i: weight(i) for i in x}
            error = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - labels[k]
            for i in x:
                g = error * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return weight


def test_quality_training_and_scores(spark):
    rng = np.random.default_rng(2)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 12)), int(i % 3 > 0)) for i in range(90)]
    bags = [plain_features(t) for _, t, _ in rows]
    weights = quality.train([np.array(b, np.int32) for b in bags], np.array([y for *_, y in rows], float))
    weight = plain_ftrl(bags, [y for *_, y in rows])
    for i in {1 << 20, *bags[0], *bags[1], *bags[50]}:
        assert weights[i] == pytest.approx(weight(i), rel=1e-4, abs=1e-6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in quality.score(docs, weights).collect():
        bag = plain_features(r.text)
        logit = float(weights[1 << 20]) + sum(float(weights[i]) for i in bag) / math.sqrt(max(1, len(bag)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-6) and r.predicted == int(r.score >= 0.3)


def plain_buckets(text):
    data = [b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in b" " + text + b" "]
    out = collections.Counter()
    for n in (3, 4, 5, 6):
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if 32 in gram[1:-1]:
                continue
            h = gram[0] * 16777619 & M32
            for b in gram[1:]:
                h = (h ^ b) * 16777619 & M32
            out[((h * 2654435769 + n) & M32) >> 14] += 1
    return out


def test_character_buckets(monkeypatch):
    for block in (1 << 20, 16):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        for t in TEXTS:
            raw = (t or "").encode()
            assert collections.Counter(toxicity.buckets(raw).tolist()) == plain_buckets(raw)


def test_toxicity_scores(spark):
    """A score is the softmax of the mean of the embeddings, worked out the long way."""
    rng = np.random.default_rng(4)
    nice, rude = ["friend", "garden", "flower", "weather"], ["moron", "idiots", "stupid", "trash"]
    rows = [(i, " ".join(rng.choice(rude if i % 2 else nice, 8)), i % 2) for i in range(80)]
    model = toxicity.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "stupidd moronn idiotss"), (1001, "flowerss frriend"), (1002, ""), (1003, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for r in got.values():
        grams = plain_buckets((r.text or "").encode()) if r.text else {}
        mean = sum((n * model.embedding[i].astype(float) for i, n in grams.items()), np.zeros(model.embedding.shape[1])) / max(1, sum(grams.values()) if grams else 1)
        logits = mean @ model.softmax.astype(float) + model.bias
        want = np.exp(logits - logits.max())
        assert r.score == pytest.approx(float(want[1] / want.sum()), rel=1e-3, abs=1e-5) and r.predicted == int(r.score >= 0.5)
    assert got[1000].score > 0.8 and got[1001].score < 0.2
