"""The classifiers against a plain version of their features and of FTRL-proximal, feature by feature."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh3_64_intdigest

from shelfmark.llm import ftrl, quality_classifier, toxicity
from shelfmark.llm.common import py_crc_mod, words_of

WORDS = [f"{a}{b}" for a in ("ab", "Cd", "e", "fgh", "éa", "Z9", "x*", "--") for b in ("", "o", "UN", "3", "tion", "!!")]
FULL = (1 << 64) - 1


def mix(x):
    x &= FULL
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & FULL
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & FULL
    return x ^ x >> 31


def gram(h):
    key = h[0]
    for x in h[1:]:
        key = (mix(key) * 0x9E3779B97F4A7C15 + x) & FULL
    return key


def plain_features(text, spec):
    words = words_of(text)
    low = [w.lower() if spec.lower else w for w in words]
    h = [xxh3_64_intdigest(w.encode()) for w in low]
    keys = [gram(h[i : i + k]) + k for k in spec.orders for i in range(len(h) - k + 1)]
    keys += [mix(h[i] + gap * 7919) * 31 + h[i + gap + 1] for gap in spec.skips for i in range(len(h) - gap - 1)]
    keys += [xxh3_64_intdigest(w[:k].encode()) + k * 104729 for k in spec.stems for w in low]
    s = [0x3D3D if i and h[i] == h[i - 1] else xxh3_64_intdigest(b"shape " + ftrl.shape_of(w).encode()) for i, w in enumerate(words)]
    for k in spec.shapes:
        times = Counter(mix(gram(s[i : i + k])) >> 24 for i in range(len(s) - k + 1))
        keys += [mix(key) + min(10, math.floor(-math.log2(c / len(words)))) + (k << 60) for key, c in times.items()]
    return {mix(k & FULL) >> (64 - spec.bits) for k in keys}


def plain_fit(rows, spec):
    z, n, zb, nb, b = {}, {}, 0.0, 0.0, 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= spec.l1 else (math.copysign(spec.l1, zi) - zi) / ((spec.beta + math.sqrt(n.get(i, 0.0))) / spec.alpha + spec.l2)

    for _ in range(spec.epochs):
        for y, features in rows:
            b = -zb / ((spec.beta + math.sqrt(nb)) / spec.alpha)
            w = {i: weight(i) for i in features}
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i in features:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / spec.alpha * w[i]
                n[i] = old + g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / spec.alpha * b, nb + g * g
    return {i: weight(i) for i in z if weight(i)}, b


def sample(n, seed):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choices(WORDS[: 20 + 28 * (i % 2)], k=rnd.choice([0, 1, 3, 30, 80])))) for i in range(n)]
    return rows + [(n, None), (n + 1, " \t\n"), (n + 2, "long " * 30_000), (n + 2, "long " * 30_000), (None, "ab Cd")]


@pytest.mark.parametrize("spec", [quality_classifier.SPEC, toxicity.SPEC])
def test_features_equal_the_plain_ones_in_any_batch(spec):
    texts = [t or "" for _, t in sample(120, 2)]
    for size in (1, 7, 500):
        got = []
        for at in range(0, len(texts), size):
            d, f = ftrl.Extractor(spec)(texts[at : at + size])
            got += [set(f[d == i].tolist()) for i in range(len(texts[at : at + size]))]
        assert got == [plain_features(t, spec) for t in texts]


@pytest.mark.parametrize("module,label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_scores_equal_the_plain_ones_in_any_partitioning(spark, module, label):
    docs = sample(150, 3)
    marks = [(i, i % 2) for i, _ in docs[:150]] + [(3, 0), (3, 1), (4, None), (None, 1), (9_999, 1)]
    frame = spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs], "doc_id long, text string, score double, at string")
    labels = spark.createDataFrame(marks, f"doc_id long, {label} int")
    order = {r[0]: r[1] for r in frame.where("doc_id is not null").selectExpr("doc_id", "xxhash64(doc_id)").distinct().collect()}
    y = {i: max(m for j, m in marks if j == i and m is not None) for i in {j for j, m in marks if m is not None and j is not None}}
    rows = sorted((order[i], y[i], sorted(plain_features(t or "", module.SPEC))) for i, t in docs if i in y and py_crc_mod(i, 5))
    weights, bias = plain_fit([r[1:] for r in rows], module.SPEC)
    fitted = module.train(frame, labels)
    assert dict(zip(fitted.weights[0].tolist(), fitted.weights[1].tolist(), strict=True)) == pytest.approx(weights, rel=1e-9)
    want = sorted((i is None, i or 0, round(1 / (1 + math.exp(-(sum(weights.get(f, 0.0) for f in plain_features(t or "", module.SPEC)) + bias))), 5)) for i, t in docs)
    seen = set()
    for parts in (1, 13):
        got = module.score(frame.repartition(parts), fitted).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 5)) for r in got) == [pytest.approx(w, abs=2e-5) for w in want]
        assert all(r.held_out == (r.doc_id is not None and py_crc_mod(r.doc_id, 5) == 0) for r in got)
        seen.add(tuple(sorted((str(r.doc_id), r.score, r.predicted) for r in got)))
    assert len(seen) == 1
    texts = [t or "" for _, t in docs]
    scorer = ftrl.Scorer(fitted)
    whole = scorer(texts)
    assert all(scorer([t])[0] == s for t, s in zip(texts, whole))
    assert module.score(frame.limit(0), fitted).count() == 0


def test_without_labels_and_a_bounded_fit(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    fitted = quality_classifier.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_classifier.score(docs, fitted).first().score == 0.5
    rows = [(1.0, np.arange(5)), (0.0, np.arange(50)), (1.0, np.arange(3))]
    assert [len(i) for _, i in ftrl._bounded(iter(rows), 8)] == [5, 3]
