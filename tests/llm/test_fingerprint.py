import base64
import random
from collections import Counter
from hashlib import sha256
from math import log2

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import fingerprint as fp
from shelfmark.llm.common import mix64

import numpy as np

SCHEMA = "doc_id long, text string"


def plain_features(raw):
    """Windows picked one by one, their entropy counted anew each time."""
    if not raw:
        return []
    raw = raw.ljust(32, b"\xff")
    windows = [raw[i : i + 32] for i in range(len(raw) - 31)]
    rank = []
    for w in windows:
        e = 32 * 5 * 1024 - sum(round(c * log2(c) * 1024) for c in Counter(w).values())
        rank.append(0xFFFF if e < 32 * 1024 else 0xFFFE - abs(e - round(3.5 * 32 * 1024)) // 64)
    run, need = (4, 2) if len(windows) < 256 else (32, 8)
    run, votes = min(run, len(windows)), Counter()
    for s in range(len(windows) - run + 1):
        votes[min(range(s, s + run), key=lambda i: (rank[i], i))] += 1
    need = min(need, max(votes.values()))
    return list(dict.fromkeys(windows[i] for i in sorted(votes) if votes[i] >= need))


def plain_fingerprint(text):
    out = b""
    found = plain_features(text.encode())
    for s in range(0, len(found), 128):
        bits = [0] * 2048
        for w in found[s : s + 128]:
            h = np.array([32], np.uint64)
            for k in range(4):
                h = mix64(h + np.frombuffer(w[8 * k : 8 * k + 8], "<u8")) * np.uint64(0x9E3779B97F4A7C15)
            h = int(mix64(h)[0])
            for k in range(5):
                bits[h >> 11 * k & 2047] = 1
        out += bytes([len(found[s : s + 128])]) + bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, 2048, 8))
    return base64.b64encode(out).decode()


def plain(rows, mark):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), mark[r[1]]))
    out = []
    for k, (i, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        n = len(text)
        edited = text[: n - n // 3] + other[: n // 3]
        a, b, c = map(plain_fingerprint, (text, edited, other))
        like = lambda x, y: fp.likeness(fp.Digest.read(x), fp.Digest.read(y))
        out.append((i, n, sha256(edited.encode()).hexdigest(), a, b, round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def made(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioubcdfgl") for _ in range(rnd.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rnd.choice([1, 5, 40, 300, 900]))) + rnd.choice(["", ".\n", "…ß漢字" * 9]) for _ in range(n)]
    return texts + ["", None, "x" * 3000, "漢" * 70, "a", "-" * 31, "=" * 32, texts[3], texts[3] + " and more", "\x00퟿"]


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t) for i, t in rows], SCHEMA).repartition(3).withColumn("mark", F.lit("x")).withColumn("range", F.lit(1)).withColumn("n_chars", F.lit("y"))
    got = fp.fingerprint(docs, **how)
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got.collect()), key=str)


def marks(spark, rows):
    return {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_plain_version(spark, parts):
    rnd = random.Random(parts)
    texts = made(parts)
    rows = [(rnd.choice([None, None, rnd.randint(-5, 40), rnd.randint(0, 1 << 62)]), t) for t in texts]
    rows += rows[:6] + [(9, texts[k % 3]) for k in range(40)]  # repeated rows, one id at many
    want = plain(rows, marks(spark, rows))
    assert run(spark, rows, parts=parts) == want
    assert run(spark, rows, parts=parts, hot=3) == want  # rows that stand there often are read once


def test_segments_give_the_same_features(monkeypatch):
    rnd = random.Random(5)
    raw = "".join(rnd.choice("aaabcdefghij  .") for _ in range(5000)).encode()
    want = plain_features(raw)
    whole = fp.features([raw])[0]
    monkeypatch.setattr(fp, "SEGMENT", 700)
    monkeypatch.setattr(fp, "_BLOCK", 90)
    assert np.array_equal(fp.features([raw])[0], whole) and len(whole) == len(want)
    assert [x.tolist() for x in fp.features([raw, b"", raw[:50], raw[:300]])[1:]] == [[], fp.features([raw[:50]])[0].tolist(), fp.features([raw[:300]])[0].tolist()]


def test_likeness_tells_edited_texts_from_others(spark):
    rnd = random.Random(2)
    texts = [t for t in made(11, 80) if t and len(t) > 200 and len(set(t)) > 5]
    digests = fp.Digest.of(texts)
    for k, (t, d) in enumerate(zip(texts, digests)):
        assert fp.likeness(d, d) == 1.0 and fp.Digest.read(d.text()).text() == d.text()
        other = digests[k - 1]
        cut = len(t) // 4
        moved = fp.Digest.of([texts[k - 1][:37] + t[: len(t) - cut]])[0]  # put in front, cut behind
        assert 0.4 < fp.likeness(d, moved) <= 1
        if texts[k - 1] not in t and t not in texts[k - 1]:
            assert fp.likeness(d, other) < 0.1 and fp.likeness(d, other) == fp.likeness(other, d)
    empty = fp.Digest.of([""])[0]
    assert fp.likeness(empty, empty) == 1.0 and fp.likeness(empty, digests[0]) == 0.0
    many = fp.Digest.of([" ".join(str(rnd.random()) for _ in range(60_000))])[0]  # about a megabyte
    assert len(many.counts) > 100 and fp.likeness(many, many) == 1.0


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert [r[-2:] for r in run(spark, [(4, "one text that is followed by itself, of fifty signs")])] and run(spark, [(4, None)])[0][:4] == (4, 0, sha256(b"").hexdigest(), "")
