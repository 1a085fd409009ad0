import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, top):
    f, n = {}, Counter()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, all_ in f.items():
        kept = []
        for p, a in all_.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and all_[q] >= least and 100 * all_[q] >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in all_):
                continue
            s, k = min((1000000 * a * a // (all_[p[:k]] * all_[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), all_[p[:k]], all_[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made(seed):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "tide", "mill", "Øre", "ßx", "漢字", "a b", "x\x0by", "mill,stone", "no.", "…"] + [f"w{i}" for i in range(30)]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", ";"]) for _ in range(rnd.choice([0, 1, 30, 200]))), rnd.choice(["en", "en", "de", None, "und", ""])) for i in range(60)]
    rows += [(None, None, "en"), (1, "", None), (2, " \t\n.!", "zz"), (3, "same same same same same same same", "yy")]
    return rows + [(7, "tide mill of the Øre", "en")] * 9


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("n", F.lit("x")).withColumn("chunk", F.lit(1)).withColumn("word", F.lit("y"))
    return sorted(map(tuple, phrases.collocations(docs, **how).collect()))


@pytest.mark.parametrize(("least", "top", "chunk"), [(10, 2000, 2_000_000), (3, 40, 50), (2, 7, 300)])
def test_equals_brute_force(spark, monkeypatch, least, top, chunk):
    rows = made(least)
    assert run(spark, rows, least=least, top=top, chunk_words=chunk) == brute(rows, least, top)


def test_no_words(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, None), (2, "!", "en")]) == []


def test_long_texts_are_cut_without_losing_words_or_neighbours(monkeypatch):
    rnd = random.Random(1)
    text = "".join(rnd.choice(["abc", "d", "x" * 40]) + rnd.choice([" ", " ", ". ", "\n"]) for _ in range(400)) + "y" * 300 + " end"
    whole = [w for words, _ in phrases._words(text.encode()) for w in words]
    monkeypatch.setattr(phrases, "_STEP", 64)
    parts = list(phrases._words(text.encode()))
    assert len(parts) > 20 and all(words[-1] == b"\xff" for words, gap in parts if gap)
    pieces = lambda words: [p.split() for p in b" ".join(words).split(b"\xff") if p.strip()]
    assert pieces([w for words, _ in parts for w in words]) == pieces(whole)


def test_merged_lists_are_the_occurrences():
    rnd = np.random.default_rng(3)
    seq = rnd.integers(0, 4, 300)
    at = np.flatnonzero(seq > 0)  # 0 is a gap
    word = seq[at]
    key, n, ends = phrases.merged(at, word, at, word, 4)
    want = Counter((int(a), int(b)) for a, b in zip(seq, seq[1:]) if a and b)
    assert {(k // 4, k % 4): c for k, c in zip(key.tolist(), n.tolist())} == want
    for k, e in zip(key.tolist(), np.split(ends, np.cumsum(n)[:-1])):
        assert all((seq[x - 1], seq[x]) == (k // 4, k % 4) for x in e.tolist())
    assert [len(x) for x in phrases.merged(at[:0], word[:0], at, word, 4)] == [0, 0, 0]


def test_scores_are_exact(spark):
    rnd = random.Random(4)
    rows = [(a, a + rnd.randint(0, 9), a * rnd.randint(1, 9)) for a in (10, 10**9 + 7, 10**14 - 3, *(rnd.randint(10, 10**15 - 1) for _ in range(200)))]
    rows += [(a, a, a) for a in (10, 999_999_999_999_999)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score("a", "l", "r").alias("s")).collect()
    assert all(r["s"] == 1000000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got)
