import math
import random
import re
from collections import Counter, defaultdict

import pytest

from shelfmark.llm import lm_scoring
from shelfmark.llm.common import py_crc_mod

ORDER = lm_scoring.ORDER


def brute(docs):
    """Unigram base and PPM-C with exclusion, symbol by symbol."""
    train = [(i, t) for i, t in docs if i is None or py_crc_mod(i, 7) != 2]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    count = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    trie = defaultdict(Counter)
    symbols = lambda t: [*([254] * ORDER), *low(t).encode(), 255]
    for _, t in train:
        b = symbols(t)
        for i in range(ORDER, len(b)):
            for k in range(ORDER + 1):
                trie[tuple(b[i - k : i])][b[i]] += 1

    def lp(context, symbol):
        total, refused = 0.0, set()
        for k in range(ORDER, -1, -1):
            have = {s: c for s, c in trie.get(tuple(context[ORDER - k :]), {}).items()}
            left = {s: c for s, c in have.items() if s not in refused}
            if symbol in have:
                return total + math.log10(have[symbol] / (sum(left.values()) + len(left)))
            if left:
                total += math.log10(len(left) / (sum(left.values()) + len(left)))
            refused |= set(have)
        return total - math.log10(256 - len(refused))

    out = {}
    for i, t in docs:
        b = symbols(t)
        ws = tokens(t)
        out[i] = (len(ws), sum(w in count for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), sum(lp(b[j - ORDER : j], b[j]) for j in range(ORDER, len(b))))
    return out


@pytest.mark.parametrize("hot", [0, 64, 1 << 19])
def test_scores_equal_brute_force(spark, hot):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdéßQ") for _ in range(rnd.randint(1, 4)))
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 25)))) for i in range(60)] + [(100, ""), (101, "zzz\x0b yyy\n\n 漢字"), (102, "\t")]
    got = lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), hot=hot).collect()
    want = brute(docs)
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (py_crc_mod(r["doc_id"], 7) == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][3], rel=1e-9)
        assert r["score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, score double, row string"
    docs = spark.createDataFrame([(1, None, 0.5, "x"), (1, None, 0.5, "x"), (None, "a b", None, None)], schema)
    got = sorted(lm_scoring.score(docs).collect(), key=lambda r: r["n_tokens"])
    assert [r["n_tokens"] for r in got] == [1, 1, 3] and got[0] == got[1]
    assert lm_scoring.score(spark.createDataFrame([], schema)).count() == 0


def test_very_long_text(spark):
    rnd = random.Random(6)
    long = " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 5))) for _ in range(60_000)) + "x" * 40_000
    docs = [(1, long), (2, long[:500]), (9, long)]
    got = {r["doc_id"]: r for r in lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs)
    for i, (n, known, total, base, score) in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, total)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["score"] == pytest.approx(score, rel=1e-9)
