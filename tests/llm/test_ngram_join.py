import random
import re
from itertools import combinations

import numpy as np
import pytest

from shelfmark.llm import ngram_join


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs, t=0.8):
    sets = {}
    for i, text in docs:
        sets.setdefault(shingle_set(text), []).append(i)
    keys = list(sets)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = dict.fromkeys(keys, 0)
    for a, b in combinations(keys, 2):
        if a and b and len(a & b) >= t * len(a | b) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), 1 << 60), min(sets[k]))
    return sorted((i, least[find(k)], min(sets[k]), len(sets[k]), links[k]) for k in keys for i in sets[k])


def sample(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 400))
    docs = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([3, 20, 60, 150]))]
        docs.append(" ".join(base))
        for _ in range(rnd.choice([0, 1, 2, 12])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = word()
            docs.append("  ".join(copy))
    docs += ["", "\n\t", "one two", "one two", "One two"]
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [4, 2048])
def test_equals_brute_force(spark, block):
    docs = sample(block)
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block=block)
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, node string, sig string"
    rows = [(5, None, "x", "y"), (5, None, "x", "y"), (None, "a b c d e f g", None, None), (7, "a b c d e f g", None, None)]
    got = sorted(map(tuple, ngram_join.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(5, 5, 5, 2, 0), (5, 5, 5, 2, 0), (None, 7, 7, 2, 0), (7, 7, 7, 2, 0)], key=str)
    assert ngram_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_pruning_bound_is_monotone():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert least == sorted(least) and 0 < least[-1] < 0.8 * ngram_join.SIZE


def least_of_component(edges, n):
    parent = list(range(n))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(k) for k in range(n)]


def test_forest_equals_union_find():
    rnd = random.Random(5)
    cases = [([(1, 2), (2, 3), (3, 0)], 4), ([], 3)]
    for _ in range(200):
        n = rnd.randint(2, 60)
        path = rnd.sample(range(n), n)
        cases.append((list(zip(path, path[1:])), n))
        cases.append(([(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(1, n))], n))
    for edges, n in cases:
        i, j = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        assert ngram_join._forest(i, j, n).tolist() == least_of_component(edges, n)


def test_chain_of_versions(spark):
    """Each version is linked to its neighbours only, and all are one class."""
    words = [f"w{i}" for i in range(600)]
    docs = [(i, " ".join(words[8 * i : 8 * i + 104])) for i in range(50)]
    want = brute(docs)
    assert {r[4] for r in want} == {1, 2} and {r[1] for r in want} == {0}
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == want


def test_rows_without_an_id_or_of_one_id_are_read_once(spark, monkeypatch):
    """Texts of the groups' nodes are met by their hash: as many rows as nodes, whatever the ids."""
    docs = [(None if i % 3 else 7, text) for i, (_, text) in enumerate(sample(9))] * 2
    read, real = [], ngram_join._with_shingles

    def counted(rows):
        read.append((rows.count(), rows.select("node").distinct().count()))
        return real(rows)

    monkeypatch.setattr(ngram_join, "_with_shingles", counted)
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    named = brute([(k, t) for k, (_, t) in enumerate(docs)])
    ids = dict(enumerate(i for i, _ in docs))
    assert sorted((r["doc_id"] or 0, r["n_copies"], r["n_links"]) for r in got.collect()) == sorted((ids[k] or 0, n, links) for k, _, _, n, links in named)
    (rows, nodes), = read
    assert nodes > 30 and rows <= 3 * nodes  # each row stands there twice, some three times or more
