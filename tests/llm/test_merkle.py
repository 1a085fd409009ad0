import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def tree(nodes, fanout):
    """The root, and each node's path: its run's others before and after it on each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, j in enumerate(at):
            run = j // fanout * fanout
            paths[i].append((nodes[run:j], nodes[j + 1 : run + fanout]))
            at[i] = j // fanout
        nodes = [h(*nodes[s : s + fanout]) for s in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout):
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    built = [tree([leaf(r) for r in g], fanout) for g in groups]
    root, above = tree([b[0] for b in built], fanout)
    out = []
    for g, (subroot, paths), tail in zip(groups, built, above, strict=True):
        for r, path in zip(g, paths, strict=True):
            shown = leaf([r[0], low(r[1]), *r[2:]]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            node = shown
            for left, right in path + tail:
                node = h(*left, node, *right)
            out.append((r[0], leaf(r), subroot, root, h(*(x for left, right in path + tail for x in (*left, *right))), node, node == root))
    return sorted(out, key=str)


def run(spark, rows, fanout, height, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("digest", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("pos", F.lit("y"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = merkle.document_leaves(docs, lower, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return merkle.prove(leaves, fanout, height, True)


@pytest.mark.parametrize(("fanout", "height"), [(16, 3), (2, 1), (3, 2)])
def test_equals_plain_trees(spark, fanout, height):
    rnd = random.Random(fanout)
    rows = []
    for i in range(150):
        source = rnd.choice(["hot", "hot", "hot", "b", "é", "Z", None, "", f"own{i}"])
        rows.append((None if rnd.random() < 0.1 else rnd.randint(0, 90), rnd.choice([None, "", "Ein TEXT ÄÖ", f"Page {i}\n", "x" * 20_000]), rnd.choice([None, "en"]), source, rnd.choice([None, i])))
    rows += rows[:20]  # repeated rows are leaves of their own
    got = run(spark, rows, fanout, height).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == brute(rows, fanout)
    for r in got:  # the lists say what the digest was made from
        assert h(*(x for level in r["siblings"] for x in level)) == r["proof_sha256"]
        assert all(len(level) < fanout for level in r["siblings"])
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_small_and_empty_tables(spark):
    one = run(spark, [(5, "A", None, None, None)], 16, 3).collect()
    assert [tuple(r)[:7] for r in one] == brute([(5, "A", None, None, None)], 16)
    assert one[0]["subroot"] == one[0]["root"] == one[0]["leaf"] and one[0]["siblings"] == []
    assert run(spark, [], 16, 3).count() == 0
    same = [(1, "Same", "en", "s", 4)] * 40
    assert sorted((tuple(r)[:7] for r in run(spark, same, 3, 1).collect()), key=str) == brute(same, 3)


def test_a_leaf_of_another_place_or_a_changed_sibling_is_found_out():
    leaves = [h(str(i)) for i in range(7)]
    root, paths = tree(leaves, 3)
    for i, path in enumerate(paths):
        sib = "".join(x for left, right in path for x in (*left, *right)).encode()
        before, among = [len(left) for left, _ in path], [len(left) + len(right) for left, right in path]
        assert merkle.folded(leaves[i], sib, before, among) == root
        assert merkle.folded(leaves[(i + 1) % 7], sib, before, among) != root
        if sib:
            assert merkle.folded(leaves[i], bytes([sib[0] ^ 1]) + sib[1:], before, among) != root
