"""The corpus pipeline against a plain version of its stages."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm import ftrl, quality_classifier, quality_rules
from shelfmark.llm.common import words_of
from shelfmark.llm.queries import vocabulary

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, with copies of some documents under new ids and rows of empty and null texts."""
    out = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet")
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(40).collect()]
    rows = [(900_000 + i, t) for i, t in enumerate(texts)] + [(910_000, None), (910_001, "")]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    docs.unionByName(extra, allowMissingColumns=True).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{SOURCE}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def shingles(text: str) -> frozenset:
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def first_of_groups(docs: dict[int, str]) -> set[int]:
    """The least id of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets, parent, owners = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}, defaultdict(list)

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in owners[s])
        for j, n in shared.items():
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            owners[s].append(i)
    return {i for i in docs if root(i) == i}


def test_pipeline_equals_the_plain_stages(spark, folder):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    field = quality_rules.model()
    docs = {i: t for i, t in docs.items() if quality_rules.judge([t], field, 0.5)[-1][0]}
    tables = [spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels")]
    scorer = ftrl.Scorer(quality_classifier.train(*tables))
    docs = {i: t for i, t in docs.items() if scorer([t])[0] >= 0.3}
    kept = first_of_groups(docs)
    assert kept and len(kept) < len(docs)

    encoder = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    encoder.no_truncation()
    encoder.no_padding()
    length = {i: len(encoder.encode(docs[i], add_special_tokens=False).ids) + 1 for i in kept}
    pieces, sequences, total = defaultdict(list), defaultdict(list), {}
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id] = r.doc_tokens
    assert total == length
    for runs, ends in ((pieces, lambda i, end: end == length[i]), (sequences, lambda i, end: end <= 4096)):
        for i, run in runs.items():
            end = 0
            for at, n in sorted(run):
                assert at == end
                end += n
            assert ends(i, end)


def test_deduplicate_keeps_one_row_of_each_class(spark):
    """Null ids, and ids that stand at several texts."""
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "pqrs")
    near = one.rsplit(" ", 1)[0] + " other"
    rows = [
        (None, one), (None, near),  # a class without ids
        (None, two), (4, two), (9, two),
        (5, three), (5, four), (5, three),  # an id at the head of two classes
        (6, four), (None, "some short text"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.deduplicate(spark, docs, SOURCE)
    assert got.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in got.collect())
    assert got - Counter([(None, one), (None, near)]) == Counter([(4, two), (5, three), (5, four), (None, "some short text")])
    assert got[None, one] + got[None, near] == 1


def test_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, columns of the operators' own names; empty tables."""
    def prose(seed: int, sentences: int = 8) -> str:
        rnd = random.Random(seed)
        word = lambda: "".join(rnd.choice("bdfglmnrst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4)))
        return " ".join(" ".join(word() for _ in range(rnd.randint(5, 14))).capitalize() + "." for _ in range(sentences))

    one, long = prose(1), prose(2, 4000)
    rows = [(1, one), (1, one), (None, prose(3)), (3, None), (4, ""), (5, long)]
    docs = spark.createDataFrame([(i, t, "a", "b", 0.5, 7) for i, t in rows], "doc_id long, text string, _id string, node string, score double, key int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for name, frame in (("full", docs), ("empty", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"{tmp_path}/full")
        assert kept.columns == docs.columns
    kept = sorted(map(tuple, kept.collect()), key=str)
    assert kept == sorted(((i, t, "a", "b", 0.5, 7) for i, t in [(1, one), (None, prose(3)), (5, long)]), key=str)
    packed = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert {r["doc_id"] for r in packed} == {1, None, 5}
