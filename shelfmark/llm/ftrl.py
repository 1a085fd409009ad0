"""Logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are binary: hashed word n-grams, optionally skip-grams and word stems (first letters), optionally n-grams of word shapes by
their share of the text. Per-coordinate rates and an L1 penalty leave most of the 2^bits weights at
zero; what is left is collected as a sparse list, at most 2^bits long, and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_text, mix64, words_of
from .quality_rules import batches_by_size


@dataclass(frozen=True)
class Spec:
    """What the model sees and how it learns. max_rows bounds, in expectation, the labelled rows that it
    is fitted on: ids are taken by a hash of theirs, at a rate of max_rows over the labelled rows. Of
    these, in the order of the hash, those that go beyond max_features features in all are left out,
    which bounds the memory of the task that fits, 4 bytes a feature."""

    bits: int = 22
    orders: tuple[int, ...] = (1, 2)
    skips: tuple[int, ...] = ()
    stems: tuple[int, ...] = ()
    shapes: tuple[int, ...] = ()
    lower: bool = True
    max_rows: int = 20_000
    max_features: int = 1 << 26
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    weights: tuple[np.ndarray, np.ndarray] | None = field(default=None, compare=False)
    bias: float = 0.0


def shape_of(word: str) -> str:
    """Letters as a or A, digits as 0, other characters as they are; runs of letters or digits count once,
    of others at most twice. A word's shape is the first 8 of these symbols, of the whole word."""
    out: list[str] = []
    for c in word:
        if len(out) == 8:
            break
        k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if k in "Aa0" and out[-1:] == [k] or out[-2:] == [k, k]:
            continue
        out.append(k)
    return "".join(out)


class _Codes(dict):
    """Words numbered in the order that they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


#: Bits of a shape n-gram's hash; the bits above them name the text in its batch, at most 2^24 texts.
_SHAPE_BITS = np.uint64(40)


class Extractor:
    """Distinct (document, hashed feature) pairs of some texts, a function of each text alone. What depends on a word alone (its hash, those
    of its stems and its shape) is worked out once and looked up by the word's number; everything is
    forgotten at max_words."""

    def __init__(self, spec: Spec, max_words: int = 1 << 18):
        self.spec, self.max_words = spec, max_words
        self._forget()

    def _forget(self) -> None:
        self.codes, self.facts = _Codes(), np.zeros((2 + len(self.spec.stems), 0), np.uint64)

    def _look_up(self, words: list[str]) -> np.ndarray:
        """A row each of the words' hashes, shapes' hashes and stems' hashes."""
        from xxhash import xxh3_64_intdigest

        if len(self.codes) > self.max_words:
            self._forget()
        at = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        spec, known = self.spec, self.facts.shape[1]
        if len(self.codes) > known:
            fresh = list(islice(self.codes, known, None))
            low = [w.lower() for w in fresh] if spec.lower else fresh
            shapes = [b"shape " + shape_of(w).encode("utf-8", "surrogatepass") for w in fresh] if spec.shapes else []
            rows = [[w.encode("utf-8", "surrogatepass") for w in low], shapes, *([w[:k].encode("utf-8", "surrogatepass") for w in low] for k in spec.stems)]
            facts = np.zeros((len(rows), len(fresh)), np.uint64)
            for i, row in enumerate(rows):
                if row:
                    facts[i] = np.fromiter(map(xxh3_64_intdigest, row), np.uint64, len(row))
            self.facts = np.concatenate([self.facts, facts], axis=1)
        return self.facts[:, at]

    def __call__(self, texts: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted by document and feature; with weights, only features of a weight other than zero."""
        spec, shift = self.spec, np.uint64(64 - self.spec.bits)
        parts = [words_of(t) for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        h, shape, *stems = self._look_up([w for p in parts for w in p])
        doc = np.repeat(np.arange(len(texts)), n)
        pairs = []

        def add(d: np.ndarray, keys: np.ndarray) -> None:
            idx = (mix64(keys) >> shift).astype(np.int64)
            if weights is not None:
                keep = weights[idx] != 0
                d, idx = d[keep], idx[keep]
            pairs.append(d << spec.bits | idx)

        for k in spec.orders:
            d, key = self._grams(doc, h, k)
            add(d, key + np.uint64(k))
        for gap in spec.skips:
            same = doc[: len(doc) - gap - 1] == doc[gap + 1 :] if len(doc) > gap + 1 else np.zeros(0, bool)
            a, b = h[: len(same)][same], h[gap + 1 :][same]
            add(doc[: len(same)][same], mix64(a + np.uint64(gap * 7919)) * np.uint64(31) + b)
        for k, stem in zip(spec.stems, stems, strict=True):
            add(doc, stem + np.uint64(k * 104729))
        if spec.shapes and len(doc):
            stuck = np.zeros(len(h), bool)
            stuck[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            shape = np.where(stuck, np.uint64(0x3D3D), shape)
            for k in spec.shapes:
                # the document in the upper bits, so one sort brings its equal shape n-grams together
                d, key = self._grams(doc, shape, k)
                key = np.sort(d.astype(np.uint64) << _SHAPE_BITS | mix64(key) >> (np.uint64(64) - _SHAPE_BITS))
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                count, key = np.diff(np.append(new, len(key))), key[new]
                d = (key >> _SHAPE_BITS).astype(np.int64)
                # a shape n-gram's feature names its share of the text, halved step by step
                level = np.minimum(10, np.floor(-np.log2(count / np.maximum(1, n[d])))).astype(np.uint64)
                add(d, mix64(key & ((np.uint64(1) << _SHAPE_BITS) - np.uint64(1))) + level + np.uint64(k << 60))
        pair = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        return pair >> spec.bits, pair & ((1 << spec.bits) - 1)

    @staticmethod
    def _grams(doc: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(doc) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        key = h[:m].copy()
        for j in range(1, k):
            key = mix64(key) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
        same = doc[:m] == doc[k - 1 :]
        return doc[:m][same], key[same]


def _bounded(rows: Iterator[tuple[float, np.ndarray]], most: int) -> Iterator[tuple[float, np.ndarray]]:
    for y, i in rows:
        if len(i) <= most:
            most -= len(i)
            yield y, i


def fit_rows(rows: Iterator[tuple[float, np.ndarray]], spec: Spec) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (label, features): the features with a weight, their weights, the bias."""
    rows = list(_bounded(rows, spec.max_features))
    z, n = np.zeros(1 << spec.bits), np.zeros(1 << spec.bits)
    zb, nb, b = 0.0, 0.0, 0.0
    for _ in range(spec.epochs):
        for y, i in rows:
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= spec.l1, 0.0, (np.sign(zi) * spec.l1 - zi) / ((spec.beta + root) / spec.alpha + spec.l2))
            b = -zb / ((spec.beta + nb**0.5) / spec.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            z[i] = zi + g - (np.sqrt(ni + g * g) - root) / spec.alpha * w
            n[i] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / spec.alpha * b
            nb += g * g
    i = np.flatnonzero(np.abs(z) > spec.l1)
    return i, (np.sign(z[i]) * spec.l1 - z[i]) / ((spec.beta + np.sqrt(n[i])) / spec.alpha + spec.l2), b


def train(docs: DataFrame, labels: DataFrame, label_col: str, spec: Spec, held_out_mod: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Spec:
    """The spec with weights, fitted on a bounded sample of labelled documents, none of them held out
    (crc32 of the id modulo held_out_mod is 0). Null labels and ids without a document are ignored; an
    id with several labels takes the largest, a labelled id with several rows is learnt from each. Null
    texts are empty, texts of any length are read whole, other columns, whatever their names, are
    dropped. Without any labelled row all weights are zero.

    Features are taken where the rows lie; the sample's features, at most about max_rows rows, meet in
    one task, sorted by a hash of the id, so the result doesn't depend on the partitioning."""
    gold = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).where(crc_mod(F.col("doc_id"), held_out_mod) != 0)
    n, blank = gold.count(), replace(spec, weights=(np.zeros(0, np.int64), np.zeros(0)), bias=0.0)
    if not n:
        return blank
    rate = min(1.0, spec.max_rows / n)
    order = F.xxhash64("doc_id")
    gold = gold.where(F.pmod(order, F.lit(1 << 20)) < int(rate * (1 << 20)) if rate < 1 else F.lit(True))
    rows = id_text(docs, id_col, text_col).join(F.broadcast(gold), "doc_id").select(order.alias("at"), "y", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = Extractor(spec)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                d, f = take(part.column(2).to_pylist())
                at = np.searchsorted(d, np.arange(part.num_rows + 1))
                packed = [f[x:y].astype("<i4").tobytes() for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["at", "y", "f"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = ((y, np.frombuffer(f, "<i4")) for b in batches for y, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        i, w, bias = fit_rows(got, spec)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(w, bias))], ["i", "w"])

    fitted = rows.mapInArrow(features, "at long, y double, f binary").repartition(1).sortWithinPartitions("at", "y", "f").mapInArrow(fit, "i long, w double").toArrow()
    if not fitted.num_rows:  # labels without documents
        return blank
    i, w = fitted.column("i").to_numpy(), fitted.column("w").to_numpy()
    at = np.flatnonzero(i == -1)[0]
    keep = i >= 0
    order_ = np.argsort(i[keep])
    return replace(spec, weights=(i[keep][order_], w[keep][order_]), bias=float(w[at]))


class Scorer:
    def __init__(self, spec: Spec):
        self.take, self.bias = Extractor(spec), spec.bias
        self.dense = np.zeros(1 << spec.bits, np.float32)
        self.dense[spec.weights[0]] = spec.weights[1]

    def __call__(self, texts: list[str]) -> np.ndarray:
        d, f = self.take(texts, self.dense)
        total = np.bincount(d, weights=self.dense[f].astype(np.float64), minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, fitted: Spec, threshold: float, held_out_mod: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold on), one row per row.

    The score depends on the text alone; null and empty texts get the bias's score. A null doc_id is
    never held out. Repeated rows give repeated results, texts of any length are read whole. Other
    columns, whatever their names, are dropped; an empty table gives no rows."""
    cast = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(cast.value)
        for b in batches:
            for ids, texts in batches_by_size(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scorer(texts))], ["doc_id", "score"])

    got = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), held_out_mod) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


__all__ = ["Extractor", "Scorer", "Spec", "fit_rows", "score", "shape_of", "train"]
