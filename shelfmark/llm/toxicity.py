"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (see ftrl)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import ftrl

#: Word unigrams, bigrams, skip-grams over one and two words, and stems, which reach inflections unseen in training.
SPEC = ftrl.Spec(orders=(1, 2), skips=(1, 2), stems=(4, 5), l1=1.0, alpha=0.5)


def train(docs: DataFrame, labels: DataFrame, spec: ftrl.Spec = SPEC) -> ftrl.Spec:
    """Fits the weights on labels.toxic; see ftrl.train for nulls, several labels, repeated and long rows."""
    return ftrl.train(docs, labels, "toxic", spec)


def score(docs: DataFrame, fitted: ftrl.Spec, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see ftrl.score for nulls, repeated and long rows and empty tables."""
    return ftrl.score(docs, fitted, threshold)
