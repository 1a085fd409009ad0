"""Quality classifier: hashed word n-gram logistic regression with FTRL updates (see ftrl)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import ftrl
from .common import keep_rows

#: Word unigrams and bigrams, and unigrams to trigrams of word shapes by their share of the text.
SPEC = ftrl.Spec(orders=(1, 2), shapes=(1, 2, 3), l1=2.0)


def train(docs: DataFrame, labels: DataFrame, spec: ftrl.Spec = SPEC) -> ftrl.Spec:
    """Fits the weights on labels.quality; see ftrl.train for nulls, several labels, repeated and long rows."""
    return ftrl.train(docs, labels, "quality", spec)


def score(docs: DataFrame, fitted: ftrl.Spec, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see ftrl.score for nulls, repeated and long rows and empty tables."""
    return ftrl.score(docs, fitted, threshold)


def kept_documents(docs: DataFrame, fitted: ftrl.Spec, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score predicts 1 for, all columns as they are."""
    cast = docs.sparkSession.sparkContext.broadcast(fitted)

    def make():
        scorer = ftrl.Scorer(cast.value)
        return lambda texts: scorer(texts) >= threshold

    return keep_rows(docs, make, text_col)
