"""The corpus pipeline: documents that the quality rules and the quality classifier keep, one of each
group of near duplicates, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import ngram_join, packing, quality_classifier, quality_rules
from shelfmark.llm.common import stored, table
from shelfmark.llm.queries import vocabulary


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them. Rows are judged one by one,
    so repeated rows, null ids and other columns stay as they are."""
    return quality_rules.kept_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is trained on the table's labelled documents, as the
    stage before has taken away most of what it has to learn to reject. Without labels every score is 0.5
    and all documents stay; null ids and other columns stay as they are."""
    fitted = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.kept_documents(docs, fitted)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the least id, null ids last; see
    ngram_join.one_of_each_class for ties, repeated rows and ids that stand at several texts."""
    return ngram_join.one_of_each_class(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 4096 tokens; see packing.pack. Every
    document that is left has at least one piece."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", deduplicate), ("packing", pack)]

#: Trained decisions and tokenisation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each stored and read again as the next one's input. An empty
    table, or one of which nothing is left, gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
