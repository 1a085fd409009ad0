"""The registered queries over items with persons and several creators, from `documents`, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .functions import text as t
from .operators import clustering, linkage
from .plans.storage import stored
from .sources.items import DOCUMENT_ITEMS, document_items


def _items(spark: SparkSession, d: str) -> DataFrame:
    return stored(catalog._normalized(document_items(spark, d)), "document-items")


def document_creators(spark: SparkSession, d: str) -> DataFrame:
    return linkage.normalize_items(document_items(spark, d)).select("ordinal", "normalized_title", F.array_join("creator_keys", ";").alias("creator_keys"))


def document_pairs(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return linkage.judged_pairs(items, items, ordered=True).drop("rules_verdict")


def document_works(spark: SparkSession, d: str) -> DataFrame:
    """Works of exact edges: their size and canonical member."""
    items = _items(spark, d)
    return clustering.roll_up(items, catalog._exact(items)).select("work", F.size("members").cast("long").alias("n"), "canonical")


QUERIES = {f.__name__: f for f in (document_creators, document_pairs, document_works)}

_PERSON = lambda n: f"CASE WHEN last{n} IS NULL OR {catalog._norm(f'last{n}')} = '' THEN NULL ELSE {catalog._norm(f'last{n}')} || ':' || substr({catalog._norm(f'first{n}')}, 1, 1) END"
_NO_BRACKETS = r"regexp_replace(body, '\([^)]*\)', ' ', 'g')"
_BODY = rf"CASE WHEN body IS NULL THEN NULL ELSE 'corporate:' || trim(regexp_replace(regexp_replace({catalog._norm(_NO_BRACKETS)}, '\b({'|'.join(t.CORPORATE_NOISE)})\b', ' ', 'g'), '\s+', ' ', 'g')) END"
_NORM = (
    catalog._NORM.replace(catalog.PART_ITEMS, DOCUMENT_ITEMS)
    .replace(f"CASE WHEN creator IS NULL THEN [] ELSE ['corporate:' || {catalog._norm('creator')}] END AS ck", f"list_sort([x FOR x IN [{_PERSON(1)}, {_PERSON(2)}, {_BODY}] IF x IS NOT NULL]) AS ck")
    .replace("':K' || linked", "':D' || linked")
)
_sql = lambda text: text.replace(catalog._NORM, _NORM)

ORACLE_SQL = {
    "document_creators": f"WITH {_NORM} SELECT ordinal, nt AS normalized_title, array_to_string(ck, ';') AS creator_keys FROM n",
    "document_pairs": f"WITH {_sql(catalog._MATCH)} SELECT l_ordinal, r_ordinal, verdict, tier, rules, title_rel, type_rel FROM m",
    "document_works": f"WITH RECURSIVE {_sql(catalog._WORKS)} SELECT work, count(*) AS n, min_by(ref, {catalog._RANK}) AS canonical FROM works JOIN n USING (ordinal) GROUP BY work",
}
