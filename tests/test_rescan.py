"""The index after a rescan against a full rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import linkage, rescan
from tests.test_linkage import SCHEMA, item


def shelf(rnd, n, at=0):
    pick = lambda *c: rnd.choice(c)
    creators = [[("Ode", "A", 0)], [("Rae", "B", 0)], [("Ode", "A", 0), ("Rae", "B", 0)], []]
    return {k: item(k, title=pick("Tide mills", "Tide mills of the coast", "Salt pans", "Salt pans and mills"), date=pick(None, "1990", "1991", "1993"), doi=pick(None, None, None, "10.5555/a", "10.5555/b"), creators=pick(*creators), item_type=pick("journalArticle", "journalArticle", "document", "book"), linked_items=pick([], [], [], [(pick(1, 2), f"K{rnd.randrange(n)}")])) for k in range(at, at + n)}


def edited(rnd, rows):
    """Some records removed, others changed, others new, before and behind those that are there."""
    rows = dict(rows)
    for k in rnd.sample(sorted(rows), 3):
        del rows[k]
    fresh = shelf(rnd, 60, min(rows) - 3)
    for k in [*rnd.sample(sorted(rows), 3), min(rows) - 1, max(rows) + 1]:
        rows[k] = fresh.get(k) or item(k, title="Salt pans", creators=[("Ode", "A", 0)])
    return rows


def frame(spark, rows):
    return linkage.normalize_items(spark.createDataFrame(list(rows.values()), SCHEMA))


def told(index):
    works = {r["ordinal"]: (r["work"], r["confidence"]) for r in index.works.collect()}
    edges = sorted((r["l_ordinal"], r["r_ordinal"], r["tier"], tuple(r["order_key"])) for r in index.edges.collect())
    return works, edges


@pytest.mark.parametrize(("seed", "exact"), [(1, False), (2, True)])
def test_equals_a_full_rebuild(spark, seed, exact):
    rnd = random.Random(seed)
    rows = shelf(rnd, 40, 10)
    index = rescan.build(frame(spark, rows), exact)
    for _ in range(1 if exact else 2):
        rows = edited(rnd, rows)
        index = rescan.rescan(index, frame(spark, rows), exact)
        works, edges = told(index)
        assert (works, edges) == told(rescan.build(frame(spark, rows), exact))
        assert len(edges) > 1 and len({w for w, _ in works.values()}) < len(works)


def test_nothing_changed_and_stale_libraries(spark):
    rows = shelf(random.Random(4), 12, 10)
    index = rescan.build(frame(spark, rows))
    same = rescan.rescan(index, frame(spark, rows))
    assert same.works is index.works and same.edges is index.edges
    other = {k: item(k, title="Bells") for k in rows}
    stale = spark.createDataFrame([(2,)], "library_id int")
    now = rescan.refreshed(index.items, frame(spark, other), stale)
    assert {(r["library_id"], r["title"] == "Bells") for r in now.select("library_id", "title").collect()} == {(1, False), (2, True)}
    assert {r["there"] for r in rescan.touched(index.items, now).collect()} == {True}
    gone = rescan.touched(index.items, index.items.where("library_id = 1"))
    assert gone.where("there").isEmpty() and gone.count() == len([k for k in rows if k % 2])
    assert rescan.rescan(index, index.items.where(F.lit(False))).works.isEmpty()
