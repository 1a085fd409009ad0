"""Pairs found by their titles too, against all candidate pairs judged one by one."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import changes, clustering, linkage
from tests.test_linkage import SCHEMA, item

TITLES = ["", "The", "Tide mills", "Mills tide", "Tide mills of Kent", "Tide mills of Kent, second edition", "Tide milks", "Tide mill", "Salt pans", "Salt", "Salt salt pans", "Mills", None]


@pytest.fixture(scope="module")
def shelf(spark):
    rnd = random.Random(5)
    pick = lambda *c: rnd.choice(c)
    rows = [
        item(n, item_type=pick("journalArticle", "preprint", "document", "book", "book", "thesis", "map", None), title=pick(*TITLES), date=pick(None, "1990", "1991", "1993"), doi=pick(*[None] * 6, "10.5555/a", "10.5555/b"),
             isbn=pick(None, None, None, "3-16-148410-X", "0-19-852663-6"), extra=pick(*[None] * 4, "PMID: 1", "PMID: 2", "arXiv: 2101.7"), creators=pick([], [("Ode", "A", 0)], [("Ode", "A", 0), ("Rae", "B", 0)]), linked_items=pick(*[[]] * 8, [(2, "K1")], [(1, "K4"), (2, "K9")]))
        for n in range(240)
    ]
    items = linkage.normalize_items(spark.createDataFrame(rows, SCHEMA)).cache()
    return items, linkage.match_pairs(linkage.with_items(linkage.candidate_pairs(items), items)).cache()


def rows(df, *cols):
    return sorted(map(tuple, df.select("l_ordinal", "r_ordinal", *cols).collect()))


@pytest.mark.parametrize("block", [3, 4096])
def test_no_wanted_pair_is_lost(shelf, block):
    items, every = shelf
    for want in (linkage.MATCH, linkage.COPY):
        met = linkage.candidate_pairs(items, block=block, want=want)
        got = rows(linkage.match_pairs(linkage.with_items(met, items)).where(F.col("verdict").isin(*want)), "verdict", "tier", "evidence")
        assert got == rows(every.where(F.col("verdict").isin(*want)), "verdict", "tier", "evidence")
    assert {r[0] for r in every.select("tier").collect()} == {"exact", "high", "review", "none"}


def test_confirmed_pairs_meet_few_others(shelf):
    items, every = shelf
    high = lambda df: rows(df.where("tier = 'high'"), "order_key")
    assert high(linkage.confirmed_pairs(items)) == high(every)
    assert linkage.candidate_pairs(items, want=linkage.MATCH).count() < 1.5 * every.where("verdict = 'match'").count() < every.count() / 4


def test_links_alone_tell_stale_ones(shelf):
    items, every = shelf
    assert rows(linkage.linked_pairs(items), "verdict", "evidence", "title_rel") == rows(every.where("linked"), "verdict", "evidence", "title_rel")
    assert rows(changes.stale_links(linkage.linked_pairs(items), items, 1), "reason") == rows(changes.stale_links(every, items, 1), "reason")


def test_exact_edges_have_the_components_of_all_exact_matches(spark, shelf):
    items, every = shelf
    works = lambda df: sorted(map(tuple, df.select("ordinal", "work").collect()))
    assert works(clustering.works_by_identifiers(items)) == works(clustering.works_exact(items, every))
    many = linkage.normalize_items(spark.createDataFrame([item(n, doi="10.5555/a", title=TITLES[2 + n % 3]) for n in range(300)], SCHEMA)).cache()
    assert linkage.exact_edges(many).count() <= 400


def test_searched_copies(shelf):
    items, every = shelf
    both = every.where(F.col("verdict").isin(*linkage.COPY))
    want = sorted((a, b, v) for x, y, v in rows(both, "verdict") for a, b in ((x, y), (y, x)) if a % 9 == 0)
    sources = items.where("ordinal % 9 = 0")
    assert rows(linkage.find_copies(sources, items), "verdict") == want
    full = linkage.search_pairs(sources, linkage.block_keys(items)).count()
    assert linkage.search_pairs(sources, linkage.block_keys(items, *linkage.pair_facts()), want=linkage.COPY).count() < full
