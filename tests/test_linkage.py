"""Fixture pairs: each asserts the verdict and the rules that made it."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import clustering, linkage

SCHEMA = "ordinal long, library_id int, library_name string, item_key string, version long, item_type string, title string, date string, doi string, isbn string, extra string, creators array<struct<last_name:string,first_name:string,field_mode:int>>, linked_items array<struct<library_id:int,item_key:string>>"
OKONKWO = [("Okonkwo", "Ifeoma", None)]


def item(n, **k):
    base = {"item_type": "journalArticle", "title": "Glaze chemistry of river valley kilns", "date": "2011", "doi": None, "isbn": None, "extra": None, "creators": OKONKWO, "linked_items": []} | k
    lib = n % 2 + 1
    return (n, lib, f"L{lib}", f"K{n}", 1, base["item_type"], base["title"], base["date"], base["doi"], base["isbn"], base["extra"], base["creators"], base["linked_items"])


CASES = [
    # identifiers
    ({"doi": "10.5555/Kiln.7B"}, {"doi": "http://dx.doi.org/10.5555/kiln.7b"}, "match", "exact", "Tier 1"),
    ({"item_type": "book", "isbn": "3-16-148410-X"}, {"item_type": "book", "isbn": "ISBN 978 3 16 148410 0"}, "match", "exact", "Tier 1"),
    ({"extra": "call number 7\r\n pmid : 551"}, {"extra": "PMID: 551"}, "match", "exact", "Tier 1"),
    ({"extra": "arXiv: arXiv:0912.4411"}, {"extra": "ARXIV:0912.4411"}, "match", "exact", "Tier 1"),
    ({"doi": "10.5555/p", "item_type": "preprint"}, {"doi": "doi:10.5555/P"}, "match", "exact", "Tier 1,§8.4"),
    ({"doi": "10.5555/p", "title": None}, {"doi": "10.5555/p"}, "match", "exact", "Tier 1"),
    ({"doi": "10.5555/p", "title": "Bells"}, {"doi": "10.5555/p", "title": "Looms of the north"}, "review", "review", "Tier 1,§8.1"),
    ({"doi": "10.5555/p"}, {"doi": "10.5555/q"}, "no-match", "none", "D1"),
    ({"isbn": "3-16-148410-X"}, {"isbn": "0-19-852663-6"}, "no-match", "none", "D2"),
    ({"extra": "PMID: 551"}, {"extra": "PMID: 552"}, "no-match", "none", "D3"),
    # years
    ({"date": "2011-03-00 March"}, {"date": "2012"}, "match", "high", "Tier 2,§7,§7"),
    ({"date": "2011"}, {"date": "2013"}, "no-match", "none", "D5"),
    ({"date": "0000"}, {"date": "1960"}, "match", "high", "Tier 2,§7,§7"),
    # titles
    ({"title": "Roof-tile stamps, 1400–1450"}, {"title": "Roof tile stamps 1400 1450"}, "match", "high", "Tier 2,§7,§7"),
    ({"title": "<b>K</b>ilns of the {Łódź} plain"}, {"title": "Kilns of the Łódz plain"}, "match", "high", "Tier 2,§7,§7"),
    ({"title": "Ash glazes"}, {"title": "Ash glazes: colour and flow"}, "match", "high", "Tier 2,§7,§7"),
    ({"title": "Ash"}, {"title": "Ash glazes"}, "no-match", "none", "D7"),
    ({"title": "Stamps on red brick"}, {"title": "Stamps on grey brick"}, "no-match", "none", "D7"),
    ({"title": "Shards"}, {"title": "A study of shards"}, "no-match", "none", "D7"),
    ({"title": "Celadon imports"}, {"title": "Celadon import"}, "review", "review", "Tier 3"),
    ({"title": "Potting today", "item_type": "book"}, {"title": "Potting today, 3rd edn", "item_type": "book"}, "review", "review", "§8.4"),
    # creators
    ({"creators": [("Lê", "Minh", 0), ("Rao", "P", 0)]}, {"creators": [("Rao", "Priya", 0), ("Le", "M.", 0)]}, "match", "high", "Tier 2,§7,§7"),
    ({"creators": [("Ångström", "Ö", 0)]}, {"creators": [("angstrom ", "O", 0)]}, "match", "high", "Tier 2,§7,§7"),
    ({"creators": [("The Guild of Potters (GP)", None, 1)]}, {"creators": [("Guild Potters", "", None)]}, "match", "high", "Tier 2,§7,§7"),
    ({"creators": [("dos Santos", "R", 0)]}, {"creators": [("Santos", "R", 0)]}, "no-match", "none", "Tier 4"),
    ({"creators": []}, {"creators": None}, "match", "high", "Tier 2,§7,§7"),
    ({"creators": []}, {}, "no-match", "none", "Tier 4"),
    # types
    ({"item_type": "conferencePaper"}, {}, "related", "none", "§8.4,§7"),
    ({"item_type": "conferencePaper", "title": "On something else"}, {}, "no-match", "none", "Tier 4"),
    ({"item_type": "map"}, {}, "no-match", "none", "D6"),
    ({"item_type": "document"}, {"item_type": "thesis"}, "match", "high", "Tier 2,§7,§7"),
    ({"item_type": "document"}, {}, "related", "none", "§8.4,§7"),
    # links
    ({"linked_items": "other"}, {}, "match", "exact", "Tier 0,Tier 2,§7,§7"),
    ({"linked_items": "other", "doi": "10.5555/p"}, {"doi": "10.5555/q"}, "review", "review", "Tier 0,D1,§8.0a"),
    ({"linked_items": "other", "title": "Kiln sites"}, {"title": "Wool trade"}, "review", "review", "Tier 0,D7,§8.0a"),
]


def test_ladder(spark):
    rows, pairs = [], []
    for i, (left, right, *_) in enumerate(CASES):
        l, r = 2 * i, 2 * i + 1
        if left.get("linked_items") == "other":
            left = left | {"linked_items": [(r % 2 + 1, f"K{r}")]}
        rows += [item(l, **left), item(r, **right)]
        pairs.append((l, r))
    items = linkage.normalize_items(spark.createDataFrame(rows, SCHEMA))
    got = linkage.match_pairs(linkage.with_items(spark.createDataFrame(pairs, "l_ordinal long, r_ordinal long"), items))
    got = {r["l_ordinal"] // 2: (r["verdict"], r["tier"], ",".join(e["rule"] for e in r["evidence"])) for r in got.collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[2:], (i, case, got[i])


@pytest.mark.parametrize("block", [2, 4096])
def test_blocking_equals_brute_force(spark, block):
    s = lambda *c: [(x, y, 0) for x, y in c]
    rows = [item(0, title="Kiln walls", doi="10.5555/a"), item(1, title="Loom weights", date="1971", doi="10.5555/a", creators=s(("Quist", "B"))), item(2, title="Flint mills", date="2012"), item(3, title="Flint mills", date="2015"), *(item(n, title=x, creators=[]) for n, x in ((4, "Survey notes"), (5, "Survey notes"), (6, "More survey notes"))), item(7, date=None, title="Undated"), item(8, linked_items=[(2, "K3"), (1, "K40")]), item(9, creators=s(("Quist", "B"), ("Vo", "T")), date="1970", linked_items=[(1, "K40")])]
    items = linkage.normalize_items(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r[0], r[1]) for r in linkage.candidate_pairs(items, across_libraries=False, block=block).collect())
    assert got == [(0, 1), (0, 2), (0, 7), (0, 8), (1, 9), (2, 7), (2, 8), (3, 7), (3, 8), (4, 5), (7, 8)]
    slim = lambda n: items.select(F.col("ordinal").alias(f"{n}o"), F.struct(*linkage.SLIM).alias(n))
    assert got == sorted((r[0], r[1]) for r in slim("l").join(slim("r"), (F.col("lo") < F.col("ro")) & linkage.is_candidate("l", "r")).select("lo", "ro").collect())


@pytest.mark.parametrize(("edges", "want"), [
    ([(0, 1, "exact"), (1, 2, "review")], {0: (0, "exact"), 1: (0, "exact"), 2: (2, None)}),
    ([(0, 1, "exact"), (1, 2, "high")], {0: (0, "exact"), 1: (0, "exact"), 2: (2, None)}),
    ([(0, 1, "exact"), (1, 3, "high")], {0: (0, "high"), 1: (0, "high"), 3: (0, "high"), 2: (2, None)}),
])
def test_high_edges_join_only_without_denial(spark, edges, want):
    rows = [item(0, doi="10.5555/x", extra="PMID: 1"), item(1, extra="PMID: 1"), item(2, doi="10.5555/y"), item(3)]
    items = linkage.normalize_items(spark.createDataFrame(rows, SCHEMA))
    matches = spark.createDataFrame([(a, b, "match" if t != "review" else "review", t, (a, 0, a, b)) for a, b, t in edges], "l_ordinal long, r_ordinal long, verdict string, tier string, order_key struct<block:long,pos:int,left:long,right:long>")
    got = {r["ordinal"]: (r["work"], r["confidence"]) for r in clustering.works_restricted(items, matches).collect()}
    assert {k: got[k] for k in want} == want


def plain_works(rows, edges):
    """Every edge in its turn, against all pairs of members."""
    cluster, weak = {r[0]: [r[0]] for r in rows}, {}
    fact = {r[0]: r[1:] for r in rows}
    related = {frozenset(p) for p in (("journalarticle", "preprint"), ("book", "thesis"))}

    def denied(x, y):
        kinds = frozenset((x[0], y[0]))
        if len(kinds) > 1 and kinds not in related and "document" not in kinds:
            return True
        return any(p and q and p != q for p, q in zip(x[1:4], y[1:4])) or bool(x[4] and y[4] and abs(x[4] - y[4]) > 1)

    for a, b, tier in [e for e in edges if e[2] == "exact"] + [e for e in edges if e[2] == "high"]:
        x, y = cluster[a], cluster[b]
        if x is y or tier == "high" and any(denied(fact[p], fact[q]) for p in x for q in y):
            continue
        strength = "high" if "high" in (tier, weak.get(id(x)), weak.get(id(y))) else "exact"
        x.extend(y)
        cluster.update(dict.fromkeys(y, x))
        weak[id(x)] = strength
    return {o: (min(c), weak.get(id(c))) for o, c in cluster.items()}


@pytest.mark.parametrize("most", [7, 50_000])
def test_rounds_of_bounded_groups_equal_the_plain_replay(spark, most):
    """One component of many edges, some denied, replayed at most so many edges at a time."""
    rnd = random.Random(11)
    pick = lambda *c: rnd.choice(c)
    rows = [(n, pick("journalarticle", "journalarticle", "journalarticle", "preprint", "document", None), pick(None, None, None, "10.5555/a", "10.5555/b"), None, pick(None, None, None, "1", "2"), pick(None, 2000, 2001, 2002)) for n in range(40)]
    pairs = sorted(rnd.sample([(a, b) for a in range(40) for b in range(a + 1, 40)], 150))
    edges = [(a, b, "exact" if rnd.random() < 0.06 else "high") for a, b in pairs]
    items = spark.createDataFrame(rows, "ordinal long, item_type string, doi string, isbn13 string, pmid string, year int")
    matches = spark.createDataFrame([(a, b, "match", t, (a, 0, a, b)) for a, b, t in edges], "l_ordinal long, r_ordinal long, verdict string, tier string, order_key struct<block:long,pos:int,left:long,right:long>")
    got = {r["ordinal"]: (r["work"], r["confidence"]) for r in clustering.works_restricted(items, matches, most=most).collect()}
    assert got == plain_works(rows, edges)
    assert len({w for w, _ in got.values()}) > 3


@pytest.mark.parametrize("kind", ["star", "chain", "mixed"])
def test_large_components_merge_in_rounds(spark, kind):
    """None of them is replayed in one task: stars and chains, with few conflicts and with many."""
    rnd = random.Random(len(kind))
    pick = lambda *c: rnd.choice(c)
    n = 18
    years = {"star": (2000, 2001), "chain": (None, None, None, 2000, 2005), "mixed": (None, 2000, 2001, 2003)}[kind]
    rows = [(k, "journalarticle", pick(*[None] * 8, "10.5555/a", "10.5555/b"), None, pick(None, None, None, "1", "2") if kind == "mixed" else None, pick(*years)) for k in range(n)]
    pairs = {"star": [(0, k) for k in range(1, n)], "chain": [(k, k + 1) for k in range(n - 1)], "mixed": sorted(rnd.sample([(a, b) for a in range(n) for b in range(a + 1, n)], 40))}[kind]
    edges = [(a, b, "exact" if rnd.random() < 0.04 else "high") for a, b in pairs]
    items = spark.createDataFrame(rows, "ordinal long, item_type string, doi string, isbn13 string, pmid string, year int")
    matches = spark.createDataFrame([(a, b, "match", t, (a, 0, a, b)) for a, b, t in edges], "l_ordinal long, r_ordinal long, verdict string, tier string, order_key struct<block:long,pos:int,left:long,right:long>")
    got = {r["ordinal"]: (r["work"], r["confidence"]) for r in clustering.works_restricted(items, matches, most=2).collect()}
    assert got == plain_works(rows, edges)


def test_search_by_a_stored_index(spark, tmp_path):
    """The pairs of the sources alone, each from its blocks; of the index only their folders are read."""
    rnd = random.Random(3)
    pick = lambda *c: rnd.choice(c)
    rows = [item(n, title=pick("", "Tide mills", "Salt pans"), date=pick(None, "1990", "1991", "1993"), doi=pick(None, None, "10.5555/a", "10.5555/b"), creators=pick([], [("Ode", "A", 0)], [("Ode", "A", 0), ("Rae", "B", 0)])) for n in range(80)]
    items = linkage.normalize_items(spark.createDataFrame(rows, SCHEMA)).cache()
    every = linkage.candidate_pairs(items).select("l_ordinal", "r_ordinal").collect()
    want = sorted({(a, b) for x, y in every for a, b in ((x, y), (y, x)) if a % 9 == 0})
    sources = items.where("ordinal % 9 = 0")
    index = linkage.block_index(items, f"file://{tmp_path}/blocks", 16)
    for got in (linkage.search_pairs(sources, index, 16), linkage.search_pairs(sources, index, 16, asked=0), linkage.search_pairs(sources, linkage.block_keys(items))):
        assert sorted(map(tuple, got.collect())) == want
    one = linkage.search_pairs(items.where("ordinal = 9"), index, 16)
    plan = one._jdf.queryExecution().executedPlan().toString()
    asked = {r["bucket"] for r in index.join(linkage.block_keys(items.where("ordinal = 9")).select("block_key"), "block_key").select("bucket").distinct().collect()}
    assert "PartitionFilters: [bucket" in plan and len(asked) <= 5
    found = linkage.find_copies(items.where("ordinal = 9"), items, index, 16)
    assert sorted(map(tuple, found.select("r_ordinal", "verdict").collect())) == sorted(map(tuple, linkage.find_copies(items.where("ordinal = 9"), items).select("r_ordinal", "verdict").collect()))
