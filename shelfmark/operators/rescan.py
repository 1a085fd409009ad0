"""The index of works kept up to date: after a rescan only what changed records touch is matched and
clustered again, and the result is that of a full rebuild."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from . import clustering, linkage


@dataclass
class Index:
    """items: normalised; edges: l_ordinal, r_ordinal, tier, order_key of the confirmed pairs; works: ordinal, work,
    confidence. Of exact edges alone: ties that connect what all of them would."""

    items: DataFrame
    edges: DataFrame
    works: DataFrame


def _confirmed(matches: DataFrame) -> DataFrame:
    return matches.where("verdict = 'match' and tier in ('exact', 'high')")


def _exact(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, no more than items, that tie what exact matches connect (linkage.exact_edges), and the works."""
    ends = [F.least("a", "b").alias("l_ordinal"), F.greatest("a", "b").alias("r_ordinal")]
    edges = linkage.exact_edges(items).select(*ends).distinct()
    order = F.struct(F.col("l_ordinal").alias("block"), F.lit(0).alias("pos"), F.col("l_ordinal").alias("left"), F.col("r_ordinal").alias("right"))
    edges = stored(edges.select("l_ordinal", "r_ordinal", F.lit("exact").alias("tier"), order.alias("order_key")), "index-edges")
    roots = stored(clustering.components(edges.select(F.col("l_ordinal").alias("a"), F.col("r_ordinal").alias("b"))), "index-roots")
    works = items.select("ordinal").join(roots.withColumnRenamed("node", "ordinal"), "ordinal", "left")
    return edges, stored(works.select("ordinal", F.coalesce("root", "ordinal").alias("work"), F.when(F.col("root").isNotNull(), "exact").alias("confidence")), "index-works")


def _rescan_exact(before: Index, now: DataFrame, moved: DataFrame) -> Index:
    """Redone are the works that held a touched record or hold one that shares an identifier or a link with one: no
    exact edge leaves them, so they are tied and clustered as in a full rebuild, and the others stay."""
    there = moved.where("there").select("ordinal")
    keys = linkage.asserted_keys(now, True)
    blocks = keys.join(there, "ordinal", "left_semi").select("block_key").distinct()
    seeds = keys.join(blocks, "block_key", "left_semi").select("ordinal").unionByName(moved.select("ordinal")).distinct()
    works = stored(before.works.join(seeds, "ordinal", "left_semi").select("work").distinct(), "rescan-works")
    redone = before.works.join(works, "work", "left_semi").select("ordinal").unionByName(moved.select("ordinal")).distinct()
    redone = stored(redone, "rescan-reached")
    edges, again = _exact(stored(now.join(redone, "ordinal", "left_semi"), "rescan-redone"))
    kept = before.edges.join(redone.withColumnRenamed("ordinal", "l_ordinal"), "l_ordinal", "left_anti").select(*edges.columns)
    rest = before.works.join(redone, "ordinal", "left_anti").select(*again.columns)
    return Index(now, stored(kept.unionByName(edges), "index-edges"), stored(rest.unionByName(again), "index-works"))


def _clustered(items: DataFrame, edges: DataFrame) -> DataFrame:
    return clustering.works_restricted(items, edges.withColumn("verdict", F.lit("match")))


def build(items: DataFrame, exact: bool = False) -> Index:
    """From nothing. exact: of exact edges alone, which links and identifiers find; `rescan` takes the same."""
    items = stored(items, "index-items")
    if exact:
        return Index(items, *_exact(items))
    matches = linkage.match_pairs(linkage.with_items(linkage.candidate_pairs(items), items))
    edges = stored(_confirmed(matches).select("l_ordinal", "r_ordinal", "tier", "order_key"), "index-edges")
    return Index(items, edges, stored(_clustered(items, edges), "index-works"))


def refreshed(before: DataFrame, fresh: DataFrame, stale: DataFrame) -> DataFrame:
    """The items before, those of the stale libraries (library_id) as they are in fresh."""
    return before.join(stale, "library_id", "left_anti").select(*fresh.columns).unionByName(fresh.join(stale, "library_id", "left_semi"))


def touched(before: DataFrame, now: DataFrame) -> DataFrame:
    """ordinal, there: the items that were added or changed, and, with there false, those removed."""
    mark = lambda items, name: items.select("ordinal", F.xxhash64(F.to_json(F.struct(*linkage.SLIM), {"ignoreNullFields": "false"})).alias(name))
    rows = mark(before, "old").join(mark(now, "new"), "ordinal", "full_outer")
    return rows.where(~F.col("old").eqNullSafe(F.col("new"))).select("ordinal", F.col("new").isNotNull().alias("there"))


def rescan(before: Index, now: DataFrame, exact: bool = False) -> Index:
    """The index of the items now (normalised, or `refreshed`). New pairs come from the blocks of what was touched;
    clustered again are the components, as they are now, that hold a touched record, a neighbour that one
    had, an end of a new edge, or an edge whose place in the order has changed, as the first record of its
    block has. Everything else stays as it was, without being matched or clustered."""
    now = stored(now, "rescan-items")
    moved = stored(touched(before.items, now), "rescan-touched")
    if moved.isEmpty():
        return Index(now, before.edges, before.works)
    if exact:
        return _rescan_exact(before, now, moved)
    gone = lambda rows, end: rows.join(moved.select(F.col("ordinal").alias(end)), end, "left_anti")
    kept = gone(gone(before.edges, "l_ordinal"), "r_ordinal")

    fresh = now.join(moved.where("there"), "ordinal", "left_semi")
    pairs = linkage.search_pairs(fresh, linkage.asserted_keys(now, exact)).select(F.least("l_ordinal", "r_ordinal").alias("l_ordinal"), F.greatest("l_ordinal", "r_ordinal").alias("r_ordinal")).distinct()
    new = stored(_confirmed(linkage.match_pairs(linkage.with_items(pairs, now))).select("l_ordinal", "r_ordinal", "tier"), "rescan-new")

    # edges in blocks whose first record is another one now
    old_keys, new_keys = linkage.asserted_keys(before.items, exact), linkage.asserted_keys(now, exact)
    hit = old_keys.join(moved, "ordinal", "left_semi").unionByName(new_keys.join(moved, "ordinal", "left_semi")).select("block_key").distinct()
    hit = stored(hit, "rescan-blocks")
    of = lambda keys, name: linkage.first_rows(keys.join(hit, "block_key", "left_semi")).withColumnRenamed("at", name)
    other = of(old_keys, "was").join(of(new_keys, "is"), "block_key", "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("block_key")
    there = stored(new_keys.join(other, "block_key", "left_semi").select("ordinal", "block_key"), "rescan-others")
    shifted = kept.join(there.withColumnRenamed("ordinal", "l_ordinal"), "l_ordinal").join(there.withColumnRenamed("ordinal", "r_ordinal"), ["r_ordinal", "block_key"])

    both = lambda rows: rows.select(F.explode(F.array("l_ordinal", "r_ordinal")).alias("ordinal"))
    had = before.edges.join(moved.select(F.col("ordinal").alias("l_ordinal")), "l_ordinal", "left_semi").unionByName(before.edges.join(moved.select(F.col("ordinal").alias("r_ordinal")), "r_ordinal", "left_semi").select(*before.edges.columns))
    seeds = moved.select("ordinal").unionByName(both(had)).unionByName(both(new)).unionByName(both(shifted)).distinct()
    seeds = stored(seeds.join(now.select("ordinal"), "ordinal", "left_semi"), "rescan-seeds")

    edges = stored(kept.select("l_ordinal", "r_ordinal", "tier", "order_key").unionByName(new.withColumn("order_key", F.lit(None).cast(dict(kept.dtypes)["order_key"]))), "rescan-edges")
    # the touched parts of the graph, grown from the seeds: the other components are not even labelled
    reached = seeds
    ways = edges.select(F.col("l_ordinal").alias("a"), F.col("r_ordinal").alias("b"))
    ways = stored(ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b"))), "rescan-ways")
    front = seeds
    while True:
        front = stored(ways.join(front.withColumnRenamed("ordinal", "a"), "a", "left_semi").select(F.col("b").alias("ordinal")).distinct().join(reached, "ordinal", "left_anti"), "rescan-front")
        if front.isEmpty():
            break
        reached = stored(reached.unionByName(front), "rescan-reached")

    inside = edges.join(reached.withColumnRenamed("ordinal", "l_ordinal"), "l_ordinal", "left_semi")
    redone = stored(linkage.ordered(inside, now, exact).select("l_ordinal", "r_ordinal", "tier", "order_key"), "rescan-redone")
    outside = edges.join(reached.withColumnRenamed("ordinal", "l_ordinal"), "l_ordinal", "left_anti").select(*redone.columns)
    works = _clustered(now.join(reached, "ordinal", "left_semi"), redone)
    rest = before.works.join(reached, "ordinal", "left_anti").join(moved.select("ordinal"), "ordinal", "left_anti")
    return Index(now, stored(outside.unionByName(redone), "index-edges"), stored(rest.unionByName(works), "index-works"))
