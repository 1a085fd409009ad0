"""Pairs told in the blocks where they meet, against all candidate pairs judged one by one."""

from pyspark.sql import functions as F

from shelfmark.operators import difference, journal, linkage, rescan
from tests.test_linkage import SCHEMA, item
from tests.test_wanted_pairs import rows, shelf  # noqa: F401


def test_each_wanted_pair_is_told_once(shelf):  # noqa: F811
    items, every = shelf
    for want, block in ((linkage.MATCH, 3), (linkage.COPY, 4096)):
        got = linkage.told_pairs(items, items, want, True, block)
        assert rows(got, "verdict", "tier") == rows(every.where(F.col("verdict").isin(*want)), "verdict", "tier")


def test_partners_without_gathering_pairs(shelf):  # noqa: F811
    items, every = shelf
    found = linkage.partners(items, 1)
    tell = lambda df: sorted(map(tuple, df.select("target", "source").collect()))
    assert tell(found) == tell(difference.strong_partners(every, items, 1))
    assert "Aggregate [l_ordinal" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_all_pairs_come_once(shelf):  # noqa: F811
    items, every = shelf
    assert rows(linkage.pairs_once(items, items, ordered=True, block=7)) == rows(every)


def test_widened_pairs_are_not_gathered(shelf):  # noqa: F811
    items, _ = shelf
    found = linkage.widened_pairs(items, 1, 5)
    pairs = [tuple(r) for r in found.collect()]
    assert pairs and len(pairs) == len(set(pairs))
    assert "Aggregate [l_ordinal" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_exact_index_keeps_no_edge_for_each_pair(spark):
    many = linkage.normalize_items(spark.createDataFrame([item(n, doi="10.5555/a", title="Tide mills") for n in range(120)], SCHEMA))
    index = rescan.build(many, exact=True)
    assert index.edges.count() <= 120 and {r["work"] for r in index.works.collect()} == {0}


def test_kept_lines_are_read_once(spark):
    lines = spark.createDataFrame([('{"id": "1", "action": "import"}',), ("{",), (" ",)], "value string")
    entries, broken = journal.parse(lines, keep=True)
    assert (entries.first()["action"], broken.first()["value"]) == ("import", "{")
    assert "from_json" not in entries._jdf.queryExecution().optimizedPlan().toString()


def test_partners_in_classes(spark, shelf):  # noqa: F811
    items, every = shelf
    pairs, targets, sources = linkage.partner_classes(items, 1)
    side = lambda rows, x: rows.select(F.col("unit").alias(f"{x}_unit"), F.col("ordinal").alias(x))
    found = pairs.join(side(targets, "target"), "target_unit").join(side(sources, "source"), "source_unit")
    tell = lambda df, *cols: sorted(map(str, df.select(*cols).collect()))
    want = difference.strong_partners(every, items, 1).cache()
    assert tell(found, "target", "source") == tell(want, "target", "source")
    fields = items.select("ordinal", F.lit("volume").alias("field"), F.when(F.col("ordinal") % 5 > 0, F.concat(F.lit("v"), F.when(F.col("ordinal") % 2 == 0, " ").otherwise(""), F.col("ordinal") % 3)).alias("value"))
    cols = ["target", "field", "class", "missing_in", "target_value", "n_alternatives", "first_alternative", "notes", "format_only", F.transform("alternatives", lambda a: F.struct(a["value"], a["sources"][0]))]
    assert tell(difference.compare(linkage.Partners(pairs, targets, sources), fields), *cols) == tell(difference.compare(want, fields), *cols)


def test_equal_records_are_partners_as_one(spark):
    many = linkage.normalize_items(spark.createDataFrame([item(n, title="Tide mills") for n in range(120)], SCHEMA))
    assert linkage.partner_classes(many, 1).pairs.count() == 1


def test_compared_pairs_are_counted_with_their_libraries(spark, shelf):  # noqa: F811
    items, every = shelf
    sources = items.where("ordinal % 9 = 0")
    found = linkage.pairs_once(sources, items, library=True)
    want = linkage.search_pairs(sources, linkage.block_keys(items)).join(items.select(F.col("ordinal").alias("r_ordinal"), "library_id"), "r_ordinal")
    assert rows(found, "library_id") == rows(want, "library_id")


def test_widened_pairs_meet_by_lists_of_equal_keys(spark, shelf):  # noqa: F811
    items, _ = shelf
    shared = lambda r: {(i, r[i]) for i in linkage.t.IDENTIFIERS if r[i]} | {("c", k) for k in r["creator_keys"]} | {("o", *r["title_words"][:3]) for _ in [0] if len(r["title_words"]) > 2}
    every = [(r["ordinal"], r["library_id"], shared(r)) for r in items.collect()]
    want = sorted((l, r) for l, x, p in every if x != 1 for r, y, q in every if y == 1 and p & q)
    assert rows(linkage.widened_pairs(items, 1, 5)) == want
    many = linkage.normalize_items(spark.createDataFrame([item(n) for n in range(3000)], SCHEMA))
    found = linkage.widened_pairs(many, 1)
    assert found.count() == 1500 * 1500
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") > 1  # pairs come from lists


def test_values_of_partners_are_shuffled_once(spark, shelf):  # noqa: F811
    items, _ = shelf
    fields = items.select("ordinal", F.lit("volume").alias("field"), F.lit("v").alias("value"))
    plan = difference.compare(linkage.partner_classes(items, 1), fields)._jdf.queryExecution().executedPlan().toString()
    by_target = [line for line in plan.splitlines() if "hashpartitioning(target_unit" in line]
    assert by_target and not [line for line in by_target if ", field" in line]


def test_every_pair_is_judged_where_it_is_made(spark, shelf):  # noqa: F811
    items, every = shelf
    said = ("verdict", "tier", "rules", "title_rel", "type_rel", "rules_verdict")
    every = every.withColumn("rules", F.array_join(F.transform("evidence", lambda e: e["rule"]), ","))
    found = linkage.judged_pairs(items, items, ordered=True, block=7)
    assert rows(found, *said) == rows(every, *said)
    assert "Aggregate [l_ordinal" not in found._jdf.queryExecution().optimizedPlan().toString()
    matches = linkage.told_pairs(items, items, linkage.MATCH, True, why=True)
    assert rows(matches, *said) == rows(every.where("verdict = 'match'"), *said)
