"""Typed records and the scan of several libraries."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import difference, linkage
from shelfmark.plans.versions import Tables
from shelfmark.sources import records

NAMES = [("book", "title", "title"), ("book", "publisher", "publisher"), ("thesis", "title", "title"), ("thesis", "university", "publisher"), ("thesis", "date", "date"), ("thesis", "callNumber", "callNumber"), ("map", "scale", "scale")]
WIDE = "ordinal long, item_type string, title string, publisher string, university string, date string, callNumber string, pages int"


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(1, "book", "Kilns", "Marsh", "no", "2011-05-00 May 2011", "x", 3), (2, "thesis", None, "no", "Delta", "2011-05-00 May 2011", "x", 3), (3, "thesis", "", None, None, "2012-00-00", None, None), (4, "thesis", "", None, None, "spring", None, None), (5, "map", "t", None, None, None, None, None)]
    return spark.createDataFrame(rows, WIDE)


def test_fields_of_types(spark, wide):
    names = spark.createDataFrame(NAMES, "item_type string, name string, base string")
    got = sorted(map(tuple, records.field_rows(wide, names).collect()))
    assert got == sorted([
        (1, "title", "title", "Kilns", None), (1, "publisher", "publisher", "Marsh", None), (2, "title", "title", "", None), (2, "publisher", "university", "Delta", None), (2, "date", "date", "May 2011", "2011-05-00"),
        (3, "title", "title", "", None), (3, "publisher", "university", "", None), (3, "date", "date", "2012-00-00", "2012-00-00"), (4, "title", "title", "", None), (4, "publisher", "university", "", None), (4, "date", "date", "spring", None),
    ])
    some = records.field_rows(wide, names, spark.createDataFrame([(3,), (3,), (99,)], "ordinal long"))
    assert {r["ordinal"] for r in some.collect()} == {3} and some.count() == 3
    rows = difference.compare(spark.createDataFrame([(3, 1)], "target long, source long"), records.field_rows(wide, names))
    found = {r["field"]: (r["class"], r["target_name"], r["first_alternative"]) for r in rows.collect()}
    assert found == {"title": ("MISSING", "title", "Kilns"), "publisher": ("MISSING", "university", "Marsh"), "date": ("MISSING", "date", None)}
    edits = spark.createDataFrame([(1, "publisher", "A"), (3, "publisher", "B"), (3, "title", None), (5, "publisher", "C"), (9, "title", "D")], "target long, field string, value string")
    named = {(r["target"], r["field"]): r["name"] for r in records.own_names(edits, wide, names).collect()}
    assert named == {(1, "publisher"): "publisher", (3, "publisher"): "university", (3, "title"): "title", (5, "publisher"): None, (9, "title"): None}
    after = {r["ordinal"]: r for r in records.written(wide, records.own_names(edits, wide, names).where("name is not null").select(F.col("target").alias("ordinal"), "name", "value")).collect()}
    assert (after[1]["publisher"], after[3]["university"], after[3]["title"], after[3]["publisher"], after[2]["university"], after[1]["pages"]) == ("A", "B", "", None, "Delta", 3)


def test_scan_keeps_what_is_eligible(spark):
    rows = [(1, 1, True, True, False, ""), (2, 1, False, True, False, "x"), (3, 1, True, False, False, "x"), (4, 1, True, True, True, "x"), (5, 2, True, True, False, "x"), (6, 3, True, True, False, "x")]
    items = spark.createDataFrame(rows, "ordinal long, library_id int, is_regular boolean, top_level boolean, deleted boolean, title string")
    shelf = spark.createDataFrame([(1, "One", "user"), (2, "Two", "feed")], "library_id int, library_name string, library_type string")
    assert [(r["ordinal"], r["title"], r["library_name"]) for r in linkage.scan(items, shelf).collect()] == [(1, None, "One")]


def test_libraries_are_read_at_pinned_versions(spark, tmp_path):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    libraries = {k: Tables(spark, f"file://{tmp_path}/{k}") for k in (1, 2, 3, 4)}
    libraries[1].commit(None, {"items": make([(1, "a", "2024-01-01"), (2, "b", "2024-01-02")], "ordinal long, title string, modified string")}, keys={"items": ["ordinal"]})
    libraries[2].commit(None, {"items": make([(3, "c", True)], "ordinal long, title string, deleted boolean")}, keys={"items": ["ordinal"]})
    libraries[4].commit(None, {"items": make([(4, "d")], "ordinal long, title string")}, keys={"items": ["ordinal"]})
    shelf = make([(1, "One", "user"), (2, "Two", "group"), (3, "Three", "group"), (4, "Four", "feed")], "library_id int, library_name string, library_type string")
    with pytest.raises(ValueError):
        records.scan({3: libraries[3]}, shelf)
    pins = records.pinned(libraries)
    libraries[1].commit(pins[1], changed={"items": make([(2, "B", "2024-01-02"), (9, "new", "2024-01-01")], "ordinal long, title string, modified string")})
    got = records.scan(libraries, shelf, pins)
    assert sorted((r["ordinal"], r["title"]) for r in got.items.collect()) == [(1, "a"), (2, "b")]
    assert {r["library_id"]: (r["name"], r["version"], r["local_change"]) for r in got.libraries.collect()} == {1: ("One", 1, "2|2024-01-02"), 2: ("Two", 1, "1|")}
    assert "/4/" not in got.items._jdf.queryExecution().toString()  # the feed isn't opened
    assert {r["library_id"]: r["why"] for r in records.stale(got, libraries, shelf).collect()} == {1: "version"}
