"""Recall check and import plan against nested loops; change sets, decisions, the journal and the snapshot."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import changes, clustering, difference, journal, linkage, previews, snapshot
from tests.test_linkage import SCHEMA, item

S = lambda *c: [(x, y, 0) for x, y in c]
SHELF = [
    item(1, title="Kiln walls of the delta", creators=S(("Quist", "B"))),
    item(2, title="Kiln walls of the coast", creators=S(("Quist", "B"))),
    item(4, title="Kiln walls of the delta: an atlas", item_type="map", creators=S(("Vo", "T"))),
    item(3, title="Kiln walls of the delta region seen from boats", date="1950", creators=S(("Quist", "B"))),
    item(6, title="Loom weights", doi="10.5555/L", creators=[]),
    item(5, title="Weaving", doi="10.5555/l", item_type="map", creators=[]),
    item(8, title="Loom weights", creators=S(("Rao", "P"))),
    item(10, title="Loom weights", creators=S(("Rao", "P")), date="2012"),
    item(7, title="Loom weights", creators=S(("Rao", "Priya"))),
    item(9, title="Kiln walls of the delta: trade, tolls, taxes under three kings", creators=S(("Vo", "T"))),
    item(12, title=None, creators=[]),
]  # library 2 is home


@pytest.fixture(scope="module")
def items(spark):
    return linkage.normalize_items(spark.createDataFrame(SHELF, SCHEMA)).cache()


def reason(a, b):
    """The first reason that holds for two normalised rows."""
    words = lambda x: x["title_words"]
    if any(a[i] and a[i] == b[i] for i in ("doi", "isbn13", "pmid", "pmcid", "arxiv")):
        return "shared-identifier"
    creator = bool(set(a["creator_keys"]) & set(b["creator_keys"]))
    if words(a) and words(b):
        short, long = sorted((words(a), words(b)), key=len)
        if sorted(short) == sorted(long) or len(short) >= 2 and len(short) < len(long) and long[: len(short)] == short:
            return "same-title"
        both, either = len(set(short) & set(long)), len(set(short) | set(long))
        if creator and (either - both <= 2 or both / either >= 0.5):
            return "similar-title"
    near = a["year"] is not None and b["year"] is not None and abs(a["year"] - b["year"]) <= 1
    if min(len(words(a)), len(words(b))) >= 3 and words(a)[:3] == words(b)[:3] and (creator or near):
        return "same-opening-words"
    return None


def test_near_misses_and_import_plan_equal_nested_loops(spark, items):
    home, rows = 2, [r.asDict(recursive=True) for r in items.collect()]
    pairs = [(a["ordinal"], b["ordinal"]) for a in rows for b in rows if a["library_id"] != home and b["library_id"] == home]
    judged = {(r["l_ordinal"], r["r_ordinal"]): r["verdict"] for r in linkage.match_pairs(linkage.with_items(spark.createDataFrame(pairs, "l_ordinal long, r_ordinal long"), items)).collect()}
    by = {r["ordinal"]: r for r in rows}
    meets = lambda a, b: bool(set(a["creator_keys"]) & set(b["creator_keys"])) or reason(a, b) == "shared-identifier" or len(a["title_words"]) >= 3 and a["title_words"][:3] == b["title_words"][:3]
    pairs = [p for p in pairs if meets(by[p[0]], by[p[1]])]
    gone = {}
    for a, b in sorted(pairs):
        if judged[a, b] == "match":
            gone[a] = min(b, gone.get(a, b))
    want = sorted((a, b, reason(by[a], by[b])) for a, b in pairs if a not in gone and reason(by[a], by[b]))
    wanted = spark.createDataFrame([(r["ordinal"],) for r in rows if r["library_id"] != home], "ordinal long")
    present, missed = changes.near_misses(items, wanted, home)
    assert sorted(map(tuple, missed.select("l_ordinal", "r_ordinal", "reason").collect())) == want
    assert {x for _, _, x in want} == set(changes.REASONS) and missed.where("evidence = ''").isEmpty()
    assert dict(map(tuple, present.collect())) == gone and gone
    flagged = {a for a, _, _ in want}
    plan = {r["ordinal"]: r["decision"] for r in changes.import_plan(wanted, present, missed).collect()}
    assert plan == {r["ordinal"]: "skip" if r["ordinal"] in flagged else "import" for r in rows if r["library_id"] != home and r["ordinal"] not in gone}


def test_import_decisions(spark, items):
    plan = spark.createDataFrame([(2, "import"), (4, "skip"), (6, "import")], "ordinal long, decision string")
    said = previews.decided(plan, spark.createDataFrame([(4, "import"), (99, "skip")], "ordinal long, decision string"))
    assert sorted(map(tuple, said.collect())) == [(2, "import"), (4, "import"), (6, "import")]
    assert previews.confirmed(plan, None, "now") is None
    with pytest.raises(ValueError):
        previews.rows_to_import(plan)
    done = previews.confirmed(plan, spark.createDataFrame([(4,), (99,)], "ordinal long"), "now")
    assert [r["ordinal"] for r in previews.rows_to_import(done).collect()] == [4]
    present = spark.createDataFrame([(8, 7)], "l_ordinal long, home_ordinal long")
    missed = spark.createDataFrame([(4, 3, "same-title", 1, "Why.")], "l_ordinal long, r_ordinal long, reason string, rank int, evidence string")
    rows = {r["key"]: r for r in previews.import_preview(plan, present, missed, items).collect()}
    assert rows["1:K8"]["disabled"] and not rows["1:K8"]["checked"] and "2011" in rows["1:K8"]["warnings"][0]
    assert rows["1:K2"]["checked"] and rows["1:K2"]["warnings"] == [] and rows["1:K2"]["detail"] == "journalArticle · 2011 · L1"
    assert rows["1:K4"]["warnings"][0].endswith("Why.")


def test_compare_and_swap(spark):
    fields = spark.createDataFrame([(1, "issue", None), (1, "volume", "3"), (2, "issue", "5"), (3, "issue", "7")], "ordinal long, field string, value string")
    edits = spark.createDataFrame([(1, "issue", "", "9"), (1, "volume", "3", None), (2, "issue", "4", "9"), (3, "issue", "7", "8"), (99, "issue", None, "9")], "target long, field string, expected string, next string")
    checks = spark.createDataFrame([(3, 98, "issue", "")], "target long, source long, field string, expected string")
    outcome, after = changes.apply_edits(fields, edits, checks)
    assert dict(map(tuple, outcome.collect())) == {1: "written", 2: "target-changed", 3: "source-changed", 99: "target-missing"}
    assert sorted(map(tuple, after.collect())) == [(1, "issue", "9"), (1, "volume", ""), (2, "issue", "5"), (3, "issue", "7")]
    _, back = changes.apply_edits(after, changes.revert(edits.where("target = 1")))
    assert sorted(map(tuple, back.collect()))[:2] == [(1, "issue", ""), (1, "volume", "3")]
    assert changes.apply_edits(fields, edits, alive=spark.createDataFrame([(2,)], "ordinal long"))[0].where("status = 'target-missing'").count() == 3


def test_difference_notes_and_edits(spark):
    fields = spark.createDataFrame(
        [(1, "date", "2011", "2011-00-00"), (2, "date", "May 2011", "2011-05-00"), (1, "title", "Kiln  Walls", None), (2, "title", "kiln walls!", None), (2, "rights", "free", None), (1, "place", " ", None), (2, "place", "Hue", None), (3, "place", "Huế", None), (2, "DOI", "10.5555/a", None), (1, "DOI", "", None)],
        "ordinal long, field string, value string, key string",
    )
    partners = spark.createDataFrame([(1, 2), (1, 3)], "target long, source long")
    rows = difference.compare(partners, fields, spark.createDataFrame([(1, "map", ["author"])], "ordinal long, item_type string, creator_types array<string>")).cache()
    got = {r["field"]: r for r in rows.collect()}
    assert got["date"]["class"] == "DIFFERENT" and got["date"]["notes"] == ["The source's date is more precise."]
    assert got["title"]["class"] == "IDENTICAL" and "kiln walls!" in got["title"]["notes"][0]
    assert got["rights"]["why_not"] == "map has no rights field"
    assert got["place"]["class"] == "MISSING" and got["place"]["alternatives"][0]["sources"] == [2, 3]
    assert [(r["field"], r["next"]) for r in previews.fill_edits(rows).collect()] == [("place", "Hue")]
    picks = spark.createDataFrame([(1, "date", 0), (1, "DOI", 1), (1, "rights", 0), (1, "place", -1)], "target long, field string, choice int")
    assert [(r["field"], r["expected"], r["next"]) for r in previews.proposed_edits(rows, picks).collect()] == [("date", "2011", "May 2011")]


def test_journal(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert [x.count() for x in journal.read(spark, path)] == [0, 0]
    ref = "struct<libraryID:int,itemKey:string,title:string,libraryName:string>"
    change = [("issue", "issue", "", "4", "MISSING", (2, "A", "L"))]
    schema = f"confirmedAt string, session string, status string, target {ref}, changes array<struct<field:string,name:string,old:string,new:string,class:string,source:struct<libraryID:int,itemKey:string,libraryName:string>>>, evidence array<string>"
    rows = [("2024-01-01T00:00:01Z", "a", "written", (1, "X", "t", None), change, ["e"]), ("2024-01-01T00:00:02Z", "b", "written", (1, "Y", "t", None), change, []), ("2024-01-01T00:00:03Z", "b", "target-changed", (1, "Z", "t", None), change, [])]
    journal.append(journal.metadata_entries(spark.createDataFrame(rows, schema)), path)
    made = spark.createDataFrame([("c", "2024-01-01T00:00:04Z", 2, (2, "A", 1, "t"), "failed", "broken", None), ("c", "2024-01-01T00:00:04Z", 1, (2, "B", 1, "t"), "created", None, (1, "N"))], "session string, confirmedAt string, no int, source struct<libraryID:int,itemKey:string,version:bigint,title:string>, status string, detail string, created struct<libraryID:int,itemKey:string>")
    journal.append(journal.import_entries(made), path)
    spark.createDataFrame([(" ",), ("{",)], "value string").write.mode("append").text(path)
    entries, broken = journal.read(spark, path)
    assert entries.count() == 4 and broken.count() == 1
    assert [tuple(r) for r in journal.created_refs(entries).collect()] == [(1, "N")]
    last = journal.last_session(entries, "update_metadata")
    assert [r["target"]["itemKey"] for r in last.collect()] == ["Y"]
    assert [tuple(r)[1:] for r in journal.reverting_edits(last).collect()] == [("Y", "issue", "4", "")]
    left = journal.mark_undone(entries, last.select("id"), "later")
    assert [r["target"]["itemKey"] for r in journal.last_session(left, "update_metadata").collect()] == ["X"]
    name = spark.range(1).select(journal.session_name(F.lit("2024-01-01T10:20:30.5Z"))).first()[0]
    assert name == "2024-01-01 10:20"


def test_snapshot(spark, items, tmp_path):
    path = f"file://{tmp_path}/index"
    assert snapshot.load(spark, path) is None
    works = items.select("ordinal", F.when(F.col("ordinal").isin(7, 8, 10), 7).otherwise(F.col("ordinal")).alias("work"), F.when(F.col("ordinal").isin(7, 8, 10), "high").alias("confidence"))
    libraries = spark.createDataFrame([(1, "One", 3, "9|x")], "library_id int, name string, version long, local_change string")
    snapshot.save(snapshot.create(items, works, libraries, "then"), path)
    got = snapshot.load(spark, path)
    assert got.scanned_at == "then"
    refs = spark.createDataFrame([(1, "K8"), (2, "K7"), (1, "none")], "library_id int, item_key string")
    rows = {r["item_key"]: (r["id"], r["also_in"], r["copies_here"]) for r in snapshot.work_for(got, refs).collect()}
    assert rows == {"K8": ("1:K10|1:K8|2:K7", ["Library 2"], 2), "K7": ("1:K10|1:K8|2:K7", ["One"], 1), "none": (None, [], 1)}
    spark.createDataFrame([(2, "then")], snapshot.META).write.mode("overwrite").json(f"{path}/meta")
    assert snapshot.load(spark, path) is None


def test_links_and_trash(spark, items):
    rows = items.withColumn("linked_items", F.expr("if(ordinal = 1, array(struct(1 as library_id, 'K2' as item_key)), linked_items)"))
    asked = spark.createDataFrame([(1, 1, "K2"), (1, 1, "K9"), (99, 1, "K2")], "ordinal long, library_id int, item_key string")
    said, after = changes.remove_links(rows, asked)
    assert sorted(r["status"] for r in said.collect()) == ["link-missing", "removed", "target-missing"]
    said, again = changes.restore_links(after, asked)
    assert sorted(r["status"] for r in said.collect()) == ["restored", "restored", "target-missing"]
    assert [tuple(x) for x in again.where("ordinal = 1").first()["linked_items"]] == [(1, "K2"), (1, "K9")]
    gone = changes.trashed(items.withColumn("deleted", F.lit(False)), spark.createDataFrame([(1, "K2"), (1, "no")], "library_id int, item_key string"))
    assert [r["ordinal"] for r in gone.where("deleted").collect()] == [2]
    assert clustering.components(spark.createDataFrame([(1, 2)], "a long, b long")).count() == 2


def test_near_misses_meet_by_their_titles(spark, items):
    """Titles of few or no words, and counts without a row for each near miss."""
    titles = ["Kiln", "Wool", "The", "The of", "Kiln wool", "Wool trade", "Kiln trade sites", "Ash glaze on red clay", "Ash glaze on red brick", "Ash glaze on grey slate roofs", "", None, "Kiln kiln"]
    rows = [item(n, title=titles[n % 13], date=None if n % 29 == 0 else ["2011", "1950"][n % 2], doi="10.5555/a" if n % 17 == 0 else None, creators=[[], [("Rao", "P", 0)], [("Rao", "P", 0), ("Ode", "A", 0)]][n % 5 % 3]) for n in range(130)]
    items = linkage.normalize_items(spark.createDataFrame(rows, SCHEMA)).cache()
    rows = [r.asDict(recursive=True) for r in items.collect()]
    pairs = linkage.widened_pairs(items, 2)
    judged = {(r["l_ordinal"], r["r_ordinal"]): r["verdict"] for r in linkage.match_pairs(linkage.with_items(pairs, items)).collect()}
    by, gone = {r["ordinal"]: r for r in rows}, {a for (a, _), v in judged.items() if v == "match"}

    def why(a, b):  # reason leaves out titles without content words
        w, v = set(a["title_words"]), set(b["title_words"])
        bare = a["normalized_title"] and b["normalized_title"] and not (w and v)
        return reason(a, b) or (bare and ("same-title" if w == v else "similar-title" if set(a["creator_keys"]) & set(b["creator_keys"]) and len(w | v) <= 2 else None)) or None

    want = sorted((a, b, why(by[a], by[b])) for a, b in judged if a not in gone and why(by[a], by[b]))
    wanted = items.where("library_id <> 2").select("ordinal")
    present, missed = changes.near_misses(items, wanted, 2, explain=False)
    assert sorted(map(tuple, missed.select("l_ordinal", "r_ordinal", "reason").collect())) == want
    assert {r["l_ordinal"] for r in present.collect()} == gone and len(want) > 50
    tell = lambda x: sorted(map(tuple, x.collect()))
    there, counted = changes.counted_misses(items, wanted, 2)
    assert tell(there) == tell(present) and tell(counted) == tell(missed.groupBy("l_ordinal").count())


def test_equal_records_are_judged_once(spark):
    many = linkage.normalize_items(spark.createDataFrame([item(n, title="Tide mills" if n % 2 else "Tide mills of Kent, ash") for n in range(120)], SCHEMA))
    _, missed, theirs, ours = changes.recall(many, many.where("library_id <> 1").select("ordinal"), 1)
    assert theirs.count() == 60 and ours.select("first").distinct().count() == 1 and missed.count() <= 1
