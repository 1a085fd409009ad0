"""Versioned tables, the index and the log on them, and plans carried out chunk by chunk."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import changes, execution, journal, snapshot
from shelfmark.plans.versions import Conflict, Tables

ITEMS = "ordinal long, library_id int, item_key string, version long, deleted boolean, item_type string, title string, linked_items array<struct<library_id:int,item_key:string>>, tags array<string>, collection string"


def store(spark, tmp_path, items, fields=()):
    tables = Tables(spark, f"file://{tmp_path}/store")
    frames = {"items": spark.createDataFrame(items, ITEMS), "fields": spark.createDataFrame(list(fields), "ordinal long, field string, value string")}
    tables.commit(None, frames, keys={"items": ["ordinal"], "fields": ["ordinal", "field"]})
    return tables


def item(n, library=2, version=5, deleted=False, linked=(), title="t", kind="book"):
    return (n, library, f"K{n}", version, deleted, kind, title, list(linked), ["x"], None)


def plan(spark, *rows, confirmed="2024-05-01T10:20:00Z"):
    return spark.createDataFrame([(n, v, d, confirmed) for n, v, d in rows], "ordinal long, version long, decision string, confirmed_at string")


def said(outcome):
    return {r[0]: r[1] for r in outcome.rows.collect()}


def test_versions(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/v")
    assert t.latest() is None and t.compact() is None
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    one = t.commit(None, {"a": rows((1, "x"), (2, "y")), "b": rows((9, "z"))}, keys={"a": ["k"], "b": []}, note={"n": 1})
    two = t.commit(one, changed={"a": rows((2, "Y"), (3, None)), "b": rows((9, "z"))})
    three = t.commit(two, changed={"a": rows((3, "W"))}, note={"n": 3})
    tell = lambda v, name="a": sorted(map(tuple, t.table(v, name).collect()))
    assert tell(one) == [(1, "x"), (2, "y")] and tell(two) == [(1, "x"), (2, "Y"), (3, None)] and tell(three) == [(1, "x"), (2, "Y"), (3, "W")]
    assert tell(three, "b") == [(9, "z"), (9, "z")] and (two.note, three.note) == ({"n": 1}, {"n": 3})
    with pytest.raises(Conflict):
        t.commit(two, changed={"a": rows((1, "late"))})
    assert tell(t.latest()) == tell(three) and t.latest(sound=True) == three
    four = t.compact()
    assert len(four.tables["a"]["parts"]) == 1 and tell(four) == tell(three) and t.compact().number == four.number
    want = tell(three)
    t.tidy(keep=1)
    assert t.numbers() == [4] and len(os.listdir(f"{tmp_path}/v/tables")) == 2 and tell(t.latest()) == want
    with pytest.raises(ValueError):
        t.commit(t.commit(four, {"c": rows((1, "x"))}), changed={"c": rows((1, "y"))})


def test_of_two_writers_one_wins_and_the_other_checks_again(spark, tmp_path):
    t = store(spark, tmp_path, [item(1, 1)], [(1, "issue", ""), (1, "volume", "")])
    edit = lambda field, value: spark.createDataFrame([(1, field, "", value)], "target long, field string, expected string, next string")
    tries = []

    def write(field, value, first=None):
        def make(base):
            tries.append(base.number)
            outcome, good = changes.checked_edits(t.table(base, "fields"), edit(field, value))
            status = outcome.first()["status"]
            if first and len(tries) == 1:
                first()  # another session commits between this check and its commit
            return ({"changed": {"fields": good}} if status == "written" else None), status

        return t.update(make)[1]

    assert write("issue", "4", lambda: write("issue", "7")) == "target-changed" and tries == [1, 1, 2]
    tries.clear()
    assert write("volume", "1", lambda: write("issue", "7")) == "written"
    assert sorted(map(tuple, t.table(t.latest(), "fields").collect())) == [(1, "issue", "7"), (1, "volume", "1")]
    # two that publish the same number
    with pytest.raises(Conflict):
        t._publish(t.latest().number, "{}")


def index(spark, scanned, n):
    works = spark.createDataFrame([(f"1:K{i}", None, (1, f"K{i}", 1), [(1, f"K{i}", 1)]) for i in range(n)], snapshot.WORKS)
    return snapshot.Snapshot(scanned, spark.createDataFrame([(1, "One", 3, "9|x")], snapshot.LIBRARIES).coalesce(1), works.coalesce(1))


def test_a_save_that_dies_leaves_the_index_before(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    snapshot.save(index(spark, "A", 200), path)
    for step in range(3):
        calls = []

        def dying(real, step=step, calls=calls):
            def run(self, *a):
                calls.append(a)
                if len(calls) > step:
                    raise KeyboardInterrupt
                return real(self, *a)

            return run

        with monkeypatch.context() as m:
            m.setattr(Tables, "_write", dying(Tables._write))
            m.setattr(Tables, "_publish", dying(Tables._publish))
            with pytest.raises(KeyboardInterrupt):
                snapshot.save(index(spark, "B", 5), path)
        got = snapshot.load(spark, path)
        assert got.scanned_at == "A" and got.works.count() == 200
    snapshot.save(index(spark, "B", 5), path)
    assert snapshot.load(spark, path).scanned_at == "B" and snapshot.load(spark, path).works.count() == 5


def test_damaged_and_foreign_files(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    snapshot.save(index(spark, "A", 20), path)
    old = set(glob.glob(f"{tmp_path}/index/**/part-*", recursive=True) + glob.glob(f"{tmp_path}/index/versions/*"))
    snapshot.save(index(spark, "B", 30), path)
    new = [p for p in glob.glob(f"{tmp_path}/index/**/part-*", recursive=True) + glob.glob(f"{tmp_path}/index/versions/*") if p not in old]
    assert len(new) >= 3
    for p in new:
        whole = open(p, "rb").read()
        crc = os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc")
        flipped = whole[: len(whole) // 3] + bytes([whole[len(whole) // 3] ^ 255]) + whole[len(whole) // 3 + 1 :]
        for spoilt in (whole[: len(whole) // 2], flipped, b""):
            open(p, "wb").write(spoilt)
            kept = open(crc, "rb").read() if os.path.exists(crc) else None
            if kept is not None:
                os.unlink(crc)
            got = snapshot.load(spark, path)
            # a byte that says nothing about the rows does no harm
            assert (got.scanned_at, got.works.count()) in [("A", 20), *([("B", 30)] if spoilt is flipped else [])]
            if kept is not None:
                open(crc, "wb").write(kept)
        open(p, "wb").write(whole)
    assert snapshot.load(spark, path).scanned_at == "B"
    for p in old:
        if "versions" not in p:
            os.unlink(p)
    assert snapshot.load(spark, path).scanned_at == "B"
    tables = Tables(spark, path)
    tables.commit(tables.latest(), note={"schemaVersion": 9, "scannedAt": "C"})
    assert snapshot.load(spark, path) is None
    tables.commit(tables.latest(), {"works": spark.range(3)}, note={"schemaVersion": snapshot.VERSION, "scannedAt": "C"})
    assert snapshot.load(spark, path) is None


def meta(spark, rows):
    ref = "struct<libraryID:int,itemKey:string,title:string,libraryName:string>"
    change = [("issue", "issue", "", "4", "MISSING", (2, "A", "L"))]
    schema = f"confirmedAt string, session string, status string, target {ref}, changes array<struct<field:string,name:string,old:string,new:string,class:string,source:struct<libraryID:int,itemKey:string,libraryName:string>>>, evidence array<string>"
    return journal.metadata_entries(spark.createDataFrame([(at, s, "written", (1, k, "t", None), change, ["e"]) for at, s, k in rows], schema))


def test_log(spark, tmp_path):
    log = journal.Log(spark, f"file://{tmp_path}/log")
    assert [x.count() for x in log.read()] == [0, 0]
    log.mark_undone(spark.createDataFrame([("x",)], "id string"), "never")
    log.append(meta(spark, [("2024-01-02T00:00:00Z", "b", f"K{i}") for i in range(1000)]))
    log.append_lines(spark.createDataFrame([("{",), (" ",), ('{"id": "x", "action": "shout"}',)], "value string"))
    # a clock that was set back: the latest session is the one that stands last, whatever its times
    log.append(meta(spark, [("2024-01-01T00:00:00Z", "a", "Y"), ("2024-01-01T00:00:00Z", "a", "Z")]))
    for _ in range(2):
        entries, broken = log.read()
        assert entries.count() == 1002 and broken.count() == 2 and entries.select("id").distinct().count() == 1002
        last = journal.last_session(entries, "update_metadata")
        assert sorted(r["target"]["itemKey"] for r in last.collect()) == ["Y", "Z"]
        log.compact()
    log.mark_undone(last.select("id"), "later")
    entries, broken = log.read()
    again = journal.last_session(entries, "update_metadata")
    assert again.count() == 1000 and again.select("segment").distinct().count() == 1
    places = [r["target"]["itemKey"] for r in again.orderBy("segment", "line").collect()]
    assert places == [r["target"]["itemKey"] for r in again.orderBy("id").collect()]
    outcomes = again.select(F.col("id").alias("reverses"), "target", F.lit("written").alias("status"))
    back = journal.reversal_entries(again, outcomes, "revert_metadata", "2024-01-03T00:00:00Z")
    assert back.count() == 1000 and back.select("id").distinct().count() == 1000
    log.append(back)
    log.mark_undone(again.select("id"), "later still")
    log.compact()
    entries, broken = log.read()
    assert entries.groupBy("action", "undoneAt").count().count() == 3 and broken.count() == 2
    assert journal.last_session(entries, "update_metadata").isEmpty()
    assert entries.where("action = 'revert_metadata' and undoneAt is not null").isEmpty()


def test_link_entries(spark):
    ref = "struct<libraryID:int,itemKey:string,title:string,libraryName:string>"
    rows = [((1, "A", "t", None), (2, "B", "u", "L"), s, "at", "s", "uri:B", ["e"]) for s in ("removed", "link-missing")]
    got = journal.link_entries(spark.createDataFrame(rows, f"target {ref}, linked {ref}, status string, confirmedAt string, session string, uri string, evidence array<string>")).collect()
    assert sorted((r["action"], r["status"], r["uri"]) for r in got) == [("remove_link", "link-missing", None), ("remove_link", "removed", "uri:B")]


def test_import_refuses_and_aborts_before_the_first_row(spark, tmp_path):
    t = store(spark, tmp_path, [item(1), item(2, 1)])
    with pytest.raises(ValueError):
        execution.execute_import(t, plan(spark, (1, 5, "import")).drop("confirmed_at"), 1, "s")
    for how in ({"target": 2}, {"editable": False}, {"allow_writes": False}):
        got = execution.execute_import(t, plan(spark, (1, 5, "import")), 1, "s", **how)
        assert got.aborted and got.rows.isEmpty() and t.latest().number == 1
    none = execution.execute_import(t, plan(spark, (1, 5, "skip")), 1, "s")
    assert none.aborted is None and none.rows.isEmpty() and t.latest().number == 1


def test_import_checks_each_row_and_a_bad_one_costs_only_itself(spark, tmp_path):
    items = [item(1), item(2, version=6), item(4, deleted=True), item(5), item(6, title="boom"), item(7), item(8, linked=[(1, "K90")]), item(9), item(90, 1, linked=[(2, "K5")]), item(91, 1, deleted=True, linked=[(2, "K7")])]
    t = store(spark, tmp_path, items)
    seen = []

    def accept(copies):
        seen.append(sorted(r["title"] for r in copies.select("title").collect()))
        if not copies.where("title = 'boom'").isEmpty():
            raise OSError("disk full")

    got = execution.execute_import(t, plan(spark, *((n, 5, "import") for n in range(1, 9)), (9, 5, "skip")), 1, "2024-05-01 10:20", accept=accept)
    assert said(got) == {1: "created", 2: "stale-source", 3: "source-missing", 4: "source-missing", 5: "already-present", 6: "failed", 7: "created", 8: "already-present"}
    detail = {r["ordinal"]: r["detail"] or "" for r in got.rows.collect()}
    assert "5, now 6" in detail[2] and "gone" in detail[3] and "trash" in detail[4] and "K90" in detail[5] and "disk full" in detail[6]
    new = t.table(t.latest(), "items").where("ordinal > 91").collect()
    assert sorted((r["library_id"], r["item_key"], r["linked_items"][0]["item_key"], r["tags"], r["collection"]) for r in new) == [(1, f"copy of 2:K{n}", f"K{n}", None, "Imported/2024-05-01 10:20") for n in (1, 7)]
    assert len({r["ordinal"] for r in new}) == 2 and {r["new_key"] for r in got.rows.collect()} == {None, "copy of 2:K1", "copy of 2:K7"}
    # the same plan again: what was made is there
    again = execution.execute_import(t, plan(spark, (1, 5, "import"), (7, 5, "import")), 1, "s")
    assert set(said(again).values()) == {"already-present"}
    gone = execution.undo_import(t, spark.createDataFrame([(1, "copy of 2:K1"), (1, "K90"), (2, "K9")], "library_id int, item_key string"), 1)
    assert gone.count() == 2 and t.table(t.latest(), "items").where("deleted").count() == 4
    assert said(execution.execute_import(t, plan(spark, (1, 5, "import")), 1, "s")) == {1: "created"}  # its copy is in the trash


def test_a_source_that_changes_while_chunk_one_is_written_is_skipped_in_chunk_two(spark, tmp_path):
    t = store(spark, tmp_path, [item(n) for n in range(1, 6)])
    progress = []

    def accept(copies):
        if not progress and t.latest().number == 1:
            t.commit(t.latest(), changed={"items": t.table(t.latest(), "items").where("ordinal = 4").withColumn("version", F.lit(9).cast("long"))})

    got = execution.execute_import(t, plan(spark, *((n, 5, "import") for n in range(1, 6))), 1, "s", chunk=2, accept=accept, on_progress=lambda d, n: progress.append((d, n)))
    assert said(got) == {1: "created", 2: "created", 3: "created", 4: "stale-source", 5: "created"}
    assert progress == [(2, 5), (4, 5), (5, 5)] and got.chunks == 3
    assert t.table(t.latest(), "items").count() == 9


def test_cancel_between_chunks(spark, tmp_path):
    t = store(spark, tmp_path, [item(n) for n in range(1, 5)])
    done = []
    got = execution.execute_import(t, plan(spark, *((n, 5, "import") for n in range(1, 5))), 1, "s", chunk=2, should_cancel=lambda: bool(done), on_progress=lambda d, n: done.append(d))
    assert said(got) == {1: "created", 2: "created", 3: "cancelled", 4: "cancelled"} and got.chunks == 1
    assert got.totals(["created", "cancelled", "failed"]).first().asDict() == {"created": 2, "cancelled": 2, "failed": 0}


EDITS = "target long, field string, expected string, next string, source long, source_expected string, confirmed_at string"


def test_edits(spark, tmp_path):
    items = [item(n, 1) for n in range(1, 10)] + [item(20), item(21, deleted=True)]
    fields = [(n, f, "") for n in range(1, 10) for f in ("issue", "volume")] + [(20, "issue", "4"), (21, "issue", "4")]
    items[3] = item(4, 1, deleted=True)
    t = store(spark, tmp_path, items, fields)
    e = lambda *rows, at="now": spark.createDataFrame([(*r, at) for r in rows], EDITS)
    with pytest.raises(ValueError):
        execution.execute_edits(t, e((1, "issue", "", "4", 20, "4"), at=None), 1)
    with pytest.raises(ValueError):
        execution.execute_edits(t, e((20, "issue", "4", "5", None, None)), 1)
    assert execution.execute_edits(t, e((1, "issue", "", "4", 20, "4")), 1, editable=False).aborted
    rows = [
        (1, "issue", "", "4", 20, "4"), (1, "volume", "", "7", None, None), (2, "issue", "3", "4", 20, "4"), (3, "issue", "", "4", 20, "5"), (4, "issue", "", "4", 20, "4"),
        (5, "itemType", "", "map", None, None), (6, "issue", "", "4", 21, "4"), (7, "issue", "", "4", 20, "4"), (7, "issue", "", "5", None, None), (8, "issue", "", "boom", None, None), (9, "issue", "", "4", 20, "4"), (99, "issue", "", "4", 20, "4"),
    ]

    def accept(good):
        if not good.where("value = 'boom'").isEmpty():
            raise OSError("disk full")

    got = execution.execute_edits(t, e(*rows), 1, chunk=4, accept=accept)
    assert said(got) == {1: "written", 2: "target-changed", 3: "source-changed", 4: "target-missing", 5: "failed", 6: "source-changed", 7: "failed", 8: "failed", 9: "written", 99: "target-missing"}
    after = {(r[0], r[1]): r[2] for r in t.table(t.latest(), "fields").collect()}
    assert {k: v for k, v in after.items() if v and k[0] < 20} == {(1, "issue"): "4", (1, "volume"): "7", (9, "issue"): "4"}
    assert {r["ordinal"] for r in t.table(t.latest(), "items").where("library_id = 1 and version = 6").collect()} == {1, 9}
    back = changes.revert(e(*rows).where("target = 1")).selectExpr("*", "CAST(NULL AS BIGINT) AS source", "CAST(NULL AS STRING) AS source_expected", "'now' AS confirmed_at")
    assert said(execution.execute_edits(t, back, 1)) == {1: "written"}
    assert {v for k, v in {(r[0], r[1]): r[2] for r in t.table(t.latest(), "fields").collect()}.items() if k[0] == 1} == {""}


def test_links_of_home_records_that_are_there(spark, tmp_path):
    t = store(spark, tmp_path, [item(1, 1, linked=[(2, "K7")]), item(2, 1, deleted=True, linked=[(2, "K7")]), item(3, 3, linked=[(2, "K7")])])
    asked = spark.createDataFrame([(n, 2, "K7") for n in (1, 2, 3, 9)], "ordinal long, library_id int, item_key string")
    want = {1: "removed", 2: "target-missing", 3: "not-home", 9: "target-missing"}
    assert {r["ordinal"]: r["status"] for r in execution.change_links(t, asked, 1).collect()} == want
    assert {r["ordinal"]: len(r["linked_items"]) for r in t.table(t.latest(), "items").collect()} == {1: 0, 2: 1, 3: 1}
    assert {r["ordinal"]: r["status"] for r in execution.change_links(t, asked, 1, restore=True).collect()} == {**want, 1: "restored"}
    assert {r["ordinal"]: len(r["linked_items"]) for r in t.table(t.latest(), "items").collect()} == {1: 1, 2: 1, 3: 1}
