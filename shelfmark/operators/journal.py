"""The log of sessions: JSON lines in segments, one for each append, read back with malformed lines apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.storage import stored
from ..plans.versions import Tables, Version

#: Fixed values.
ACTIONS = ["import", "undo", "update_metadata", "revert_metadata", "remove_link", "restore_link"]
UNDOABLE = ["import", "update_metadata", "remove_link"]
LINES, MARKS = "segment long, line long, value string", "id string, undoneAt string"
REF = "struct<libraryID:int,itemKey:string,title:string,libraryName:string>"
ENTRY = (
    f"id string, action string, confirmedAt string, at string, session string, status string, detail string, target {REF}, linked {REF}, uri string, reverses string, "
    "changes array<struct<field:string,name:string,old:string,new:string,class:string,source:struct<libraryID:int,itemKey:string,libraryName:string>>>, "
    "rows array<struct<source:struct<libraryID:int,itemKey:string,version:bigint,title:string>,created:struct<libraryID:int,itemKey:string>,skipped:string,failed:string>>, "
    "trashed array<struct<libraryID:int,itemKey:string>>, evidence array<string>, undoneAt string"
)


def entry_id(at: Column, seed: Column) -> Column:
    """A time and a seed's 64-bit hash: entries sort by time, and those of one time differ by their seeds."""
    return F.concat(at, F.lit("-"), F.lpad(F.lower(F.hex(F.xxhash64(seed))), 16, "0"))


def session_name(confirmed_at: Column) -> Column:
    """2026-09-17T14:32:05.123Z as 2026-09-17 14:32."""
    return F.regexp_replace(F.regexp_replace(confirmed_at, "T", " "), r":\d\d(\.\d+)?Z$", "")


def import_entries(rows: DataFrame) -> DataFrame:
    """One entry for each session of import outcomes: session, confirmedAt, no (the order of the rows),
    source (libraryID, itemKey, version, title), status, detail, created (libraryID, itemKey). Rows skipped
    say why, cancelled ones that nothing was written."""
    skipped = F.when(F.col("status") == "cancelled", F.lit("cancelled: the session ended before this row; nothing was written.")).when(~F.col("status").isin("created", "failed"), F.concat_ws(": ", "status", "detail"))
    row = F.struct("source", F.when(F.col("status") == "created", F.col("created")).alias("created"), skipped.alias("skipped"), F.when(F.col("status") == "failed", F.col("detail")).alias("failed"))
    out = rows.groupBy("session", "confirmedAt").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    return out.select(entry_id(F.col("confirmedAt"), F.col("session")).alias("id"), F.lit("import").alias("action"), "confirmedAt", "session", "rows")


def metadata_entries(outcomes: DataFrame) -> DataFrame:
    """An entry for each target of a change set: target, status, confirmedAt, session, changes, evidence;
    changes stay only where they were written."""
    none = F.array().cast(dict(outcomes.dtypes)["changes"])
    return outcomes.select(entry_id(F.col("confirmedAt"), F.concat_ws(":", "target.libraryID", "target.itemKey")).alias("id"), F.lit("update_metadata").alias("action"), "confirmedAt", "session", "status", "target", F.when(F.col("status") == "written", F.col("changes")).otherwise(none).alias("changes"), "evidence")


def link_entries(outcomes: DataFrame) -> DataFrame:
    """An entry for each link removal tried: target, linked, status, confirmedAt, session, uri, evidence; the
    uri stays only where it was removed."""
    seed = F.concat_ws(":", "target.libraryID", "target.itemKey", "linked.libraryID", "linked.itemKey")
    return outcomes.select(entry_id(F.col("confirmedAt"), seed).alias("id"), F.lit("remove_link").alias("action"), "confirmedAt", "session", "status", "target", "linked", F.when(F.col("status") == "removed", F.col("uri")).alias("uri"), "evidence")


def reversal_entries(entries: DataFrame, outcomes: DataFrame, action: str, at: str) -> DataFrame:
    """For each entry taken back (outcomes: reverses, status, and target where entries may share an id) what
    became of it: an undo, a revert_metadata or a restore_link entry."""
    on = ["reverses", *(["target"] if "target" in outcomes.columns else [])]
    rows = entries.select(F.col("id").alias("reverses"), *on[1:]).join(outcomes, on)
    return rows.select(entry_id(F.lit(at), F.col("reverses")).alias("id"), F.lit(action).alias("action"), "reverses", F.lit(at).alias("at"), "status")


def serialized(entries: DataFrame) -> DataFrame:
    """value: each entry as one JSON line, absent parts left out."""
    return entries.select(F.to_json(F.struct(*entries.columns)).alias("value"))


def append(entries: DataFrame, path: str) -> None:
    """Adds the entries to a folder of plain lines in one job; `Log` keeps their order and what was undone."""
    serialized(entries).write.mode("append").text(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The entries and the malformed lines of a folder of plain lines; both empty where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return parse(spark.read.text(path) if there else spark.createDataFrame([], "value string"))


class Log:
    """A log in a shared folder. An append is a segment, and a line's place is its segment and its number in
    it; lines are never rewritten but by `compact`, as marks of what was undone are rows of their own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.tables = spark, Tables(spark, path)

    def append(self, entries: DataFrame) -> None:
        """All entries, in the order of their ids, or none: one commit."""
        self.append_lines(serialized(entries.orderBy("id")))

    def append_lines(self, lines: DataFrame) -> None:
        """value: lines of a log, well formed or not."""

        def make(base: Version | None) -> tuple[dict, None]:
            rows = lines.select(F.lit(base.number + 1 if base else 1).cast("long").alias("segment"), F.monotonically_increasing_id().alias("line"), "value")
            if base is not None:
                return {"changed": {"lines": rows}}, None
            none = self.spark.createDataFrame([], MARKS)
            return {"whole": {"lines": rows, "marks": none, "malformed": rows.limit(0)}, "keys": {"lines": [], "marks": ["id"], "malformed": []}}, None

        self.tables.update(make)

    def read(self) -> tuple[DataFrame, DataFrame]:
        """The entries, with segment and line, and the malformed lines; both empty where there is no log."""
        version = self.tables.latest()
        if version is None:
            return parse(self.spark.createDataFrame([], LINES))
        entries, malformed = parse(self.tables.table(version, "lines"))
        marks = self.tables.table(version, "marks").withColumnRenamed("undoneAt", "mark")
        mark = F.when(F.col("action").isin(UNDOABLE), F.col("mark"))
        entries = entries.join(marks, "id", "left").withColumn("undoneAt", F.coalesce(mark, "undoneAt")).select(*entries.columns)
        return entries, malformed.unionByName(self.tables.table(version, "malformed"))

    def mark_undone(self, ids: DataFrame, at: str) -> None:
        """The undoable entries with these ids (id) are undone at that time."""
        rows = ids.select("id", F.lit(at).alias("undoneAt")).distinct()
        self.tables.update(lambda base: (None if base is None else {"changed": {"marks": rows}}, None))

    def compact(self) -> None:
        """One folder of well-formed lines, with the marks in them, in their places; malformed ones apart."""

        def make(base: Version | None) -> tuple[dict | None, None]:
            if base is None:
                return None, None
            entries, malformed = self.read()
            value = F.to_json(F.struct(*(c for c in entries.columns if c not in ("segment", "line"))))
            return {"whole": {"lines": entries.select("segment", "line", value.alias("value")), "malformed": malformed.select("segment", "line", "value"), "marks": self.spark.createDataFrame([], MARKS)}}, None

        self.tables.update(make)


def parse(lines: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries, and the malformed lines, of lines of JSON (value; other columns stay); blank lines are neither. keep:
    what was read is stored, so that no line is read again for each use of them."""
    place = [c for c in lines.columns if c != "value"]
    rows = lines.where(t.trimmed(F.col("value")) != "").withColumn("e", F.from_json("value", ENTRY))
    rows = rows.withColumn("good", F.coalesce(F.col("e.id").isNotNull() & F.col("e.action").isin(ACTIONS), F.lit(False)))
    if keep:
        rows = stored(rows.withColumn("value", F.when(~F.col("good"), F.col("value"))), "parsed")
    return rows.where("good").select(*place, "e.*"), rows.where("not good").select(*place, "value")


def mark_undone(entries: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("hit")).distinct()
    return entries.join(hit, "id", "left").withColumn("undoneAt", F.when(F.col("hit") & F.col("action").isin(UNDOABLE), F.lit(at)).otherwise(F.col("undoneAt"))).drop("hit")


def last_session(entries: DataFrame, action: str) -> DataFrame:
    """The entries that one undo of this action takes back: all of the latest session that is not undone. Of
    metadata only written ones with changes count, of links only removed ones with their uri; an entry
    without a session is one of its own. The latest is the one that stands last in the log; entries without
    a place stand by their ids."""
    done = F.lit(True)
    if action == "update_metadata":
        done = (F.col("status") == "written") & (F.size("changes") > 0)
    if action == "remove_link":
        done = (F.col("status") == "removed") & F.col("uri").isNotNull()
    left = entries.where((F.col("action") == action) & F.col("undoneAt").isNull() & done).withColumn("unit", F.coalesce("session", "id"))
    place = F.struct("segment", "line") if "segment" in entries.columns else F.col("id")
    last = left.agg(F.max_by("unit", place).alias("unit"))
    return left.join(last, "unit", "left_semi").drop("unit")


def created_refs(entries: DataFrame) -> DataFrame:
    """libraryID, itemKey of the items that import entries made."""
    return entries.where("action = 'import'").select(F.explode("rows").alias("row")).where("row.created is not null").select("row.created.*")


def reverting_edits(entries: DataFrame) -> DataFrame:
    """libraryID, itemKey, field, expected, next: the old value back where the new one still stands."""
    rows = entries.where("action = 'update_metadata'").select("target", F.explode("changes").alias("c"))
    return rows.select("target.libraryID", "target.itemKey", F.col("c.name").alias("field"), F.col("c.new").alias("expected"), F.col("c.old").alias("next"))
