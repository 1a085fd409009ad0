"""The persisted index of works: references only, rebuilt by an audit, and found stale by fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.versions import Tables, Version
from . import linkage

VERSION = 1
META, LIBRARIES, WORKS = "schemaVersion int, scannedAt string", "library_id int, name string, version bigint, local_change string", "id string, confidence string, canonical struct<library_id:int,item_key:string,version:bigint>, items array<struct<library_id:int,item_key:string,version:bigint>>"


@dataclass
class Snapshot:
    scanned_at: str
    libraries: DataFrame
    works: DataFrame


def create(items: DataFrame, works: DataFrame, libraries: DataFrame, scanned_at: str) -> Snapshot:
    """works: ordinal, work, confidence. libraries: library_id, name, version, local_change, taken before the
    items were read, so an edit in between makes the snapshot look stale and never fresh."""
    ref = F.struct(F.col("library_id").cast("int").alias("library_id"), "item_key", F.col("version").cast("long").alias("version"))
    rows = works.join(items.select("ordinal", ref.alias("ref"), linkage.link_key(F.col("library_id"), F.col("item_key")).alias("key"), t.type_rank(F.col("item_type")).alias("rank")), "ordinal")
    out = rows.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("key", "ref"))).alias("members"), F.max("confidence").alias("confidence"), F.min_by("ref", F.struct("rank", "key")).alias("canonical"))
    ids, refs = F.array_join(F.transform("members", lambda m: m["key"]), "|"), F.transform("members", lambda m: m["ref"])
    shelf = libraries.select(F.col("library_id").cast("int").alias("library_id"), "name", F.col("version").cast("long").alias("version"), "local_change")
    return Snapshot(scanned_at, shelf, out.select(ids.alias("id"), "confidence", "canonical", refs.alias("items")))


def save(snapshot: Snapshot, path: str) -> None:
    """A new generation: its tables first, the manifest last, so a save that dies leaves the one before."""
    note = {"schemaVersion": VERSION, "scannedAt": snapshot.scanned_at}
    change = {"whole": {"works": snapshot.works, "libraries": snapshot.libraries}, "note": note}
    Tables(snapshot.works.sparkSession, path).update(lambda _: (change, None))


def is_snapshot(tables: Tables, version: Version) -> bool:
    """Of this version and shape."""
    note, said = version.note, version.tables
    if note.get("schemaVersion") != VERSION or not isinstance(note.get("scannedAt"), str) or not {"works", "libraries"} <= said.keys():
        return False
    return all(_shape(tables.table(version, name)) == shape for name, shape in (("libraries", LIBRARIES), ("works", WORKS)))


def _shape(rows: DataFrame) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)


def load(spark: SparkSession, path: str) -> Snapshot | None:
    """The newest generation whose manifest and files are whole. None where there is none, where it is not of
    this version and shape, or where a program of another version has put its meta row beside it."""
    tables = Tables(spark, path)
    version = tables.latest(sound=True)
    if version is None or not is_snapshot(tables, version) or not tables.foreign_rows("meta", META).where(F.coalesce(F.col("schemaVersion"), F.lit(0)) != VERSION).isEmpty():
        return None
    return Snapshot(version.note["scannedAt"], tables.table(version, "libraries"), tables.table(version, "works"))


def work_for(snapshot: Snapshot, refs: DataFrame) -> DataFrame:
    """refs (library_id, item_key) with the id, the items and the confidence of their work, absent if unknown,
    the names of the other libraries that hold it, sorted, and the copies in the ref's own library."""
    of = snapshot.works.select("id", "confidence", "items", F.explode("items").alias("i")).select("id", "confidence", "items", "i.library_id", "i.item_key")
    rows = refs.select("library_id", "item_key").join(of, ["library_id", "item_key"], "left")
    other = rows.select("library_id", "item_key", F.explode(F.array_distinct(F.transform("items", lambda i: i["library_id"]))).alias("other")).where("other <> library_id")
    name = F.coalesce("name", F.concat(F.lit("Library "), F.col("other").cast("string")))
    names = other.join(snapshot.libraries.select(F.col("library_id").alias("other"), "name"), "other", "left").groupBy("library_id", "item_key").agg(F.array_sort(F.collect_list(name)).alias("also_in"))
    here = F.coalesce(F.size(F.filter("items", lambda i: i["library_id"] == F.col("library_id"))), F.lit(1))
    here = F.when(F.col("id").isNull(), 1).otherwise(here)
    return rows.join(names, ["library_id", "item_key"], "left").select("library_id", "item_key", "id", "confidence", "items", F.coalesce("also_in", F.array().cast("array<string>")).alias("also_in"), here.alias("copies_here"))
