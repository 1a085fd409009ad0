"""Records as their types have them: wide rows whose columns are the types' own names of fields, read into
the long form that comparisons take and written back, and libraries read together at pinned versions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import changes, linkage
from ..operators.difference import FIELDS
from ..plans.versions import Tables, Version


def field_rows(records: DataFrame, names: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """ordinal, field, name, value, key of the records (ordinal, item_type, and a column for each own name) that refs
    (ordinal) selects. names: item_type, name, base, a row for each field that a type has, so a field it
    lacks has no row and one it has an empty value at least; it is as small as the types' schema.

    A date is stored as its sortable form, a space and what was typed: the key is the former, the value the
    latter, or the sortable form alone."""
    own = [r["name"] for r in names.select("name").distinct().collect() if r["name"] in records.columns]
    if refs is not None:  # before the rows are made many
        records = records.join(refs.select("ordinal").distinct(), "ordinal", "left_semi")
    long = records.select("ordinal", "item_type", F.stack(F.lit(len(own)), *(x for c in own for x in (F.lit(c), F.col(f"`{c}`").cast("string")))).alias("name", "raw"))
    rows = long.join(F.broadcast(names.where(F.col("base").isin(FIELDS)).select("item_type", "name", "base").distinct()), ["item_type", "name"])
    raw = F.coalesce("raw", F.lit(""))
    stored_date = (F.col("base") == "date") & raw.rlike(r"^\d{4}-\d{2}-\d{2}( |$)")
    typed = F.when(F.length(raw) > 11, F.substring(raw, 12, 1 << 20)).otherwise(F.substring(raw, 1, 10))
    return rows.select("ordinal", F.col("base").alias("field"), "name", F.when(stored_date, typed).otherwise(raw).alias("value"), F.when(stored_date, F.substring(raw, 1, 10)).alias("key"))


def own_names(edits: DataFrame, items: DataFrame, names: DataFrame) -> DataFrame:
    """edits (target, field, ...) with name, the target type's own name of the field; none where the type lacks it."""
    kinds = items.select(F.col("ordinal").alias("target"), "item_type")
    own = F.broadcast(names.select("item_type", F.col("base").alias("field"), "name").distinct())
    return edits.drop("name").join(kinds, "target", "left").join(own, ["item_type", "field"], "left").drop("item_type")


def written(records: DataFrame, values: DataFrame) -> DataFrame:
    """The wide records after values (ordinal, name, value) were written; names that are no column are ignored."""
    per = values.groupBy("ordinal").agg(F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("value", F.lit(""))))).alias("_new"))
    rows = records.join(per, "ordinal", "left")
    fixed = {"ordinal", "item_type"}
    new = lambda c: F.coalesce(F.try_element_at("_new", F.lit(c)), F.col(f"`{c}`").cast("string"))
    return rows.select(*(F.col(f"`{c}`") if c in fixed or kind != "string" else new(c).alias(c) for c, kind in records.dtypes))


@dataclass
class Scan:
    """libraries: library_id, name, version, local_change, pinned before anything was read; items: the eligible
    records of all of them."""

    libraries: DataFrame
    items: DataFrame


def pinned(libraries: Mapping[int, Tables]) -> dict[int, Version]:
    """The versions that a scan will read; libraries without one have nothing to read."""
    found = {k: tables.latest() for k, tables in libraries.items()}
    return {k: v for k, v in found.items() if v is not None}


def scan(libraries: Mapping[int, Tables], shelf: DataFrame, pins: Mapping[int, Version] | None = None) -> Scan:
    """One read of all libraries at their pinned versions. libraries: the tables of each, whose `items` may lack
    columns that others have; shelf: library_id, library_name, library_type. Libraries that are neither a
    person's nor a group's are not opened. What is edited after the versions were pinned isn't read, and
    makes its library look changed to `changes.stale_libraries`."""
    kinds = shelf.where(F.col("library_type").isin("user", "group")).select("library_id", "library_name", "library_type")
    read = {r["library_id"]: r["library_name"] for r in kinds.collect() if r["library_id"] in libraries}  # a row a library
    pins = {k: v for k, v in (pinned(libraries) if pins is None else pins).items() if k in read}
    if not pins:
        raise ValueError("no library to read")
    parts = [libraries[k].table(v, "items").withColumn("library_id", F.lit(k).cast("int")) for k, v in sorted(pins.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    spark = shelf.sparkSession
    marks = spark.createDataFrame([(k, read[k], v.number) for k, v in sorted(pins.items())], "library_id int, name string, version long")
    prints = changes.fingerprint(rows) if "modified" in rows.columns else rows.select("library_id", F.lit(None).cast("string").alias("local_change")).distinct()
    flags: dict[str, Column] = {"is_regular": F.lit(True), "top_level": F.lit(True), "deleted": F.lit(False)}
    for c, usual in flags.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), usual) if c in rows.columns else usual)
    items = linkage.scan(rows, kinds)
    return Scan(marks.join(prints, "library_id", "left"), items)


def stale(before: Scan, libraries: Mapping[int, Tables], shelf: DataFrame) -> DataFrame:
    """library_id and why: what has changed since a scan."""
    return changes.stale_libraries(before.libraries, scan(libraries, shelf).libraries)
