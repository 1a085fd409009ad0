"""Confirmed plans carried out on versioned tables, chunk by chunk: each chunk is checked against the newest
version and committed with it, or made anew from a newer one. A chunk that can't be written is taken
apart, so a row that fails costs only itself; a session can be cancelled between chunks.

The tables: items, by ordinal (library_id, item_key, version, deleted, item_type, title, linked_items and
others), and fields, by ordinal and field (value)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from ..plans.versions import Conflict, Tables, Version
from . import changes, previews

#: Where copies are filed, by the session's name.
COLLECTION = "Imported"


@dataclass
class Outcome:
    """aborted: why nothing at all was tried; rows: what became of each row; chunks: the numbers tried."""

    rows: DataFrame
    aborted: str | None = None
    chunks: int = 0

    def totals(self, statuses: list[str]) -> DataFrame:
        return changes.totals(self.rows, statuses)


def _never() -> bool:
    return False


def _guard(home: int, target: int, editable: bool, allow_writes: bool) -> str | None:
    if not allow_writes:
        return "writing is switched off"
    if target != home:
        return f"library {target} is not the home library"
    return None if editable else f"library {target} is read-only"


def _in_chunks(rows: DataFrame, unit: str, chunk: int, label: str) -> DataFrame:
    """rows with the number of their chunk, `chunk` units (such as targets) to each, in order."""
    units = rows.select(unit).distinct()
    part = Window.partitionBy("_part").orderBy(unit)
    # numbered by range partitions and their sizes, so no window holds them all
    ranged = stored(units.repartitionByRange(F.col(unit)).withColumn("_part", F.spark_partition_id()), f"{label}-units")
    before = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min(unit).alias("first")).withColumn("before", F.sum("n").over(Window.orderBy("first")) - F.col("n"))
    no = F.col("before") + F.row_number().over(part) - 1
    numbered = ranged.join(F.broadcast(before.select("_part", "before")), "_part").select(unit, F.floor(no / chunk).alias("chunk"))
    return stored(rows.join(numbered, unit), f"{label}-chunks")


def _run(rows: DataFrame, unit: str, write: Callable[[DataFrame], DataFrame], tell: Callable[[DataFrame, Column, Column], DataFrame], should_cancel: Callable[[], bool], on_progress: Callable[[int, int], None] | None) -> tuple[DataFrame | None, int]:
    """write: a chunk's rows -> what became of them, or an exception if none was written. tell: rows with a status
    and a detail. Of what can't be written the halves are tried, down to single units."""
    counts = {r["chunk"]: r["n"] for r in rows.groupBy("chunk").agg(F.count_distinct(unit).alias("n")).collect()}
    total, done, tried, out = sum(counts.values()), 0, 0, []

    def attempt(some: DataFrame, n: int) -> list[DataFrame]:
        try:
            return [write(some)]
        except Conflict:
            raise
        except Exception as e:  # whatever the writer says is the row's own fault, or its neighbour's
            if n == 1:
                return [tell(some, F.lit("failed"), F.lit(f"{type(e).__name__}: {e}"[:300]))]
            middle = some.select(unit).distinct().approxQuantile(unit, [0.5], 0.0)[0]
            low = some.where(F.col(unit) <= middle)
            k = low.select(unit).distinct().count()
            return attempt(low, k) + attempt(some.where(F.col(unit) > middle), n - k)

    for number in sorted(counts):
        if should_cancel():
            out.append(tell(rows.where(F.col("chunk") >= number), F.lit("cancelled"), F.lit("The session ended before this row; nothing was written for it.")))
            break
        out += attempt(rows.where(F.col("chunk") == number), counts[number])
        tried, done = tried + 1, done + counts[number]
        if on_progress:
            on_progress(done, total)
    whole = None
    for part in out:
        whole = part if whole is None else whole.unionByName(part)
    return whole, tried


IMPORTED = "ordinal long, status string, detail string, new_ordinal long, new_key string"


def execute_import(
    store: Tables, plan: DataFrame, home: int, session: str, *, target: int | None = None, copy_tags: bool = False, chunk: int = changes.CHUNK, editable: bool = True, allow_writes: bool = True,
    accept: Callable[[DataFrame], None] | None = None, should_cancel: Callable[[], bool] = _never, on_progress: Callable[[int, int], None] | None = None,
) -> Outcome:
    """Copies of the plan's confirmed rows (ordinal, version, decision, confirmed_at) into home, each linked to
    its source and filed under the session. IMPORTED tells what became of each: created, stale-source,
    source-missing, already-present, failed or cancelled.

    A plan that nobody confirmed is a ValueError; a target that may not be written aborts before the first
    row. accept: sees a chunk's copies before they are committed and raises if it won't have them."""
    wanted = previews.rows_to_import(plan).select("ordinal", "version", "decision")
    spark = store.spark
    if why := _guard(home, home if target is None else target, editable, allow_writes):
        return Outcome(spark.createDataFrame([], IMPORTED), why)
    rows = _in_chunks(wanted, "ordinal", chunk, "import")

    def write(some: DataFrame) -> DataFrame:
        def make(base: Version | None) -> tuple[dict | None, DataFrame]:
            items = store.table(base, "items")
            mine = items.join(some.select("ordinal"), "ordinal", "left_semi").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
            ref = F.struct(F.col("library_id").cast("int").alias("library_id"), "item_key")
            at_home = items.where((F.col("library_id") == home) & ~F.coalesce("deleted", F.lit(False)))
            # linked on either side: a home record names the source, or the source a home record
            named = at_home.select(F.explode("linked_items").alias("ref"), "item_key").join(mine.select("ordinal", ref.alias("ref")), "ref").select("ordinal", "item_key")
            names = mine.select("ordinal", F.explode("linked_items").alias("ref")).join(at_home.select(ref.alias("ref"), "item_key"), "ref").select("ordinal", "item_key")
            linked = named.unionByName(names).groupBy("ordinal").agg(F.min("item_key").alias("there"))
            said = changes.precheck(some, mine, linked).join(mine.select("ordinal", F.col("version").alias("now"), "deleted"), "ordinal", "left").join(some.select("ordinal", "version"), "ordinal").join(linked, "ordinal", "left")
            detail = (
                F.when(F.col("status") == "stale-source", F.concat(F.lit("The source changed since it was read: version "), F.col("version"), F.lit(", now "), F.col("now"), F.lit(".")))
                .when(F.col("status") == "source-missing", F.when(F.col("deleted"), "The source is in the trash.").otherwise("The source is gone."))
                .when(F.col("status") == "already-present", F.concat(F.lit("Home has "), F.col("there"), F.lit(", which is linked to it.")))
            )
            last = items.agg(F.coalesce(F.max("ordinal"), F.lit(0))).first()[0]
            good = F.when(F.col("status") == "created", 1).otherwise(0)
            number = F.when(F.col("status") == "created", F.lit(last) + F.sum(good).over(Window.orderBy("ordinal")))  # a chunk's rows
            said = stored(said.select("ordinal", "status", detail.alias("detail"), number.cast("long").alias("new_ordinal")), "import-said")
            copies = changes.created_items(said.where("status = 'created'").select("ordinal", "new_ordinal"), items, home)
            if "tags" in items.columns and not copy_tags:
                copies = copies.withColumn("tags", F.lit(None).cast(dict(items.dtypes)["tags"]))
            if "collection" in items.columns:
                copies = copies.withColumn("collection", F.lit(f"{COLLECTION}/{session}"))
            copies = stored(copies.withColumn("deleted", F.lit(False)).select(*items.columns), "import-copies")
            outcome = said.join(copies.select(F.col("ordinal").alias("new_ordinal"), F.col("item_key").alias("new_key")), "new_ordinal", "left").select(*(x.split(" ")[0] for x in IMPORTED.split(", ")))
            if copies.isEmpty():
                return None, outcome
            if accept:
                accept(copies)
            return {"changed": {"items": copies}}, outcome

        return store.update(make)[1]

    none = F.lit(None)
    tell = lambda some, status, detail: some.select("ordinal", status.alias("status"), detail.alias("detail"), none.cast("long").alias("new_ordinal"), none.cast("string").alias("new_key"))
    out, tried = _run(rows, "ordinal", write, tell, should_cancel, on_progress)
    return Outcome(spark.createDataFrame([], IMPORTED) if out is None else out, None, tried)


FILLED = "target long, status string, detail string"


def execute_edits(
    store: Tables, edits: DataFrame, home: int, *, names: DataFrame | None = None, chunk: int = changes.CHUNK, editable: bool = True, allow_writes: bool = True,
    accept: Callable[[DataFrame], None] | None = None, should_cancel: Callable[[], bool] = _never, on_progress: Callable[[int, int], None] | None = None,
) -> Outcome:
    """Confirmed edits (target, field, expected, next, source, source_expected, confirmed_at) of home records,
    `chunk` targets to a commit; a source's value is checked where source is there. FILLED tells of each target:
    written, target-changed, source-changed, target-missing, failed (what may never be written, or not twice,
    too) or cancelled.

    Edits that nobody confirmed are a ValueError, as are targets outside home, before anything is read for
    writing. A written target's version rises by one."""
    spark = store.spark
    if "confirmed_at" not in edits.columns or not edits.where("confirmed_at is null").isEmpty():
        raise ValueError("edits that nobody confirmed")
    base = store.latest()
    foreign = edits.select("target").distinct().join(store.table(base, "items").where(F.col("library_id") != home).select(F.col("ordinal").alias("target")), "target")
    if not foreign.isEmpty():
        raise ValueError("edits of records outside the home library")
    if why := _guard(home, home, editable, allow_writes):
        return Outcome(spark.createDataFrame([], FILLED), why)
    rows = _in_chunks(edits, "target", chunk, "edits")

    def write(some: DataFrame) -> DataFrame:
        def make(base: Version | None) -> tuple[dict | None, DataFrame]:
            items, fields = store.table(base, "items"), store.table(base, "fields")
            alive = items.where(~F.coalesce("deleted", F.lit(False)))
            checks = some.where("source is not null").select("target", "source", F.coalesce("source_field", "field").alias("field") if "source_field" in some.columns else "field", F.col("source_expected").alias("expected"))
            outcome, good = changes.checked_edits(fields, some.select("target", "field", "expected", "next"), checks, alive, items, home, names)
            outcome, good = stored(outcome, "edits-said"), stored(good, "edits-good")
            said = outcome.select("target", F.when(F.col("status") == "refused", "failed").otherwise(F.col("status")).alias("status"), "detail")
            if good.isEmpty():
                return None, said
            if accept:
                accept(good)
            written = items.join(good.select("ordinal").distinct(), "ordinal", "left_semi").withColumn("version", F.col("version") + 1)
            return {"changed": {"fields": good, "items": stored(written, "edits-items")}}, said

        return store.update(make)[1]

    tell = lambda some, status, detail: some.select("target", status.alias("status"), detail.alias("detail")).distinct()
    out, tried = _run(rows, "target", write, tell, should_cancel, on_progress)
    return Outcome(spark.createDataFrame([], FILLED) if out is None else out, None, tried)


def undo_import(store: Tables, refs: DataFrame, home: int) -> DataFrame:
    """The items that an import made (library_id, item_key) in the trash, in one commit; those that went there."""

    def make(base: Version | None) -> tuple[dict | None, DataFrame]:
        items = store.table(base, "items")
        mine = items.where((F.col("library_id") == home) & ~F.coalesce("deleted", F.lit(False))).join(refs.select("library_id", "item_key").distinct(), ["library_id", "item_key"], "left_semi")
        gone = stored(mine.withColumn("deleted", F.lit(True)).select(*items.columns), "undo-items")
        return (None if gone.isEmpty() else {"changed": {"items": gone}}), gone.select("ordinal", "library_id", "item_key")

    return store.update(make)[1]


def change_links(store: Tables, links: DataFrame, home: int, restore: bool = False) -> DataFrame:
    """Links (ordinal, library_id, item_key) of home records removed, or put back, in one commit, with a status."""

    def make(base: Version | None) -> tuple[dict | None, DataFrame]:
        items = store.table(base, "items")
        said, after = (changes.restore_links if restore else changes.remove_links)(items, links, home)
        said = stored(said, "links-said")
        hit = said.where(F.col("status").isin("removed", "restored")).select("ordinal").distinct()
        changed = stored(after.join(hit, "ordinal", "left_semi").select(*items.columns), "links-items")
        return (None if changed.isEmpty() else {"changed": {"items": changed}}), said

    return store.update(make)[1]
