"""Field differences between a record and its strong partners, in long form: one row per target, field
and source value. Only direct pairs count, never members of a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.storage import stored
from .linkage import Partners

#: Fixed values, in report order.
FIELDS = ["title", "abstractNote", "publicationTitle", "journalAbbreviation", "volume", "issue", "pages", "date", "DOI", "ISBN", "ISSN", "url", "publisher", "place", "edition", "language", "rights"]
UNVERIFIED = ["DOI", "ISBN", "ISSN"]


def field_key(field: Column, value: Column) -> Column:
    """What two values of a field are compared by."""
    compact = F.regexp_replace(F.regexp_replace(F.lower(value), "[‐-―−]", "-"), r"(?U)\s+", "")
    plain = t.normalized_text(value)
    return (
        F.when(field == "DOI", F.coalesce(t.doi(value), plain))
        .when(field == "ISBN", F.coalesce(t.isbn13(value), plain))
        .when(field == "ISSN", F.regexp_replace(F.upper(value), "[^0-9X]", ""))
        .when(field == "creators", value)
        .when(field.isin("date", "url"), t.trimmed(value))
        .when(field.isin("volume", "issue", "pages", "edition"), compact)
        .otherwise(plain)
    )


def strong_partners(matches: DataFrame, items: DataFrame, home: int) -> DataFrame:
    """target (in home) and source (elsewhere) of each confirmed exact or high pair, once."""
    strong = matches.where("verdict = 'match' and tier in ('exact', 'high')").select("l_ordinal", "r_ordinal")
    both = strong.select(F.col("l_ordinal").alias("target"), F.col("r_ordinal").alias("source")).unionByName(strong.select(F.col("r_ordinal").alias("target"), F.col("l_ordinal").alias("source")))
    lib = items.select("ordinal", "library_id")
    own = both.join(lib.where(F.col("library_id") == home).select(F.col("ordinal").alias("target")), "target", "left_semi")
    return own.join(lib.where(F.col("library_id") != home).select(F.col("ordinal").alias("source")), "source", "left_semi").distinct()


def creators_texts(creators: Column) -> Column:
    """Name or last name, and first name of each creator (creator_type, name, last_name, first_name), not
    yet decomposed."""
    return F.flatten(F.transform(creators, lambda c: F.array(t.without_markup(F.coalesce(c["name"], c["last_name"], F.lit(""))), t.without_markup(F.coalesce(c["first_name"], F.lit(""))))))


def creators_key(creators: Column, texts: Column) -> Column:
    """What two lists of creators are compared by: order, type, name and whole first name, folded. texts: a
    column with their creators_texts, decomposed."""
    part = lambda c, i: F.concat_ws("|", c["creator_type"], t.folded(F.get(texts, 2 * i)), t.folded(F.get(texts, 2 * i + 1)))
    return F.array_join(F.transform(creators, part), "||")


def _precision(a: Column, b: Column) -> Column:
    """Of two dates' keys, whose unknown parts are zeros: which one says more, where they agree."""
    fits = lambda x, y: F.forall(F.sequence(F.lit(0), F.size(F.split(x, "-")) - 1), lambda i: F.get(F.split(x, "-"), i).rlike("^0+$") | F.coalesce(F.get(F.split(x, "-"), i) == F.get(F.split(y, "-"), i), F.lit(False)))
    return F.when(fits(a, b) & ~fits(b, a), "The source's date is more precise.").when(fits(b, a) & ~fits(a, b), "The home library's date is more precise.")


def shortened(text: Column) -> Column:
    return F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("…"))).otherwise(text)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), shortened(text), F.lit('"'))


_GROUP = "array<struct<first:bigint,key:string,value:string,name:string,sources:array<bigint>,raws:array<struct<source:bigint,value:string>>,kinds:array<string>>>"


def _units(partners: DataFrame | Partners) -> Partners:
    return partners if isinstance(partners, Partners) else Partners.of(partners)


def compare(partners: DataFrame | Partners, fields: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """target, field, class, missing_in, target_value, target_name, alternatives (value, name, sources of
    each other key, by the first source), their number and first value, not_offered and why_not, notes,
    format_only.

    partners: pairs (target, source), or in units, which are compared once for all targets that they hold; of
    an alternative's sources there is then the first one of each value and label.

    fields: ordinal, field, value; a field the type lacks has no row, an empty or absent one a blank value. Optional
    columns: name (the type's own name of the field, else the field's), key (what to compare by, such as a
    date's stored form), kinds (of a list of creators, field 'creators', their types). records (ordinal,
    item_type, creator_types) tells of a target which types of creator it takes; a list with another one
    is not offered. Only the fields of records in a pair are read."""
    for c, kind in (("name", "string"), ("key", "string"), ("kinds", "array<string>")):
        if c not in fields.columns:
            fields = fields.withColumn(c, F.lit(None).cast(kind))
    pairs, targets, sources = _units(partners)
    refs = targets.select("ordinal").unionByName(sources.select("ordinal")).distinct()
    fields = fields.join(refs, "ordinal", "left_semi")
    keyed = fields.withColumns({"name": F.coalesce("name", "field"), "value": F.coalesce("value", F.lit(""))}).withColumn("key", F.when(t.trimmed(F.col("value")) != "", F.coalesce("key", field_key(F.col("field"), F.col("value")))))
    keyed = stored(keyed.select("ordinal", "field", "name", "value", "key", "kinds"), "keyed-fields")  # both sides read it, keyed once
    mine = keyed.join(targets.select("ordinal"), "ordinal", "left_semi").select(F.col("ordinal").alias("target"), "field", F.col("name").alias("target_name"), F.col("value").alias("target_value"), F.col("key").alias("target_key"))
    same = ["field", "name", "key", "value", "kinds", "label"]
    theirs = sources.join(keyed.where("key is not null"), "ordinal").groupBy(F.col("unit").alias("source_unit"), *same).agg(F.min("ordinal").alias("first"))
    theirs = pairs.join(theirs, "source_unit").select("target_unit", *same, "first").repartition("target_unit")  # what follows is by target, shuffled once
    theirs = theirs.groupBy("target_unit", *same).agg(F.min("first").alias("first"))
    raws = F.array_sort(F.collect_list(F.struct(F.col("first").alias("source"), "value")))
    groups = theirs.groupBy("target_unit", "field", "key").agg(F.min_by("value", "first").alias("value"), F.min_by("name", "first").alias("name"), F.array_sort(F.collect_list("first")).alias("sources"), raws.alias("raws"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"), F.min("first").alias("first"))
    per = groups.groupBy("target_unit", "field").agg(F.array_sort(F.collect_list(F.struct("first", "key", "value", "name", "sources", "raws", "kinds"))).cast(_GROUP).alias("groups"))
    per = per.join(targets.select(F.col("unit").alias("target_unit"), F.col("ordinal").alias("target")), "target_unit").drop("target_unit")
    rows = mine.join(per, ["target", "field"], "full_outer")
    has = F.col("target_key").isNotNull()
    n = F.when(F.col("groups").isNull(), 0).otherwise(F.size("groups"))
    rows = rows.withColumn("n", n).withColumn("other", F.filter(F.coalesce("groups", F.array().cast(_GROUP)), lambda g: F.coalesce(g["key"] != F.col("target_key"), F.lit(True))))
    n = F.col("n")
    kind = F.when(has & (n == 0), "MISSING").when(~has & (n == 1), "MISSING").when(~has & (n > 1), "CONFLICTING").when(has & (F.size("other") == 0), "IDENTICAL").when(has & (n == 1), "DIFFERENT").when(has & (n > 1), "CONFLICTING")
    rows = rows.withColumn("class", kind).where("class is not null")
    if records is None:
        records = mine.select("target").distinct().select("target", F.lit(None).cast("string").alias("item_type"), F.lit(None).cast("array<string>").alias("creator_types"))
    else:
        records = records.select(F.col("ordinal").alias("target"), "item_type", "creator_types")
    rows = rows.join(records, "target", "left")
    foreign = F.exists("other", lambda g: F.exists(F.coalesce(g["kinds"], F.array().cast("array<string>")), lambda k: ~F.array_contains(F.coalesce("creator_types", F.array(k)), k)))
    of = F.coalesce("item_type", F.lit("the type"))
    why = F.when(F.col("target_value").isNull() & (F.col("field") != "creators"), F.concat(of, F.lit(" has no "), F.col("field"), F.lit(" field"))).when((F.col("field") == "creators") & foreign, F.concat(F.lit("a creator type is not valid for "), of))
    different = F.array_distinct(F.transform(F.filter(F.get("groups", F.lit(0))["raws"], lambda r: r["value"] != F.col("target_value")), lambda r: _quoted(r["value"])))
    format_only = F.coalesce((F.col("class") == "IDENTICAL") & (F.size(different) > 0), F.lit(False))
    said = F.concat(F.lit("Only the formatting differs: home "), _quoted(F.col("target_value")), F.lit(" vs "), F.array_join(different, ", "))
    precise = F.filter(F.transform("other", lambda g: F.when(F.col("field") == "date", _precision(F.col("target_key"), g["key"]))), lambda x: x.isNotNull())
    notes = F.when(format_only, F.array(said)).when(has & (n > 0), precise).otherwise(F.array().cast("array<string>"))
    alternatives = F.transform("other", lambda g: F.struct(g["value"].alias("value"), g["name"].alias("name"), g["sources"].alias("sources")))
    return rows.select(
        "target", "field", "class", F.when(F.col("class") == "MISSING", F.when(has, F.lit("sources")).otherwise("target")).alias("missing_in"), F.coalesce("target_value", F.lit("")).alias("target_value"), "target_name",
        alternatives.alias("alternatives"), F.size("other").alias("n_alternatives"), F.get("other", F.lit(0))["value"].alias("first_alternative"), why.isNotNull().alias("not_offered"), why.alias("why_not"), notes.alias("notes"), format_only.alias("format_only"),
    )


def is_offerable() -> Column:
    """Of a row of compare: a person may choose among its alternatives."""
    return ~F.col("not_offered") & (F.col("n_alternatives") > 0)


def is_preselected() -> Column:
    """What filling writes: nothing here, one value there, and no identifier, which nothing has verified."""
    return is_offerable() & (F.col("class") == "MISSING") & (F.col("missing_in") == "target") & ~F.col("field").isin(UNVERIFIED)


def report(differences: DataFrame) -> DataFrame:
    """Per target with an offerable field: missing, fillable, different and conflicting ones among these."""
    rows = differences.where(is_offerable()).groupBy("target")
    return rows.agg(F.count_if(F.col("class") == "MISSING").alias("missing"), F.count_if(is_preselected()).alias("fillable"), F.count_if(F.col("class") == "DIFFERENT").alias("different"), F.count_if(F.col("class") == "CONFLICTING").alias("conflicting"))


def detailed_report(differences: DataFrame, partners: DataFrame | Partners, items: DataFrame) -> DataFrame:
    """report with the target's title and the names of its sources' libraries, in report order: most
    fillable first, then most that differ, then by title as a dictionary has them."""
    pairs, targets, sources = _units(partners)
    names = sources.join(items.select("ordinal", "library_name"), "ordinal").select(F.col("unit").alias("source_unit"), "library_name").distinct()
    of = pairs.join(names, "source_unit").groupBy(F.col("target_unit").alias("unit")).agg(F.array_sort(F.collect_set("library_name")).alias("source_libraries"))
    of = targets.join(of, "unit").select(F.col("ordinal").alias("target"), "source_libraries")
    title = items.select(F.col("ordinal").alias("target"), F.coalesce("title", F.lit("")).alias("title"))
    rows = report(differences).join(of, "target").join(title, "target")
    return rows.orderBy(F.desc("fillable"), (F.col("different") + F.col("conflicting")).desc(), F.collate("title", "UNICODE"), "target")


def report_totals(partners: DataFrame | Partners, fields: DataFrame, differences: DataFrame) -> DataFrame:
    """One row: targets compared, those with an offerable field, and those that can't be read, as they or all
    of their sources have no field record."""
    there = fields.select("ordinal").distinct()
    pairs, targets, sources = _units(partners)
    read = sources.join(there, "ordinal", "left_semi").select(F.col("unit").alias("source_unit")).distinct()
    read = pairs.join(read, "source_unit", "left_semi").select(F.col("target_unit").alias("unit"), F.lit(1).alias("s")).distinct()
    each = targets.join(there.withColumn("t", F.lit(1)), "ordinal", "left").join(read, "unit", "left")
    each = each.select(F.col("ordinal").alias("target"), (F.col("t").isNull() | F.col("s").isNull()).alias("unreadable"))
    each = each.join(report(differences).select("target", F.lit(True).alias("shown")), "target", "left")
    return each.agg(F.count("*").alias("compared"), F.count_if("shown").alias("shown"), F.count_if("unreadable").alias("unreadable"))
