"""Column builders for text, identifiers and creators. Absent is NULL; all of it stays in the JVM but the
decomposition of text that isn't ASCII, for which Spark has no builtin."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: They decide results.
STOP_WORDS = ["a", "an", "the", "of", "on", "in", "for", "and", "or", "to", "with", "from", "at", "by", "as"]
CORPORATE_NOISE = ["and", "the", "of", "for", "inc", "llc", "ltd", "co"]
EDITION_MARKERS = ["edition", "ed", "edn", "version", "ver", "v"]
RELATED_TYPES = [("journalarticle", "preprint"), ("conferencepaper", "journalarticle"), ("book", "thesis"), ("document", "journalarticle")]
TYPE_RANK = ["journalarticle", "book", "conferencepaper", "thesis", "preprint"]
GENERIC_TYPE = "document"
IDENTIFIERS = ["doi", "isbn13", "pmid", "pmcid", "arxiv"]

_SEPARATORS = r"[ !-/:-@\[-`{-~]+|[\p{P}\p{S}]+"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: xs if xs is None else [None if x is None else unicodedata.normalize("NFKD", x) for x in xs])


def decomposed(values: Column) -> Column:
    """An array's strings with compatibility forms decomposed. Of rows of ASCII alone Python gets a null."""
    other = F.coalesce(F.exists(values, lambda x: x.rlike(r"[^\x00-\x7F]")), F.lit(False))
    return F.when(other, _nfkd(F.when(other, values))).otherwise(values)


def absent(c: Column) -> Column:
    """The empty string is an absent value."""
    return F.nullif(c, F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def without_markup(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "[{}]", "")


def folded(c: Column) -> Column:
    """Of a decomposed text: without marks, each run of ASCII separators or of other punctuation one space,
    trimmed, in lower case. Adjacent runs of the two kinds keep a space each."""
    return F.lower(trimmed(F.regexp_replace(F.regexp_replace(c, r"\p{M}", ""), _SEPARATORS, " ")))


def normalized_text(c: Column) -> Column:
    """Without tags and braces, decomposed and folded."""
    return folded(decomposed(F.array(without_markup(c)))[0])


def doi(c: Column) -> Column:
    bare = F.lower(trimmed(F.regexp_replace(c, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)", "")))
    return F.when(bare.startswith("10."), bare)


def _weighted(digits: Column, weights: list[int]) -> Column:
    return sum((F.try_to_number(F.substring(digits, i + 1, 1), F.lit("9")).cast("int") * w for i, w in enumerate(weights[1:], 1)), F.try_to_number(F.substring(digits, 1, 1), F.lit("9")).cast("int") * weights[0])


def _check_digit(first12: Column) -> Column:
    return ((10 - _weighted(first12, [1, 3] * 6) % 10) % 10).cast("string")


def isbn13(c: Column) -> Column:
    """A valid 13-digit number, or the 13-digit form of a valid 10-digit one; an X before the last place
    makes it absent."""
    kept = F.upper(F.regexp_replace(c, "[^0-9Xx]", ""))
    tenth = F.when(F.substring(kept, 10, 1) == "X", 10).otherwise(F.try_to_number(F.substring(kept, 10, 1), F.lit("9")).cast("int"))
    valid10 = kept.rlike("^[0-9]{9}[0-9X]$") & ((_weighted(kept, [10, 9, 8, 7, 6, 5, 4, 3, 2]) + tenth) % 11 == 0)
    valid13 = kept.rlike("^[0-9]{13}$") & (F.substring(kept, 13, 1) == _check_digit(kept))
    stem = F.concat(F.lit("978"), F.substring(kept, 1, 9))
    return F.when(valid13, kept).when(valid10, F.concat(stem, _check_digit(stem)))


def extra_identifier(extra: Column, label: str) -> Column:
    """The value of the first line 'LABEL: value' of an extra field; of DOI lines the first valid one."""
    values = F.filter(F.transform(F.split(extra, r"\r?\n"), lambda x: trimmed(F.regexp_extract(x, rf"(?iU)^\s*{label}\s*:\s*(.+?)\s*$", 1))), lambda x: x != "")
    if label == "DOI":
        return F.get(F.filter(F.transform(values, doi), lambda x: x.isNotNull()), F.lit(0))
    value = F.get(values, F.lit(0))
    if label == "PMID":
        return absent(F.regexp_replace(value, r"(?i)^PMID:\s*", ""))
    if label == "PMCID":
        return F.upper(value)
    return absent(F.regexp_replace(F.lower(value), "^arxiv:", ""))


#: The type of creators as items have them.
CREATORS = "array<struct<last_name:string,first_name:string,field_mode:int>>"


def is_corporate(c: Column) -> Column:
    """An organisation: marked so, or of one name with white space inside."""
    one_name = F.coalesce(c["first_name"], F.lit("")) == ""
    return (F.coalesce(c["field_mode"], F.lit(0)) == 1) | (one_name & trimmed(F.coalesce(c["last_name"], F.lit(""))).rlike(r"(?U)\s"))


def creator_texts(creators: Column) -> Column:
    """Last (an organisation's without brackets) and first name of each creator, not yet decomposed."""
    last = lambda c: F.coalesce(c["last_name"], F.lit(""))
    names = lambda c: F.array(without_markup(F.when(is_corporate(c), F.regexp_replace(last(c), r"\([^)]*\)", " ")).otherwise(last(c))), without_markup(F.coalesce(c["first_name"], F.lit(""))))
    return F.flatten(F.transform(F.coalesce(creators, F.array().cast(CREATORS)), names))


def corporate_name(text: Column) -> Column:
    """Of a folded name: without connective words."""
    noise = r"(?<![a-z0-9_])(?:" + "|".join(CORPORATE_NOISE) + r")(?![a-z0-9_])"
    return trimmed(F.regexp_replace(F.regexp_replace(text, noise, " "), r"(?U)\s+", " "))


def creator_keys(creators: Column, texts: Column) -> Column:
    """Sorted keys: corporate:<name> or <last>:<first initial>; a creator whose name folds to nothing has
    none. texts: a column with their creator_texts, decomposed."""

    def key(c: Column, i: Column) -> Column:
        last, first = folded(F.get(texts, 2 * i)), folded(F.get(texts, 2 * i + 1))
        name = F.when(is_corporate(c), F.concat(F.lit("corporate:"), absent(corporate_name(last))))
        return name.otherwise(F.concat(absent(last), F.lit(":"), F.substring(first, 1, 1)))

    keys = F.transform(F.coalesce(creators, F.array().cast(CREATORS)), key)
    return F.array_sort(F.filter(keys, lambda k: k.isNotNull()))


def year(c: Column) -> Column:
    y = F.try_to_number(F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int")
    return F.nullif(y, F.lit(0))


def content_words(title: Column) -> Column:
    return F.filter(F.split(title, " "), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def differ(a: Column, b: Column) -> Column:
    """Both present and unequal; never NULL."""
    return F.coalesce(a != b, F.lit(False))


def type_rank(item_type: Column) -> Column:
    low = F.lower(item_type)
    out = F.when(low == GENERIC_TYPE, len(TYPE_RANK) + 1)
    for i, t in enumerate(TYPE_RANK):
        out = out.when(low == t, i)
    return out.otherwise(len(TYPE_RANK))
