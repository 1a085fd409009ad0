"""Catalogue records derived from the driver's tables by key arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Also valid in DuckDB: the same text makes both sides' items.
PART_ITEMS = """
SELECT k AS ordinal, CAST(k % 4 + 1 AS INT) AS library_id, concat('Library ', CAST(k % 4 + 1 AS STRING)) AS library_name,
  concat('K', CAST(k AS STRING)) AS item_key, CAST(1 AS BIGINT) AS version,
  CASE WHEN b IN (0, 1, 2, 3, 4) THEN 'journalArticle' WHEN b = 5 THEN 'preprint' WHEN b = 6 THEN 'document' WHEN b = 7 THEN 'book' WHEN b = 8 THEN 'thesis' ELSE 'report' END AS item_type,
  CASE WHEN k % 33 = 3 THEN NULL WHEN k % 11 = 0 THEN concat(p_name, ' catalogue entry: a regional review') WHEN k % 11 = 1 THEN concat(p_name, ' catalogue entry, second edition')
    WHEN k % 11 = 2 THEN concat(p_name, ' catalogue entrv') ELSE concat(p_name, ' catalogue entry') END AS title,
  CASE WHEN k % 17 = 0 THEN NULL ELSE concat(CAST(2000 + p_size % 4 AS STRING), '-05-00 May') END AS date,
  CASE WHEN k % 6 = 0 THEN concat('https://doi.org/10.1/', replace(p_name, ' ', '-'), '-', replace(substring(p_brand, length(p_brand) - 1, 2), '#', '')) WHEN k % 6 = 1 THEN concat('10.1/', CAST(k % 50 AS STRING)) END AS doi,
  CASE WHEN k % 5 = 0 THEN concat('978030640', CAST(100 + k % 40 AS STRING), CAST(k % 10 AS STRING)) WHEN k % 70 = 1 THEN '0-306-40615-2' WHEN k % 70 = 2 THEN '978-0-306-40615-7' END AS isbn,
  CASE WHEN k % 9 = 0 THEN concat('note\nPMID: ', CAST(k % 200 AS STRING)) WHEN k % 9 = 1 THEN concat('arXiv: arXiv:2101.', CAST(k % 150 AS STRING)) END AS extra,
  CASE WHEN k % 13 = 0 THEN NULL ELSE p_brand END AS creator,
  CASE WHEN k % 97 = 0 THEN k - 1 WHEN k % 89 = 0 THEN k - 64 END AS linked
FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(floor(p_partkey / 4.0) AS BIGINT) % 10 AS b, p_name, p_brand, p_size FROM part) p
"""


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items schema from `part`: one corporate creator, identifiers, links, and title variants."""
    rows = spark.sql(PART_ITEMS.replace("FROM part)", "FROM {part})"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return rows.selectExpr(
        "ordinal", "library_id", "library_name", "item_key", "version", "item_type", "title", "date", "doi", "isbn", "extra",
        "IF(creator IS NULL, array(), array(named_struct('last_name', creator, 'first_name', CAST(NULL AS STRING), 'field_mode', 1))) AS creators",
        "IF(linked IS NULL, array(), array(named_struct('library_id', CAST(linked % 4 + 1 AS INT), 'item_key', concat('K', CAST(linked AS STRING))))) AS linked_items",
    )


def libraries(items: DataFrame) -> DataFrame:
    return items.select("library_id", "library_name").distinct()


#: Field records of the same items, in both dialects too; a book has no ISSN field, and some values are absent.
PART_FIELDS = """
SELECT ordinal, 'title' AS field, coalesce(title, '') AS value FROM items
UNION ALL SELECT ordinal, 'DOI', coalesce(doi, '') FROM items
UNION ALL SELECT ordinal, 'date', coalesce(substring(date, 1, 10), '') FROM items
UNION ALL SELECT ordinal, 'volume', CAST(ordinal % 3 AS STRING) FROM items
UNION ALL SELECT ordinal, 'issue', CASE WHEN ordinal % 10 = 1 THEN NULL WHEN ordinal % 5 < 2 THEN '' ELSE CAST(ordinal % 2 AS STRING) END FROM items
UNION ALL SELECT ordinal, 'pages', CASE WHEN ordinal % 7 = 0 THEN '' WHEN ordinal % 2 = 0 THEN '1-10' ELSE '1 – 10' END FROM items
UNION ALL SELECT ordinal, 'ISSN', CASE WHEN ordinal % 4 = 0 THEN '' ELSE '0021-9010' END FROM items WHERE item_type <> 'book'
UNION ALL SELECT ordinal, 'publisher', CASE WHEN ordinal % 3 = 0 THEN '' ELSE 'Marsh & Sons' END FROM items WHERE item_type = 'thesis'
"""


def part_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PART_FIELDS.replace("FROM items", "FROM {items}"), items=part_items(spark, sf_dir))


#: Creators, numbers and notes of all kinds from `customer`, in both dialects too. The 10-digit numbers end in
#: any digit or X, the 13-digit ones in any digit, so some are valid.
PEOPLE = r"""
SELECT k AS ordinal, k % 13 = 0 AS nobody, CASE WHEN k % 11 = 0 THEN 1 WHEN k % 11 = 1 THEN NULL ELSE 0 END AS mode,
  CASE k % 9 WHEN 0 THEN 'Müller' WHEN 1 THEN 'de la Peña' WHEN 2 THEN 'O''Brien ' WHEN 3 THEN 'Åström & Søn (ÅS)' WHEN 4 THEN ' Ñandú ' WHEN 5 THEN 'The Institute of Wetland Studies, Inc.' WHEN 6 THEN '<i>Kovács</i>' WHEN 7 THEN '...' ELSE concat('Name', CAST(k % 40 AS STRING)) END AS last,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Élodie' WHEN 2 THEN 'jan' WHEN 3 THEN '' ELSE ' Ana-María' END AS first,
  CASE k % 3 WHEN 0 THEN concat(substring(CAST(1000000000 + k * 7919 AS STRING), 2, 9), CASE WHEN k % 11 = 10 THEN 'X' ELSE CAST(k % 11 AS STRING) END)
    WHEN 1 THEN concat('978-', substring(CAST(1000000000 + k * 104729 AS STRING), 2, 9), '-', CAST(k % 10 AS STRING)) ELSE concat('ISBN ', substring(CAST(1000000000 + k AS STRING), 2, 8)) END AS isbn,
  concat('a note', CASE WHEN k % 2 = 0 THEN chr(10) ELSE concat(chr(13), chr(10)) END, CASE k % 6 WHEN 0 THEN concat('PMID: PMID: ', CAST(k AS STRING)) WHEN 1 THEN concat(' pmcid : pmc', CAST(k AS STRING), ' ') WHEN 2 THEN concat('arXiv:arXiv:2101.', CAST(k AS STRING), 'V2')
    WHEN 3 THEN concat('DOI: none', chr(10), 'DOI: https://doi.org/10.5/', CAST(k AS STRING), 'A') WHEN 4 THEN concat('PMID:', chr(10), 'PMID: ', CAST(k AS STRING)) ELSE 'PMIDs: 3' END, chr(10), 'last: line') AS extra
FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) c
"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, creators, isbn, extra."""
    rows = spark.sql(PEOPLE.replace("FROM customer)", "FROM {customer})"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return rows.selectExpr("ordinal", "IF(nobody, array(), array(named_struct('last_name', last, 'first_name', first, 'field_mode', mode))) AS creators", "isbn", "extra")


#: Fixed values for the fixture: of each type the fields it has, under its own names (name, base); a document has
#: the base names of all.
_COMMON = ["title", "abstractNote", "date", "url", "language", "rights"]
TYPE_NAMES = {
    "journalArticle": [*_COMMON, "publicationTitle", "journalAbbreviation", "volume", "issue", "pages", "DOI", "ISSN"],
    "preprint": [*_COMMON, ("repository", "publisher"), "place", "DOI"],
    "book": [*_COMMON, "volume", "edition", "place", "publisher", "ISBN"],
    "thesis": [*_COMMON, ("university", "publisher"), "place"],
    "report": [*_COMMON, ("institution", "publisher"), "place", "pages"],
    "document": [*_COMMON, "publicationTitle", "journalAbbreviation", "volume", "issue", "pages", "DOI", "ISSN", "edition", "place", "publisher", "ISBN"],
}


def type_names(spark: SparkSession) -> DataFrame:
    rows = [(kind, *(f if isinstance(f, tuple) else (f, f))) for kind, fields in TYPE_NAMES.items() for f in fields]
    return spark.createDataFrame(rows, "item_type string, name string, base string")


#: Wide records of the same items, in both dialects: all columns are there for all types, as stores have them.
PART_RECORDS = """
SELECT ordinal, item_type, title, CASE WHEN ordinal % 3 = 0 THEN 'On glazes.' END AS "abstractNote", concat('Journal ', CAST(ordinal % 2 AS STRING)) AS "publicationTitle", 'J.' AS "journalAbbreviation",
  CAST(ordinal % 3 AS STRING) AS volume, CASE WHEN ordinal % 5 < 2 THEN '' ELSE CAST(ordinal % 2 AS STRING) END AS issue, CASE WHEN ordinal % 2 = 0 THEN '1-10' ELSE '1 – 10' END AS pages, date, doi AS "DOI", isbn AS "ISBN",
  CASE WHEN ordinal % 4 = 0 THEN '' ELSE '0021-9010' END AS "ISSN", CASE WHEN ordinal % 7 = 0 THEN 'https://example.org/a' END AS url, CASE WHEN ordinal % 3 = 0 THEN '' ELSE 'Marsh & Sons' END AS publisher,
  CASE WHEN ordinal % 3 = 1 THEN 'Marsh University' ELSE '' END AS university, 'Marsh Institute' AS institution, CASE WHEN ordinal % 2 = 0 THEN 'arXiv' END AS repository, 'Hue' AS place, CASE WHEN ordinal % 11 = 1 THEN '2' END AS edition, 'en' AS language, CASE WHEN ordinal % 6 = 0 THEN 'free' END AS rights
FROM items
"""


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PART_RECORDS.replace('"', "`").replace("FROM items", "FROM {items}"), items=part_items(spark, sf_dir).select("*"))


#: Items of `documents`, in both dialects: persons with accents and particles, decomposed and not, up to three
#: creators, organisations among them. Names are many, so blocks are small.
DOCUMENT_ITEMS = """
SELECT k AS ordinal, CAST(k % 4 + 1 AS INT) AS library_id, concat('Library ', CAST(k % 4 + 1 AS STRING)) AS library_name, concat('D', CAST(k AS STRING)) AS item_key, CAST(1 AS BIGINT) AS version,
  CASE k % 6 WHEN 0 THEN 'book' WHEN 1 THEN 'thesis' WHEN 2 THEN 'document' WHEN 3 THEN 'conferencePaper' ELSE 'journalArticle' END AS item_type,
  concat(CASE k % 5 WHEN 0 THEN 'Études of ' WHEN 1 THEN 'Etudes of ' WHEN 2 THEN '<i>Études</i>: ' ELSE 'Notes on ' END, source, ' in ', lang, CASE WHEN k % 9 = 0 THEN ', with maps' ELSE '' END) AS title,
  CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(1990 + k % 5 AS STRING) END AS date, CASE WHEN k % 40 = 0 THEN concat('10.7/', CAST(k % 360 AS STRING)) END AS doi, CAST(NULL AS STRING) AS isbn, CASE WHEN k % 55 = 0 THEN concat('PMID: ', CAST(k % 330 AS STRING)) END AS extra,
  CASE WHEN k % 31 = 0 THEN NULL ELSE concat(CASE k % 4 WHEN 0 THEN 'Müller-' WHEN 1 THEN 'Mu\u0308ller ' WHEN 2 THEN 'de la Peña ' ELSE 'Åström' END, CAST(k % 60 AS STRING)) END AS last1, CASE k % 3 WHEN 0 THEN 'Élodie' WHEN 1 THEN 'e. m.' ELSE 'Ana' END AS first1,
  CASE WHEN k % 3 = 1 THEN concat('Ñandú', CAST(k % 70 AS STRING)) END AS last2, CASE WHEN k % 2 = 0 THEN 'José' ELSE ' josé maría' END AS first2,
  CASE WHEN k % 7 = 2 THEN concat('The Society (', CAST(k % 2 AS STRING), ') for Salt, Ltd. no ', CAST(k % 80 AS STRING)) END AS body,
  CASE WHEN k % 77 = 0 AND k > 0 THEN k - 1 END AS linked
FROM (SELECT CAST(doc_id AS BIGINT) AS k, source, lang FROM documents) d
"""


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(DOCUMENT_ITEMS.replace("FROM documents)", "FROM {documents})"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    person = lambda n: f"IF(last{n} IS NULL, NULL, named_struct('last_name', last{n}, 'first_name', first{n}, 'field_mode', 0))"
    return rows.selectExpr(
        "ordinal", "library_id", "library_name", "item_key", "version", "item_type", "title", "date", "doi", "isbn", "extra",
        f"filter(array({person(1)}, {person(2)}, IF(body IS NULL, NULL, named_struct('last_name', body, 'first_name', CAST(NULL AS STRING), 'field_mode', 1))), x -> x IS NOT NULL) AS creators",
        "IF(linked IS NULL, array(), array(named_struct('library_id', CAST(linked % 4 + 1 AS INT), 'item_key', concat('D', CAST(linked AS STRING))))) AS linked_items",
    )
