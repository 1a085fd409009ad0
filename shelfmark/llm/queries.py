"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat_format, fingerprint, html_extract, lm_scoring, merkle, ngram_join, packing, phrases, quality_classifier, quality_rules, toxicity
from .common import crc_mod, table


def vocabulary(name: str) -> str:
    """Where the public tokenizers lie: the package of that name, or SHELFMARK_TOKENIZERS."""
    folder = os.environ.get("SHELFMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat_format.probe_turns(spark))
    return chat_format.read_back(chat_format.format_conversations(turns))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.prove(merkle.document_leaves(table(spark, sf_dir, "documents"), lower, crc_mod(F.col("doc_id").cast("long"), 5) == 0))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_html, op3_ann, op4_quality, op5_rules, op6_packing, op7_toxicity, op8_chat, op9_lm, op10_ngram_join, op11_fingerprint, op12_phrases, op13_merkle)}

_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *,
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE 16 + length(regexp_replace(role, '([\]\\])', '\\\1', 'g')) END AS extra,
    CASE WHEN contains(text, CASE role WHEN 'system' THEN ' [/SYS]' WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>' ELSE ' [/ROLE]' END)
           OR regexp_matches(text, '[<\[]\\+(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE |/ROLE\])')
         THEN length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE |/ROLE\])', '\1\2\\\3', 'g'))
         ELSE length(text) END AS n
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(n + extra) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

_JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(31))]
    ELSE list_distinct([array_to_string(w[i:i + 4], chr(31)) FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), keyed AS (
  SELECT doc_id, s, md5(array_to_string(list_sort(s), chr(30))) AS k FROM s
), nodes AS (
  SELECT k, min(doc_id) AS copy_id, count(*) AS n_copies, any_value(s) AS s FROM keyed GROUP BY k
), one AS (
  SELECT copy_id, len(s) AS n, unnest(s) AS g FROM nodes
), links AS (
  SELECT a.copy_id AS a, b.copy_id AS b FROM one a JOIN one b ON a.g = b.g AND a.copy_id <> b.copy_id
  GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
), reach AS (
  SELECT copy_id AS a, copy_id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, c.class_id, x.copy_id, x.n_copies, coalesce(n.n_links, 0) AS n_links
FROM keyed d JOIN nodes x USING (k) JOIN class c ON c.a = x.copy_id LEFT JOIN n ON n.a = x.copy_id
"""

_PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
each AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))]) FROM w
  UNION ALL SELECT lang, 3, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) FROM w
), f AS (SELECT lang, k, phrase, count(*) AS f FROM each GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, x.f AS l, y.f AS r, i, CAST((CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
  JOIN f x ON x.lang = c.lang AND x.k = i AND x.phrase = array_to_string(c.w[1:i], ' ') JOIN f y ON y.lang = c.lang AND y.k = c.k - i AND y.phrase = array_to_string(c.w[i + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, i) = 1),
longer AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM c WHERE k = 3),
kept AS (SELECT * FROM best b WHERE k = 3 OR NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.f >= 50 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""


def _merkle_sql(levels: int = 7) -> str:
    """The levels of the trees of sources one after the other, then those of the tree of subroots; 16^7 leaves
    to a source at most."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    nibbles = "flatten([[ascii(c) & 15, ascii(c) >> 4] FOR c IN string_split(CAST(doc_id AS STRING), '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295, {nibbles}), lambda c, x: xor(c >> 4, {table}[(xor(c, x) & 15) + 1])), 4294967295)"
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS STRING)) AS STRING) || ':' || CAST({c} AS STRING), '-')"
    leaf = lambda text: f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [f"""RECURSIVE d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS shown FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d), s0 AS (SELECT source AS tree, pos, leaf AS h FROM r)"""]
    def rise(a: str, b: str) -> str:
        return f"""{b} AS (SELECT tree, pos // 16 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {a}) GROUP BY tree, pos // 16)"""
    sql += [rise(f"s{k}", f"s{k + 1}") for k in range(levels)]
    sql.append(f"t0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, h, tree AS source FROM s{levels})")
    sql += [rise(f"t{k}", f"t{k + 1}") for k in range(levels)]
    # each row with the nodes of its run on each level, its own left out; a level without siblings is a lone node's and folds to itself
    def beside(at: str, k: int, level: str, tree: str, pos: str) -> str:
        return f"""p{k} AS (SELECT x.*, y.l AS l{k}, y.r AS r{k} FROM {at} x JOIN (SELECT a.tree, a.pos,
    CASE WHEN any_value(a.n) > 1 THEN coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') END AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {level}) a JOIN {level} b ON a.tree IS NOT DISTINCT FROM b.tree AND a.pos // 16 = b.pos // 16 GROUP BY a.tree, a.pos) y
  ON y.tree IS NOT DISTINCT FROM x.{tree} AND y.pos = x.{pos} // {16 ** (k % levels)})"""
    sql.append("q AS (SELECT r.*, t0.pos AS place, 0 AS top FROM r JOIN t0 ON r.source IS NOT DISTINCT FROM t0.source)")
    sql += [beside("q" if k == 0 else f"p{k - 1}", k, f"s{k}" if k < levels else f"t{k - levels}", "source" if k < levels else "top", "pos" if k < levels else "place") for k in range(2 * levels)]
    fold = "shown"
    sql_folds = []
    for k in range(2 * levels):
        sql_folds.append(f"f{k} AS (SELECT *, CASE WHEN l{k} IS NULL THEN {fold} ELSE sha256(l{k} || {fold} || r{k}) END AS v{k} FROM {f'p{2 * levels - 1}' if k == 0 else f'f{k - 1}'})")
        fold = f"v{k}"
    siblings = " || ".join(f"coalesce(l{k}, '') || CASE WHEN l{k} IS NULL THEN '' ELSE r{k} END" for k in range(2 * levels))
    return "WITH " + ",\n".join(sql + sql_folds) + f"""
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256({siblings}) AS proof_sha256, {fold} AS folded_root, {fold} = t.h AS verified
FROM f{2 * levels - 1} f JOIN s{levels} s ON s.tree IS NOT DISTINCT FROM f.source CROSS JOIN t{levels} t"""


#: Only where SQL can say what the query says; the others are held against brute force in the tests.
ORACLE_SQL = {"op8_chat": _CHAT_SQL, "op10_ngram_join": _JOIN_SQL, "op12_phrases": _PHRASES_SQL, "op13_merkle": _merkle_sql()}
