"""Language-model scores: prediction by partial matching over byte contexts, beside a unigram base.

The trie of byte contexts up to order 4 and the word counts are gathered over all training documents as
(key, count) rows that each task adds up before the shuffle. A symbol's probability follows method C:
from the longest context met, escapes go down to shorter ones, and symbols already refused are excluded
from the shorter context's counts. As a shorter context is always the suffix of the longer, what is
excluded depends on the longer context alone, so the trie becomes a table with one log-probability for
each window of four context bytes and a symbol. The table is joined, not broadcast: only its most
frequent entries, at most `hot` of each kind, go to every task; rows for the others meet it by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, crc_mod, id_text, py_crc_mod, ranges, stored, words_of
from .quality_rules import batches_by_size

ORDER = 4
#: Bytes that no UTF-8 text has: what stands before a text, and the symbol that ends it.
START, END = 0xFE, 0xFF
#: The end of a text among the words; no word holds a line feed.
END_WORD = "\n"
WORD, WINDOW = 0, 1
#: Text read at once, in characters: a worker holds some hundred bytes for each.
_CHARS = 500_000


class Reader:
    """Words and byte windows of some texts, A to Z in lower case."""

    def __init__(self) -> None:
        self.hash = WordHashes(1 << 18)

    def __call__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "replace").lower() for t in texts]
        parts = [words_of(r.decode()) + [END_WORD] for r in raw]
        self.n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        keys = self.hash([w for p in parts for w in p]).view(np.int64)
        self.word_codes, self.words = pd.factorize(keys)
        pad = bytes([START] * ORDER)
        b = np.frombuffer(pad.join([b"", *(r + bytes([END]) for r in raw)]), np.uint8).astype(np.int64)
        self.n_bytes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        w = np.zeros(max(0, len(b) - ORDER), np.int64)
        for k in range(ORDER + 1):
            w = w << 8 | b[k : len(b) - ORDER + k]
        # each text is followed by windows that end in the next one's pad bytes, symbols of no text
        keep = np.arange(int(self.n_bytes.sum())) + ORDER * np.repeat(np.arange(len(raw)), self.n_bytes)
        self.window_codes, self.windows = pd.factorize(w[keep])


class _Sums:
    """Counts by key, added up in the task and let go at a bounded size."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, n_all: np.ndarray, n_train: np.ndarray) -> tuple | None:
        self.parts.append((keys, n_all, n_train))
        self.size += len(keys)
        if self.size > self.most:
            whole = self.take()
            if len(whole[0]) > self.most // 2:
                return whole
            self.parts, self.size = [whole], len(whole[0])
        return None

    def take(self) -> tuple:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        codes, keys = pd.factorize(np.concatenate([p[0] for p in self.parts]))
        out = [keys]
        for j in (1, 2):
            out.append(np.bincount(codes, weights=np.concatenate([p[j] for p in self.parts]), minlength=len(keys)).astype(np.int64))
        self.parts, self.size = [], 0
        return tuple(out)


def _counts(docs: DataFrame, mod: int, held: int) -> DataFrame:
    """kind, key, n_all, n_train over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, sums = Reader(), (_Sums(), _Sums())

        def out(kind: int, got: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(got[0]), kind, np.int32)), *map(pa.array, got)], ["kind", "key", "n_all", "n_train"])

        for b in batches:
            for ids, texts in batches_by_size(b, _CHARS):
                read(texts)
                train = np.array([i is None or py_crc_mod(i, mod) != held for i in ids])
                for kind, codes, keys, n in ((WORD, read.word_codes, read.words, read.n_words), (WINDOW, read.window_codes, read.windows, read.n_bytes)):
                    got = sums[kind].add(keys, np.bincount(codes, minlength=len(keys)), np.bincount(codes[np.repeat(train, n)], minlength=len(keys)))
                    if got:
                        yield out(kind, got)
        for kind in (WORD, WINDOW):
            yield out(kind, sums[kind].take())

    rows = docs.mapInArrow(run, "kind int, key long, n_all long, n_train long")
    return rows.groupBy("kind", "key").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def _suffix(key: Column, order: int) -> Column:
    return key.bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def _context(key: Column) -> Column:
    return F.shiftright(key, 8)


def ppm_table(windows: DataFrame) -> DataFrame:
    """key, n_all, n_train -> with lp, the log10 probability of the window's last byte after the others.

    Each level's counts and contexts are tables in the shared folder, so no plan holds more than one
    level's joins for the windows met in training, and one chain of joins for the others."""
    counts = {ORDER: windows.where("n_train > 0").select("key", F.col("n_train").alias("c"))}
    for k in range(ORDER - 1, -1, -1):
        counts[k] = stored(counts[k + 1].groupBy(_suffix(F.col("key"), k).alias("key")).agg(F.sum("c").alias("c")), f"lm-counts-{k}")
    stats = {}
    for k in range(ORDER, -1, -1):
        own = counts[k].select(_context(F.col("key")).alias("ctx"), "c", _suffix(F.col("key"), k - 1).alias("low") if k else F.lit(0).alias("low"))
        if k:
            own = own.join(counts[k - 1].select(F.col("key").alias("low"), F.col("c").alias("x")), "low")
        else:
            own = own.withColumn("x", F.lit(0).cast("long"))
        stats[k] = stored(own.groupBy("ctx").agg(F.sum("c").alias("t"), F.count("*").alias("d"), F.sum("x").alias("x")), f"lm-contexts-{k}")
    known, zero = F.col("t").isNotNull(), F.lit(0).cast("long")
    esc = F.when(known, F.log10(F.col("d") / (F.col("t") + F.col("d")))).otherwise(0.0)
    lp = F.when(F.col("n_train") > 0, F.log10(F.col("n_train") / (F.col("t") + F.col("d"))))
    top = stored(windows.withColumn("ctx", _context(F.col("key"))).join(stats[ORDER], "ctx", "left").select("key", "n_all", "n_train", lp.alias("lp"), esc.alias("acc"), F.coalesce("x", zero).alias("ex_t"), F.coalesce("d", zero).alias("ex_d")), "lm-top")
    rest = top.where("lp is null")
    for k in range(ORDER - 1, -1, -1):
        rest = rest.withColumn("low", _suffix(F.col("key"), k)).join(counts[k].select(F.col("key").alias("low"), "c"), "low", "left")
        rest = rest.withColumn("ctx", _context(F.col("low"))).join(stats[k], "ctx", "left")
        t, d = F.col("t") - F.col("ex_t"), F.col("d") - F.col("ex_d")
        rest = rest.select(
            "key",
            "n_all",
            "n_train",
            F.coalesce("lp", F.when(F.col("c").isNotNull(), F.col("acc") + F.log10(F.col("c") / (t + d)))).alias("lp"),
            (F.col("acc") + F.when(known & (d > 0), F.log10(d / (t + d))).otherwise(0.0)).alias("acc"),
            F.when(known, F.col("x")).otherwise(F.col("ex_t")).alias("ex_t"),
            F.when(known, F.col("d")).otherwise(F.col("ex_d")).alias("ex_d"),
        )
    rest = rest.select("key", "n_all", "n_train", F.coalesce("lp", F.col("acc") - F.log10(256 - F.col("ex_d"))).alias("lp"))
    return top.where("lp is not null").select("key", "n_all", "n_train", "lp").unionByName(rest)


def _hot(values: DataFrame, most: int) -> DataFrame:
    """The most frequent entries: all from the least power of two on that leaves at most `most` of a kind."""
    steps = values.groupBy("kind", F.floor(F.log2("n_all")).alias("step")).count().collect()
    least = {}
    for kind in (WORD, WINDOW):
        total, least[kind] = 0, 1 << 62
        for r in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            total += r["count"]
            if total > most:
                break
            least[kind] = 1 << r["step"]
    return values.where(" or ".join(f"kind = {k} and n_all >= {v}" for k, v in least.items()))


def score(docs: DataFrame, held_out_mod: int = 7, held_out_rest: int = 2, hot: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: held_out, n_tokens (words and one end), n_known, train_tokens, base_score
    (unigram log10 probability with add-one smoothing over the training vocabulary and one unknown) and
    score (the byte model's log10 probability of the text and its end).

    Training documents are those whose id's crc32 modulo held_out_mod isn't held_out_rest; documents with
    a null id count as training. Null and empty texts have the end alone. Repeated rows count as often
    as they stand and are scored each; an empty table gives no rows; other columns are dropped."""
    docs = id_text(docs, id_col, text_col)
    spark = docs.sparkSession
    counts = stored(_counts(docs, held_out_mod, held_out_rest), "lm-counts")
    words = counts.where(F.col("kind") == WORD)
    n, v = words.where("n_train > 0").agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count("*")).first()
    base = words.select("kind", "key", "n_all", "n_train", F.log10((F.col("n_train") + 1) / F.lit(float(n + v + 1))).alias("lp"))
    table = ppm_table(counts.where(F.col("kind") == WINDOW).drop("kind")).withColumn("kind", F.lit(WINDOW))
    values = stored(base.unionByName(table.select(*base.columns)), "lm-values")
    top = _hot(values, hot).select("kind", "key", "n_train", "lp").toArrow().to_pandas()
    tables = []
    for kind in (WORD, WINDOW):
        own = top[top["kind"] == kind].sort_values("key")
        tables.append((own["key"].to_numpy(np.int64), own["lp"].to_numpy(np.float64), own["n_train"].to_numpy(np.int64) > 0))
    cast = spark.sparkContext.broadcast(tables)
    names = ["row", "doc_id", "kind", "key", "n", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, row = Reader(), TaskContext.get().partitionId() << 40
        for b in batches:
            for ids, texts in batches_by_size(b, _CHARS):
                read(texts)
                m, out = len(ids), []
                rows = np.arange(row, row + m)
                row += m
                sums = {}
                for kind, codes, keys, n_ in ((WORD, read.word_codes, read.words, read.n_words), (WINDOW, read.window_codes, read.windows, read.n_bytes)):
                    known, lp, trained = cast.value[kind]
                    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                    found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                    value = np.where(found, lp[at], 0.0) if len(known) else np.zeros(len(keys))
                    doc = np.repeat(np.arange(m), n_)
                    sums[kind] = np.bincount(doc, weights=value[codes], minlength=m)
                    if kind == WORD:
                        seen = found & trained[at] if len(known) else found
                        n_known = np.bincount(doc[seen[codes]], minlength=m)
                    rare = ~found[codes]
                    pair, times = np.unique(doc[rare] * len(keys) + codes[rare], return_counts=True)
                    if len(pair):
                        out.append((rows[pair // len(keys)], np.full(len(pair), kind), keys[pair % len(keys)], times))
                none = np.zeros(m, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids, pa.int64()), pa.array(np.full(m, -1, np.int32)), *(pa.array(x) for x in (rows, none, read.n_words, n_known, sums[WORD], sums[WINDOW]))], names)
                for r, k, key, times in out:
                    zero, zf = pa.array(np.zeros(len(r), np.int64)), pa.array(np.zeros(len(r)))
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.nulls(len(r), pa.int64()), pa.array(k.astype(np.int32)), pa.array(key), pa.array(times), zero, zero, zf, zf], names)

    rows = docs.mapInArrow(run, "row long, doc_id long, kind int, key long, n long, n_tokens long, n_known long, base double, score double")
    # Rows of documents have kind -1 and a key of their own; rows of rare keys fetch their value by key.
    own, word = F.col("r.kind") == -1, F.col("r.kind") == WORD
    lent = F.col("r.n") * F.coalesce("v.lp", F.lit(0.0))
    got = rows.alias("r").join(values.select("kind", "key", "lp", "n_train").alias("v"), (F.col("r.kind") == F.col("v.kind")) & (F.col("r.key") == F.col("v.key")), "left")
    got = got.select("row", "doc_id", "n_tokens", F.when(own, F.col("n_known")).when(word & (F.col("n_train") > 0), F.col("n")).otherwise(0).alias("n_known"), F.when(own, F.col("base")).when(word, lent).otherwise(0.0).alias("base"), F.when(own, F.col("score")).when(word, 0.0).otherwise(lent).alias("score"))
    out = got.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), held_out_mod) == held_out_rest, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
