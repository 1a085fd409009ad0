"""Document fingerprints: digests of improbable features in chained Bloom filters.

Every window of 32 bytes is ranked by how rare its entropy is in ordinary text. Of each run of
neighbouring windows the rarest one, the leftmost among equals, gets a vote; windows with enough votes
are the text's features. They go, in the text's order, into Bloom filters of 2,048 bits with at most 128
features each, and the chain of filters is the fingerprint. Nothing but the text decides it, so equal
texts have equal fingerprints in every table. Two fingerprints are compared filter by filter by the bits
they share, less what chance would give.

The next document in an order is met with one shuffle of the texts: the ids alone are put in order first,
the first of each range is known then, and a copy of it is sent to the range before.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored

#: Bytes of a window, windows of a run, votes that a feature needs; the same for texts of under SHORT
#: windows, of which all but every fourth window or so would go unseen else.
WINDOW, RUN, VOTES = 32, 32, 8
SHORT, SHORT_RUN, SHORT_VOTES = 256, 4, 2
BITS, HASHES, PER_FILTER = 2048, 5, 128
#: Share of what two filters can have in common beyond chance that counts as nothing, besides two standard
#: deviations of chance.
SLACK = 0.1
#: Entropies are whole numbers, bits * WINDOW * UNIT, so a window's is the same wherever it stands.
UNIT = 1024
#: Entropy in bits of a window of ordinary text, where windows are least rare; windows of less than WEAK
#: bits are rare too, but tell of nothing (runs of one sign), and come last.
USUAL, WEAK = 3.5, 1.0
_STEP = 64
_LAST = 0xFFFF
_F = np.array([0, *(round(c * np.log2(c) * UNIT) for c in range(1, WINDOW + 1))], np.int32)
_G = np.concatenate([[0], np.diff(_F)]).astype(np.int32)
SEGMENT, _BLOCK = 1 << 18, 1 << 16


def entropies(b: np.ndarray) -> np.ndarray:
    """The entropy of each window of bytes, times WINDOW * UNIT. One step to the right takes a byte out and
    another in, so all that counts is how often these stand in the window."""
    n = len(b) - WINDOW + 1
    out = np.empty(n, np.int64)
    for s in range(0, n, _BLOCK):
        x = b[s : s + _BLOCK + WINDOW - 1]
        ahead, behind = np.ones(len(x), np.uint8), np.ones(len(x), np.uint8)
        for d in range(1, WINDOW):
            same = (x[d:] == x[:-d]).view(np.uint8)
            ahead[:-d] += same
            behind[d:] += same
        part = out[s : s + _BLOCK]
        part[0] = _F[np.bincount(x[:WINDOW])].sum()
        np.cumsum(_G[behind[WINDOW:]] - _G[ahead[: len(x) - WINDOW]], out=part[1:])
        part[1:] += part[0]
    return _F[WINDOW] - out


def ranks(entropy: np.ndarray) -> np.ndarray:
    """Rare entropies first."""
    rank = _LAST - 1 - np.abs(entropy - round(USUAL * WINDOW * UNIT)) // _STEP
    return np.where(entropy < WEAK * WINDOW * UNIT, _LAST, rank)


def _rarest(v: np.ndarray, run: int) -> np.ndarray:
    """Of each run of so many ranked places the least one."""
    width = 1
    while width < run:
        step = min(width, run - width)
        v = np.minimum(v[:-step], v[step:])
        width += step
    return v


def _hashes(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = b[at[:, None] + np.arange(WINDOW)].view("<u8")
    h = np.full(len(words), WINDOW, np.uint64)
    for k in range(WINDOW // 8):
        h = mix64(h + words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(h)


def _distinct(h: np.ndarray) -> np.ndarray:
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def _rule(windows: int) -> tuple[int, int]:
    run, votes = (SHORT_RUN, SHORT_VOTES) if windows < SHORT else (RUN, VOTES)
    return min(run, windows), votes


def _features_of_long(b: np.ndarray) -> np.ndarray:
    """features of one text, in segments that overlap, so memory is bounded but for a byte a window."""
    n = len(b) - WINDOW + 1
    run, votes = _rule(n)
    got = np.zeros(n, np.uint8)
    for s in range(0, n - run + 1, SEGMENT):  # runs that begin at s and later
        m = min(SEGMENT, n - run + 1 - s) + run - 1
        least = _rarest(ranks(entropies(b[s : s + m + WINDOW - 1])) << 32 | np.arange(m), run)
        got[s : s + m] += np.bincount(least & 0xFFFFFFFF, minlength=m).astype(np.uint8)
    at = np.flatnonzero(got >= min(votes, int(got.max())))
    return _distinct(np.concatenate([_hashes(b, at[s : s + SEGMENT]) for s in range(0, len(at), SEGMENT)]))


def _features_of_many(raws: list[bytes]) -> list[np.ndarray]:
    """features of short texts, one after the other in one array; runs that reach into the next don't count."""
    b = np.frombuffer(b"".join(raws), np.uint8)
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    start = np.cumsum(size) - size
    windows = size - WINDOW + 1
    n = len(b) - WINDOW + 1
    v = ranks(entropies(b)) << 32 | np.arange(n)
    rules = np.array([_rule(w) for w in windows.tolist()])
    got = np.zeros(n, np.int64)
    for run in set(rules[:, 0].tolist()):
        own = rules[:, 0] == run
        edge = np.zeros(n + 2, np.int8)
        edge[start[own]] = 1
        edge[start[own] + windows[own] - run + 1] -= 1
        least = _rarest(v, run)
        got += np.bincount(least[np.cumsum(edge[: len(least)]) > 0] & 0xFFFFFFFF, minlength=n)
    inside = np.zeros(n, bool)
    least_votes = np.zeros(n, np.int64)
    most = np.maximum.reduceat(got, start)
    for s, w, need in zip(start.tolist(), windows.tolist(), np.minimum(rules[:, 1], most).tolist(), strict=True):
        inside[s : s + w] = True
        least_votes[s : s + w] = need
    at = np.flatnonzero(inside & (got >= least_votes))
    h, cut = _hashes(b, at), np.searchsorted(at, start)
    return [_distinct(x) for x in np.split(h, cut[1:])]


def features(raws: list[bytes]) -> list[np.ndarray]:
    """Of each text the 64-bit hashes of its distinct features, in its order. A text of less than a window is
    one feature, an empty one has none."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(raws)
    held: list[int] = []
    size = 0

    def flush() -> None:
        for i, x in zip(held, _features_of_many([raws[i].ljust(WINDOW, b"\xff") for i in held]) if held else [], strict=True):
            out[i] = x
        held.clear()

    for i, raw in enumerate(raws):
        if len(raw) > SEGMENT:
            out[i] = _features_of_long(np.frombuffer(raw, np.uint8))
        elif raw:
            held.append(i)
            size += len(raw)
            if size > SEGMENT:
                flush()
                size = 0
    flush()
    return out


class Digest:
    """counts: features of each filter; bits: the filters, packed, a row for each."""

    def __init__(self, counts: np.ndarray, bits: np.ndarray):
        self.counts, self.bits = counts, bits

    @classmethod
    def of(cls, texts: list[str]) -> list[Digest]:
        return [cls._made(h) for h in features([t.encode("utf-8", "surrogatepass") for t in texts])]

    @classmethod
    def _made(cls, h: np.ndarray) -> Digest:
        chain = np.arange(len(h)) // PER_FILTER
        counts = np.bincount(chain).astype(np.uint8)
        bits = np.zeros(len(counts) * BITS, bool)
        for k in range(HASHES):
            bits[chain * BITS + (h >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
        return cls(counts, np.packbits(bits.reshape(-1, BITS), axis=1))

    def text(self) -> str:
        """Each filter's number of features and bits, in base 64; the empty string without features."""
        return base64.b64encode(np.column_stack([self.counts, self.bits]).tobytes()).decode() if len(self.counts) else ""

    @classmethod
    def read(cls, text: str) -> Digest:
        rows = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 1 + BITS // 8)
        return cls(rows[:, 0], rows[:, 1:])


def _best(a: np.ndarray, b: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The likeness of each filter of a to the filter of b that is most like it, and the other way."""
    best = [np.zeros(len(a)), np.zeros(len(b))]
    for i in range(0, len(a), block):
        x = np.unpackbits(a[i : i + block], axis=1).astype(np.float32)
        for j in range(0, len(b), block):
            y = np.unpackbits(b[j : j + block], axis=1).astype(np.float32)
            n, m = x.sum(1, dtype=np.float64)[:, None], y.sum(1, dtype=np.float64)[None, :]
            most, chance = np.minimum(n, m), n * m / BITS
            floor = np.minimum(chance + 2 * np.sqrt(chance) + SLACK * (most - chance), most - 1)
            like = np.clip((x @ y.T - floor) / (most - floor), 0, 1)
            best[0][i : i + block] = np.maximum(best[0][i : i + block], like.max(1))
            best[1][j : j + block] = np.maximum(best[1][j : j + block], like.max(0))
    return best[0], best[1]


def likeness(a: Digest, b: Digest) -> float:
    """From 0 to 1: of the digest with fewer filters (of both, if they have as many, and the mean of the two)
    the mean over its features of their filter's likeness to the best of the other's filters. Equal digests
    have 1, empty ones too; an empty one and another have 0. Filters are compared all with all: of texts of
    a megabyte some hundreds."""
    if not len(a.counts) or not len(b.counts):
        return float(len(a.counts) == len(b.counts))
    said = [float(best @ x.counts.astype(np.float64)) / float(x.counts.sum(dtype=np.int64)) for best, x in zip(_best(a.bits, b.bits), (a, b), strict=True)]
    if len(a.counts) != len(b.counts):
        return said[0] if len(a.counts) < len(b.counts) else said[1]
    return (said[0] + said[1]) / 2


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edited(text: str, other: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def _compared(rows: Iterator[tuple[int | None, str, Digest, str, Digest]], size: int = 200) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        new = [_edited(text, other) for _, text, _, other, _ in held]
        marks = Digest.of(new)
        cells = [(doc, len(text), sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), own.text(), m.text(), likeness(own, m), likeness(own, theirs)) for (doc, text, own, _, theirs), e, m in zip(held, new, marks, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _heads(keys: DataFrame, parts: int) -> list[tuple[bool, int, int]]:
    """The first key of each range of the keys in order, as (no id, ~id, mark): as many as ranges at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                for _ in batches:
                    pass

    order = [F.col("doc_id").desc_nulls_last(), F.col("mark")]
    first = keys.select("doc_id", "mark").repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "doc_id long, mark long")
    return sorted((r[0] is None, ~(r[0] or 0), r[1]) for r in first.collect())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, hot: int = 10_000) -> DataFrame:
    """RESULT's columns, a row for each document: the fingerprint of its whole text and of its edited text, in
    which the start of the next document's text takes the place of its last third, and how like its own
    fingerprint is to the edited text's and to the next document's.

    The next document is the one of the next lower id, null ids last; documents of one id stand in the order
    of a hash of their texts; the last one's next is the first. Repeated rows stand beside each other, so all
    but one of them are followed by themselves. Null texts are empty ones, and have an empty fingerprint. A
    lone document follows itself; an empty table gives no rows; other columns are dropped.

    parts (spark.sql.shuffle.partitions if None) is the number of ranges, and so of first rows that the driver
    holds. A row that stands there more than `hot` times, and as often as two ranges' rows, is read once for
    all: there are at most half as many as ranges."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    keys = stored(docs.groupBy("doc_id", "mark").agg(F.count("*").alias("n")), "fingerprint-keys")
    heads = _heads(keys, parts)
    if not heads:
        return spark.createDataFrame([], RESULT)
    total = keys.agg(F.sum("n")).first()[0]
    often = keys.where(F.col("n") > max(hot, 2 * total // len(heads)))
    many = {(r[0] is None, ~(r[0] or 0), r[1]) for r in often.collect()}
    key = (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("mark"))

    @F.pandas_udf("boolean")
    def is_often(none: pd.Series, doc: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series([k in many for k in zip(none.tolist(), (~doc).tolist(), mark.tolist(), strict=True)], dtype=bool)

    @F.pandas_udf("long")
    def place(none: pd.Series, doc: pd.Series, mark: pd.Series) -> pd.Series:
        """Twice the range, and one more for its first key."""
        out = []
        for k in zip(none.tolist(), (~doc).tolist(), mark.tolist(), strict=True):
            at = bisect_right(heads, k) - 1
            out.append(2 * at + (heads[at] == k))
        return pd.Series(out, dtype="int64")

    rows, again = docs, None
    if many:
        single = stored(docs.where(is_often(*key)).dropDuplicates(["doc_id", "mark"]), "fingerprint-often")
        same = single["mark"].eqNullSafe(often["mark"]) & single["doc_id"].eqNullSafe(often["doc_id"])
        rows, again = docs.where(~is_often(*key)).unionByName(single), _once_for_all(single.join(often, same).select(single["doc_id"], "text", "n"))
    rows = rows.withColumn("at", place(*key))
    own = F.floor(F.col("at") / 2).cast("int")
    before = F.when(F.col("at") % 2 == 1, F.array(F.struct(F.pmod(own - 1, F.lit(len(heads))).cast("int").alias("range"), F.lit(True).alias("copy"))))
    here = F.array(F.struct(own.alias("range"), F.lit(False).alias("copy")))
    rows = rows.withColumn("to", F.explode(F.concat(here, F.coalesce(before, F.array().cast("array<struct<range:int,copy:boolean>>"))))).select("to.range", "to.copy", "doc_id", "mark", "text")
    rows = rows.repartitionById(len(heads), "range").sortWithinPartitions("range", "copy", F.col("doc_id").desc_nulls_last(), "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            last = None
            for b in batches:
                for s in range(0, b.num_rows, 200):
                    some = [b.column(i).slice(s, 200).to_pylist() for i in range(4)]
                    for range_, copy, doc, text, mine in zip(*some, Digest.of(some[3]), strict=True):
                        if copy and (last is None or last[0] != range_):
                            continue  # the first copy alone is somebody's next
                        if last is not None and last[0] == range_:
                            yield (*last[1:], text, mine)
                        last = None if copy else (range_, doc, text, mine)

        yield from _compared(pairs())

    out = rows.select("range", "copy", "doc_id", "text").mapInArrow(run, RESULT)
    return out if again is None else out.unionByName(again)


def _once_for_all(rows: DataFrame, share: int = 1000) -> DataFrame:
    """Of rows (doc_id, text, n) that stand n times, the results of all but one, which are followed by
    themselves; they are dealt over tasks, `share` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            marks = Digest.of(texts)
            for x in _compared(zip(b.column(0).to_pylist(), texts, marks, texts, marks, strict=True), b.num_rows + 1):
                yield pa.RecordBatch.from_arrays([*x.columns, b.column(2)], [*x.schema.names, "n"])

    out = rows.mapInArrow(run, f"{RESULT}, n long").withColumn("n", F.col("n") - 1)
    out = out.withColumn("s", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / share) - 1))).repartition("doc_id", "s")
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), F.least(F.lit(share), F.col("n") - F.col("s") * share)))).drop("n", "s", "_")

