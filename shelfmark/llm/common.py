"""Helpers that several corpus operators share."""

from __future__ import annotations

import zlib

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import kept as stored

#: Characters that end a word besides the space: tab, line feed, vertical tab, form feed, carriage return.
_SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, null texts as empty ones; any other
    column, clashing names included, is pruned at the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def words_of(text: str) -> list[str]:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    for c in _SPACES:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m."""
    return F.crc32(id_col.cast("string").cast("binary")) % m


def py_crc_mod(value: int, m: int) -> int:
    return zlib.crc32(str(value).encode()) % m


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, remembered for the frequent ones; forgets everything at max_size."""

    def __init__(self, max_size: int = 1 << 19):
        from xxhash import xxh3_64_intdigest

        self.hash, self.max_size, self.known = xxh3_64_intdigest, max_size, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.max_size:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            h = self.hash
            for w in set(words).difference(known):
                known[w] = h(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def ranges(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive runs."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text", rows: int = 500) -> DataFrame:
    """The documents, all columns as they are, whose text the judge that `make` builds in the task says
    true to; null texts are judged as empty ones."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for b in batches:
            for s in range(0, b.num_rows, rows):
                part = b.slice(s, rows)
                yield part.filter(pa.array(judge([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["WordHashes", "crc_mod", "id_text", "keep_rows", "mix64", "py_crc_mod", "ranges", "stored", "table", "words_of"]
