"""Phrases whose words stand together more often than their parts would: vertical mining.

1. Texts are cut into pieces and words where they are read, and a task's words of one language, up to a
   bounded number, are a chunk: for each of its words the list of its positions, a gap after each piece.
2. The lengths of the lists, added up over the chunks, are the words' frequencies. Which of a chunk's words
   are frequent comes back to it from the same sorted shuffle: a key's rows are let through as soon as
   they add up to enough, so no more than a handful is held, however many chunks a word is in.
3. In each chunk the list of every frequent phrase is merge-joined with the postings of the frequent words:
   where a word stands right behind an occurrence, the occurrence goes to the list of the longer phrase.
   List lengths add up to exact frequencies again, and what is frequent comes back for the next length.

Of the corpus only the frequent words and phrases are ever joined, by key; nothing is broadcast or
collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Characters that end a piece become a byte that no UTF-8 text has, the tab a space, A to Z a to z.
_GAP = b"\xff"
_TABLE = bytes(255 if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: A piece of a long text that is cut into words at once, in bytes.
_STEP = 1 << 20


class _Numbers(dict):
    """Words numbered as they come; the gap is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _words(raw: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The words and gaps of a text in runs, and whether a run ends with a gap: phrases don't go on there."""
    text = raw.translate(_TABLE)
    at = 0
    while len(text) - at > _STEP:
        cut, gap = text.rfind(_GAP, at + 1, at + _STEP), True
        if cut < 0:
            cut, gap = text.rfind(b" ", at + 1, at + _STEP), False
        if cut < 0:
            cut, gap = text.find(b" ", at + 1), False
        if cut < 0:
            break
        yield text[at:cut].replace(_GAP, b" \xff ").split() + [_GAP] * gap, gap
        at = cut
    yield text[at:].replace(_GAP, b" \xff ").split() + [_GAP], True


def _packed(at: np.ndarray) -> bytes:
    """Positions as planes of bytes: the upper ones hardly change along a list and compress to little."""
    return at.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


LISTS = "chunk long, lang string, n long, words array<binary>, lens array<int>, at binary"


def word_lists(docs: DataFrame, most: int) -> DataFrame:
    """lang, raw (bytes of a text) -> LISTS: chunks of about `most` words, cut between pieces. at: the positions
    of each word after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, size
            for lang, (numbers, parts) in held.items():
                ids = np.concatenate(parts)
                lens = np.bincount(ids, minlength=len(numbers))
                at = np.argsort(ids, kind="stable")[lens[0] :]
                words = list(numbers)[1:]
                if words:
                    cells = (pa.array([chunk]), pa.array([lang]), pa.array([len(at)]), pa.array([words], pa.list_(pa.binary())), pa.array([lens[1:].astype(np.int32)], pa.list_(pa.int32())), pa.array([_packed(at)], pa.binary()))
                    yield pa.RecordBatch.from_arrays(list(cells), [x.split(" ")[0] for x in LISTS.split(", ")])
                    chunk += 1
            held.clear()
            size = 0

        for b in batches:
            for lang, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for words, gap in _words(raw.as_py()):
                    if lang not in held:
                        held[lang] = (_Numbers({_GAP: 0}), [])
                    numbers, parts = held[lang]
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    size += len(words)
                    if gap and size >= most:
                        yield from flush()
        yield from flush()

    return docs.mapInArrow(run, LISTS)


def frequent(rows: DataFrame, keys: list[str], least: int, label: str) -> DataFrame:
    """rows: the keys, chunk, idx, n (1 or more). Those whose key's n add up to `least`, with an id of the key.
    The rows of a key come one after the other; until they reach `least` they wait, which are fewer than
    `least` rows, and all later ones pass at once."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 40
        wait, open_key, open_id = None, None, 0
        for b in batches:
            if wait is not None:
                b = pa.Table.from_batches([wait, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            cols = [b.column(names.index(k)) for k in keys]
            change = np.zeros(b.num_rows - 1, bool)
            for c in cols:
                change |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.flatnonzero(change) + 1])
            many = np.add.reduceat(b.column(names.index("n")).to_numpy().astype(np.int64), edge) >= least
            goes_on = open_key == tuple(c[0] for c in cols)
            many[0] |= goes_on
            ids = np.full(len(edge), -1, np.int64)
            new = many.copy()
            new[0] &= not goes_on
            ids[new] = next_id + np.arange(new.sum())
            next_id += int(new.sum())
            if goes_on:
                ids[0] = open_id
            if many[-1]:
                wait, open_key, open_id = None, tuple(c[int(edge[-1])] for c in cols), int(ids[-1])
            else:
                wait, open_key = b.slice(int(edge[-1])), None
            each = np.repeat(ids, np.diff(np.append(edge, b.num_rows)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(each)], [*names, "id"]).filter(pa.array(each >= 0))

    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    return stored(rows.mapInArrow(run, f"{kinds}, id long"), label)


def merged(ends: np.ndarray, phrase: np.ndarray, at: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of phrases (where each ends, which it is) and of words, both by position -> the lists of the
    phrases one word longer: their keys (phrase * n_words + word), lengths and, list after list, ends."""
    i = np.searchsorted(at, ends + 1)
    hit = i < len(at)
    hit[hit] = at[i[hit]] == ends[hit] + 1
    key = phrase[hit] * n_words + word[i[hit]]
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[edge], np.diff(np.append(edge, len(key))), (ends[hit] + 1)[order]


def _by_position(lens: np.ndarray, at: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the lists with the numbers idx: all positions in order, and which list each is of."""
    start = np.cumsum(lens) - lens
    n = lens[idx]
    flat = np.repeat(start[idx] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    own = at[flat]
    order = np.argsort(own, kind="stable")
    return own[order], np.repeat(np.arange(len(idx)), n)[order]


LONGER = "p long, w long, chunk long, idx int, n int"


def _longer(found: DataFrame, lists: DataFrame, level: int) -> DataFrame:
    """The phrases of level + 1 words of each chunk: p and w are the ids of the phrase and the word behind
    it, idx the number in the chunk, n the length of the list. found: level, chunk, idx, id."""

    def run(known: pa.Table, chunk: pa.Table) -> pa.Table:
        names = [x.split(" ")[0] for x in LONGER.split(", ")]
        by_level = known.column("level").to_numpy()
        idx, id_ = known.column("idx").to_numpy().astype(np.int64), known.column("id").to_numpy()

        def of(k: int) -> tuple[np.ndarray, np.ndarray]:
            own = np.flatnonzero(by_level == k)
            own = own[np.argsort(idx[own])]
            return idx[own], id_[own]

        no, word_ids = of(1)
        if not len(no):
            return pa.table([pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())], names)
        at, word = _by_position(chunk.column("lens").combine_chunks().flatten().to_numpy().astype(np.int64), _unpacked(chunk.column("at")[0].as_py()), no)
        ends, phrase, ids = at, word, word_ids
        for k in range(1, level + 1):
            key, n, lists_ = merged(ends, phrase, at, word, len(word_ids))
            if k < level:
                no, next_ids = of(k + 1)
                ends, phrase = _by_position(n, lists_, no)
                ids = next_ids
        return pa.table([pa.array(ids[key // len(word_ids)]), pa.array(word_ids[key % len(word_ids)]), pa.array(np.full(len(key), chunk.column("chunk")[0].as_py())), pa.array(np.arange(len(key), dtype=np.int32)), pa.array(n.astype(np.int32))], names)

    return found.groupBy("chunk").cogroup(lists.select("chunk", "lens", "at").groupBy("chunk")).applyInArrow(run, LONGER)


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact up to frequencies of 10^15."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, chunk_words: int = 2_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` phrases of two or three words by score,
    then by frequency, then by their bytes.

    A to Z are lower-cased. `.,;:!?` and the line ends U+000A to U+000D end a piece; words are what spaces and
    tabs leave of it. n is the number of words of the language, a the phrase's occurrences inside pieces,
    overlapping ones too, and at least `least`; l and r are those of its two parts at the cut with the lowest
    score, the earlier one of equals. A phrase inside a longer one that has at least `share` percent of its
    occurrences is left out. Null texts have no words, null languages are `und`; repeated rows count each
    time; tables without words give no rows; other columns are dropped."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    lists = stored(word_lists(texts, chunk_words), "phrase-lists")
    rows = lists.select("lang", "chunk", F.posexplode(F.arrays_zip(F.col("words").cast("array<string>").alias("word"), F.col("lens").alias("n"))).alias("idx", "x"))
    found = frequent(rows.select("lang", F.col("x.word").alias("word"), "chunk", "idx", F.col("x.n").alias("n")), ["lang", "word"], least, "phrase-words")
    words = stored(found.groupBy("id").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("f")), "phrase-word-counts")
    known = found.select(F.lit(1).alias("level"), "chunk", "idx", "id")
    found = frequent(_longer(known, lists, 1), ["p", "w"], least, "phrase-pairs")
    pairs = stored(found.groupBy("id").agg(F.first("p").alias("p"), F.first("w").alias("w"), F.sum("n").alias("a")), "phrase-pair-counts")
    known = known.unionByName(found.select(F.lit(2).alias("level"), "chunk", "idx", "id"))
    triples = _longer(known, lists, 2).groupBy("p", "w").agg(F.sum("n").alias("a")).where(F.col("a") >= least)

    word = lambda no: words.select(F.col("id").alias(f"w{no}"), F.col("word").alias(f"word{no}"), F.col("f").alias(f"f{no}"), *([F.col("lang")] if no == 1 else []))
    first = pairs.select(F.col("id").alias("p"), F.col("p").alias("w1"), F.col("w").alias("w2"), F.col("a").alias("f12"))
    second = pairs.select(F.col("id").alias("pair23"), F.col("p").alias("w2"), F.col("w").alias("w3"), F.col("a").alias("f23"))
    three = stored(triples.join(first, "p").withColumnRenamed("w", "w3").join(second, ["w2", "w3"]), "phrase-triples")
    three_ = three.join(word(1), "w1").join(word(2).drop("f2"), "w2").join(word(3), "w3")
    three_ = three_.withColumn("s1", score("a", "f1", "f23")).withColumn("s2", score("a", "f12", "f3"))
    early = F.col("s1") <= F.col("s2")
    three_ = three_.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))

    inside = three.select(F.col("p").alias("id"), F.col("a").alias("longer")).unionByName(three.select(F.col("pair23").alias("id"), F.col("a").alias("longer"))).groupBy("id").agg(F.max("longer").alias("longer"))
    two = pairs.join(inside, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    two = two.select(F.col("p").alias("w1"), F.col("w").alias("w2"), "a").join(word(1), "w1").join(word(2), "w2")
    two = two.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("a", "f1", "f2").alias("score"))

    # a language's candidates are dealt over parts by their bytes; of each part at most `top` go on
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = two.unionByName(three_).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = lists.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
