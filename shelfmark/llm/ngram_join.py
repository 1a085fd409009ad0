"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Each document's distinct five-word shingles give a set hash and a MinHash signature. Documents of the
   same set are one node; what follows works on nodes, so copies cost nothing.
2. Nodes that share a band of the signature are compared there, MinHash value by value: a pair is dropped
   as soon as the posterior probability that its similarity reaches the threshold falls under a
   tolerance. A pair is taken up only in the first band it shares. The survivors' pairs never leave the
   task; a spanning forest of theirs does, and its connected components are groups whose members are
   alike by estimate.
3. In each group every pair is taken up once more with the shingles at hand: pruned the same way, then
   verified exactly. Out come each node's number of links and a spanning forest of the verified links,
   whose connected components are the classes.

A bucket or group larger than a block is cut into blocks by a hash of the node, and each pair of blocks
is a work item of its own, so a hot bucket is spread over many tasks and no task holds more than two
blocks. No pairs are written anywhere, and nothing that grows with the input reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, id_text, mix64, stored, words_of
from .quality_rules import batches_by_size

WORDS = 5
ROWS, BANDS = 4, 28
SIZE = ROWS * BANDS
STEP = 16
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64)


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit keys of the text's five-word shingles; a shorter text is one shingle."""
    h = hashes(words_of(text))
    if not len(h):
        return h
    n = min(WORDS, len(h))
    key = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        key = mix64(key) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(mix64(key))


def node_of(keys: np.ndarray) -> int:
    """A 64-bit hash of a shingle set."""
    total = mix64(keys + np.uint64(0x51)).sum(dtype=np.uint64) + np.uint64(len(keys))
    return int(mix64(np.array([total]))[0].astype(np.int64))


def signature(keys: np.ndarray) -> np.ndarray:
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(keys), 4096):
        part = keys[at : at + 4096]
        out = np.minimum(out, ((part[None, :] * _MUL[:, None] + _ADD[:, None]) >> np.uint64(32)).min(1).astype(np.uint32))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    s = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))[None, :].repeat(len(s), 0)
    for r in range(ROWS):
        key = mix64(key + s[:, :, r])
    return key


def _tail(t: float, a: int, b: int) -> float:
    """P(X >= t) for X of the beta distribution with whole a and b, as a binomial sum."""
    n = a + b - 1
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(t) + (n - j) * math.log1p(-t)) for j in range(a))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each STEP values more, the fewest matches with which P(similarity >= threshold), under a
    uniform prior, is still at least the tolerance."""
    return [next(m for m in range(n + 1) if m == n or _tail(threshold, m + 1, n - m + 1) >= tolerance) for n in range(STEP, SIZE + 1, STEP)]


def survive(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the paired signatures pass all steps."""
    alive, m = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        cut = slice(k * STEP, (k + 1) * STEP)
        m = m + (a[alive, cut] == b[alive, cut]).sum(1)
        keep = m >= need
        alive, m = alive[keep], m[keep]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index of each index's connected component."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        go = a != b
        if not go.any():
            return label
        i, j, a, b = i[go], j[go], a[go], b[go]
        # labels are roots here: the greater root of an edge goes under the lesser, with all that it carries
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that end where a group ends, of about `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0

    def take(last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
        if rows is None or last:
            return rows, []
        cols = [rows.column(rows.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        at = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
        return (rows.slice(0, at) if at else None), [rows.slice(at)]

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= most:
            rows, held = take(False)
            size = 0
            if rows is not None:
                yield rows
    rows, held = take(True)
    if rows is not None:
        yield rows


def _borders(*cols: np.ndarray) -> np.ndarray:
    change = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(cols[0])]])


def _fixed(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, root: the least node of each connected component, for nodes with an edge (a, b). Least
    labels go over the edges and then jump to their own label's label; each round is a table in the
    shared folder, and the rounds end when no label changes."""
    edges = stored(edges.where("a <> b").distinct(), f"{label}-edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), f"{label}-roots")
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = now.join(near, now["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = stored(step, f"{label}-step")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = stored(step.join(up, "root", "left").select("node", "old", F.least("root", "up").alias("root")), f"{label}-roots")
        now = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return now


def _read_docs(docs: DataFrame) -> DataFrame:
    """doc_id, text, copy_key (a hash of the whole text) -> the same without the text, node, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            at = 0
            for ids, texts in batches_by_size(b):
                node, sig = [], []
                for t in texts:
                    s = shingles(t, hashes)
                    node.append(node_of(s))
                    sig.append(signature(s).tobytes())
                key = b.column(2).slice(at, len(ids))
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), key, pa.array(node, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "copy_key", "node", "sig"])

    return docs.select("doc_id", "text", "copy_key").mapInArrow(run, "doc_id long, copy_key long, node long, sig binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                keys = band_keys(_fixed(part.column(1), "<u4", SIZE)).view(np.int64)
                node = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(node))), pa.array(node.repeat(BANDS))], ["bucket", "band", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "bucket long, band int, node long")


def _blocks(rows: DataFrame, size: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: lo, hi, own."""
    m = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), m).cast("int")
    return rows.withColumn("own", own).withColumn("j", F.explode(F.sequence(F.lit(0), m - 1))).withColumn("lo", F.least("own", "j")).withColumn("hi", F.greatest("own", "j")).drop("j", size)


def _candidate_forest(rows: DataFrame, least: list[int]) -> DataFrame:
    """rows: bucket, band, node, own, lo, hi, sig, sorted by bucket and blocks -> a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in _whole_groups(batches, ["bucket", "lo", "hi"], 8 << 20):
            get = lambda k: rb.column(rb.schema.get_field_index(k))  # noqa: B023, E731
            bucket, lo, hi, own, band, node = (get(k).to_numpy(zero_copy_only=False) for k in ("bucket", "lo", "hi", "own", "band", "node"))
            sig = _fixed(get("sig"), "<u4", SIZE)
            keys = band_keys(sig)
            edge = _borders(bucket, lo, hi)
            end = np.repeat(edge[1:], np.diff(edge))
            later = end - np.arange(len(end)) - 1
            distinct, at = np.unique(node, return_inverse=True)
            label = np.arange(len(distinct))
            s = 0
            total = np.concatenate([[0], np.cumsum(later)])
            while s < len(later):  # rows s to e, about 200,000 pairs
                e = max(s + 1, int(np.searchsorted(total, total[s] + 200_000, side="right")) - 1)
                i = np.repeat(np.arange(s, e), later[s:e])
                j = i + 1 + np.arange(len(i)) - np.repeat(total[s:e] - total[s], later[s:e])
                s = e
                keep = ((lo[i] == hi[i]) | (own[i] != own[j])) & (node[i] != node[j])
                i, j = i[keep], j[keep]
                first = (keys[i] == keys[j]).argmax(1) == band[i]
                i, j = i[first], j[first]
                ok = survive(sig[i], sig[j], least)
                a, b = label[at[i[ok]]], label[at[j[ok]]]
                if len(a):
                    label = _forest(a, b, len(distinct))[label]
            out = np.flatnonzero(label != np.arange(len(distinct)))
            yield pa.RecordBatch.from_arrays([pa.array(distinct[out]), pa.array(distinct[label[out]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _with_shingles(rows: DataFrame) -> DataFrame:
    """rows: text, node and others -> the shingle keys in the text's place. A node that stands there again,
    for a repeated row, is read once by a task, or once in `most` nodes; a text of another node, whose hash
    is the same by chance, goes."""
    others = [c for c in rows.columns if c != "text"]
    most = 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            new = []
            for node in b.column(1).to_pylist():
                new.append(node not in seen)
                seen.add(node)
            if len(seen) > most:
                seen.clear()
            b = b.filter(pa.array(new, pa.bool_()))
            keys = [shingles(t, hashes) for t in b.column(0).to_pylist()]
            own = pa.array([node_of(k) for k in keys], pa.int64()).to_numpy() == b.column(1).to_numpy(zero_copy_only=False)
            out = pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), *(b.column(i) for i in range(1, b.num_columns))], ["keys", *others])
            yield out.filter(pa.array(own))

    kinds = dict(rows.dtypes)
    return rows.select("text", *others).mapInArrow(run, ", ".join(["keys binary", *(f"{c} {kinds[c]}" for c in others)]))


def _verified(rows: DataFrame, threshold: float, least: list[int]) -> DataFrame:
    """rows: root, node, own, lo, hi, keys, sorted by root and blocks -> a, b, links: a's links here,
    and one of its edges in the spanning forest of the verified links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in _whole_groups(batches, ["root", "lo", "hi"], 16 << 20):
            get = lambda k: rb.column(rb.schema.get_field_index(k))  # noqa: B023, E731
            root, lo, hi, own, node = (get(k).to_numpy(zero_copy_only=False) for k in ("root", "lo", "hi", "own", "node"))
            raw = get("keys").to_pylist()
            edge = _borders(root, lo, hi)
            out: tuple[list, list, list] = ([], [], [])
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                # a node that stands there more than once counts once
                _, pick = np.unique(node[s:e], return_index=True)
                pick = pick[np.argsort(own[s:e][pick], kind="stable")] + s
                if len(pick) < 2:
                    continue
                links, label = _compare([np.frombuffer(raw[p], "<u8") for p in pick], own[pick], lo[s] == hi[s], threshold, least)
                some = np.flatnonzero(links)
                out[0].append(node[pick[some]])
                out[1].append(node[pick[label[some]]])
                out[2].append(links[some])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b", "links"])

    return rows.mapInArrow(run, "a long, b long, links long")


def _compare(keys: list[np.ndarray], own: np.ndarray, inside: bool, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set, and the least index of its component. Rows are in order of their block; unless
    `inside`, only pairs of different blocks count."""
    n = len(keys)
    size = np.fromiter(map(len, keys), np.int64, n)
    sig = np.stack([signature(k) for k in keys])
    distinct, flat = np.unique(np.concatenate(keys), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    links, label = np.zeros(n, np.int64), np.arange(n)
    mark = np.zeros(len(distinct) + 1, np.int32)
    border = int(np.searchsorted(own, own[-1]))
    for i in range(n - 1 if inside else border):
        lo = i + 1 if inside else border
        j = lo + np.flatnonzero(survive(np.broadcast_to(sig[i], (n - lo, SIZE)), sig[lo:], least))
        if not len(j):
            continue
        mine = flat[at[i] : at[i + 1]]
        mark[mine] = 1
        if len(j) * 4 > n - lo:
            total = np.concatenate([[0], np.cumsum(mark[flat[at[lo] :]])])
            both = (total[at[lo + 1 :] - at[lo]] - total[at[lo:-1] - at[lo]])[j - lo]
        else:
            both = np.fromiter((mark[flat[at[k] : at[k + 1]]].sum() for k in j), np.int64, len(j))
        mark[mine] = 0
        j = j[both >= threshold * (size[i] + size[j] - both) - 1e-9]
        if len(j):
            links[i] += len(j)
            links[j] += 1
            old = np.unique(label[np.append(j, i)])
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    return links, label


def _classes(docs: DataFrame, threshold: float, tolerance: float, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents as read, and node, copy_id, n_copies, head, root, n_links of each node: root is the
    class, head the first of the node's rows, null ids last."""
    docs = id_text(docs, id_col, text_col).withColumn("copy_key", F.xxhash64("text"))
    least = least_matches(threshold, tolerance)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "copy_key")
    read = stored(_read_docs(docs), "nj-docs")
    nodes = stored(read.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.min(row).alias("head"), F.first("sig").alias("sig")), "nj-nodes")
    bands = _bands(nodes)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = _blocks(bands.join(shared, "bucket"), "n", block).join(nodes.select("node", "sig"), "node")
    met = met.select("bucket", "band", "node", "own", "lo", "hi", "sig").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    groups = components(_candidate_forest(met, least), "nj-groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    members = groups.join(sizes, "root").join(nodes.select("node", F.col("head.doc_id").alias("head_id"), F.col("head.copy_key").alias("head_key")), "node")
    # by the text's hash, so rows without an id, or with one id, don't all meet
    same = (docs["copy_key"] == members["head_key"]) & docs["doc_id"].eqNullSafe(members["head_id"])
    texts = docs.join(members, same).select("text", "node", "root", "n")
    rows = _blocks(_with_shingles(texts), "n", block).repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    links = stored(_verified(rows, threshold, least), "nj-links")
    classes = components(links.select("a", "b"), "nj-classes")
    n_links = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    small = nodes.select("node", "copy_id", "n_copies", "head").join(classes, "node", "left").join(n_links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return read, small


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least id among the documents that chains of links
    join), copy_id (the least id among those of the same shingle set), n_copies (their number), n_links
    (other shingle sets whose Jaccard similarity with this one is at least the threshold).

    Words are runs other than space and U+0009 to U+000D, case kept; a text of under five words is a
    single shingle. Texts without words, nulls included, have the same, empty set: they are copies of
    each other and linked to nothing else. Two sets are taken for the same if their 64-bit hashes are.
    A pair at the threshold is missed with a probability of at most about (1 - threshold^4)^28 plus the
    tolerance. Repeated rows are copies and give repeated rows; null ids are allowed and are no class_id
    unless a class has no other; an empty table gives no rows; other columns are dropped."""
    read, small = _classes(docs, threshold, tolerance, block, id_col, text_col)
    heads = small.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    small = small.join(heads, "root").select("node", "class_id", "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return read.select("doc_id", "node").join(small, "node").select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def one_of_each_class(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each class of `near_duplicates`: the one of the least id, null ids
    last, and of those the one of the least set and text hash. Rows are told apart by id and text, so a
    row without an id stays where its class has no other, and an id whose texts head two classes stays
    twice; of rows with the same id and text any one stays. An empty table gives no rows; other columns,
    whatever their names, stay as they are."""
    _, small = _classes(docs, threshold, tolerance, block, id_col, text_col)
    first = small.groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.doc_id").alias("head_id"), "head.copy_key")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    rows = rows.join(first, (F.col("key") == F.col("copy_key")) & F.col("id").eqNullSafe(F.col("head_id")), "left_semi")
    return rows.dropDuplicates(["id", "key"]).select("row.*")
