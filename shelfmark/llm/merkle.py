"""Merkle manifest of a dataset: one tree a source, one tree over the sources, and a proof for each row.

Leaf digests are made where the rows are read. They are put in order by range partitioning and numbered
by the sizes of the partitions, so a source may hold any share of the rows. Aligned blocks of
fanout^height consecutive nodes are one row each; in a task a block is a contiguous matrix of 64-byte hex
digests, which is reshaped by the fanout and hashed row by row, level after level. The blocks' tops are
the next pass's nodes, until each tree has one. Proofs go the other way: a block takes the path of its own
top, and index arithmetic gives each node's siblings on every level inside the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

HEX = 64
PATH = "tree string, pos long, subroot string, root string, siblings binary, before array<int>, among array<int>"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(*columns: Column) -> Column:
    """The digest (binary) of columns: each is '-' if null, else its length in UTF-8 bytes, ':' and its text."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.unhex(F.sha2(F.concat(*(part(c.cast("string")) for c in columns)).cast("binary"), 256))


def rises(size: int, fanout: int) -> int:
    """Levels between so many nodes and their root."""
    k = 0
    while size > 1:
        size, k = -(-size // fanout), k + 1
    return k


def _hashed(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sha256(r).hexdigest().encode() for r in rows), np.uint8).reshape(-1, HEX)


def matrices(leaves: np.ndarray, fanout: int, levels: int) -> list[np.ndarray]:
    """The digests (n, 64) of a block and of the levels above them."""
    out = [leaves]
    for _ in range(levels):
        m = out[-1]
        whole = len(m) // fanout * fanout
        rows = [r.tobytes() for r in m[:whole].reshape(-1, fanout * HEX)]
        if whole < len(m):
            rows.append(m[whole:].tobytes())
        out.append(_hashed(rows))
    return out


def runs(n: int, fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of n nodes: where its run begins and ends, and how many of the run stand before it."""
    at = np.arange(n)
    start = at - at % fanout
    return start, np.minimum(start + fanout, n), at - start


def numbered(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """nodes (tree, and others) with pos, the place in the tree in the order given, and size, the nodes of
    the tree. Equal rows are dealt out too, as each has a number of its own in the partitioning."""
    keys = ["tree", *order, "_row"]
    rows = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    at = rows.columns.index("tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            each = pc.run_end_encode(b.column(at))
            ends, trees = each.run_ends.to_numpy(), each.values
            starts = np.concatenate([[0], ends[:-1]])
            no = np.arange(b.num_rows) - np.repeat(starts, ends - starts)
            if trees[0].as_py() == last:
                no[: ends[0]] += n
            last, n = trees[-1].as_py(), int(no[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(no)], [*b.schema.names, "part", "no"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    rows = stored(rows.mapInArrow(run, f"{kinds}, part int, no long"), label)
    parts = rows.groupBy("part", "tree").agg((F.max("no") + 1).alias("n"))
    tree = Window.partitionBy("tree")
    parts = parts.select("part", "tree", F.sum("n").over(tree).alias("size"), (F.sum("n").over(tree.orderBy("part")) - F.col("n")).alias("start"))
    return rows.join(parts, ["part", "tree"]).withColumn("pos", F.col("start") + F.col("no")).drop("part", "no", "start")


def _tops(blocks: DataFrame, fanout: int, height: int) -> DataFrame:
    """tree, pos, size, digest: the blocks' tops as nodes of the next pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, nodes = b.column(2).to_pylist(), b.column(3).to_pylist()
            tops, sizes = [], []
            for n, own in zip(size, nodes, strict=True):
                up = min(height, rises(n, fanout))
                tops.append(bytes.fromhex(matrices(_digests(own), fanout, up)[-1].tobytes().decode()))
                sizes.append(-(-n // fanout**up))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(tops, pa.binary())], ["tree", "pos", "size", "digest"])

    return blocks.select("tree", "block", "size", "digests").mapInArrow(run, "tree string, pos long, size long, digest binary")


def _digests(own: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(own).hex().encode(), np.uint8).reshape(-1, HEX)


def build(nodes: DataFrame, more: list[str], fanout: int, height: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """nodes: tree, pos, size, digest and `more`. The blocks of each pass, those of the first with `more` as
    lists, and tree, passes (the last pass with blocks of the tree), digest of each tree's root."""
    span, passes, roots = fanout**height, [], None
    while True:
        each = nodes.groupBy("tree", F.floor(F.col("pos") / span).alias("block")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "digest", *more))).alias("rows"))
        lists = [F.col(f"rows.{c}").alias(name) for c, name in [("digest", "digests"), *((c, c) for c in more)]]
        blocks = stored(each.select("tree", "block", "size", *lists), f"{label}-blocks")
        tops = stored(_tops(blocks, fanout, height), f"{label}-tops")
        done = tops.where("size = 1").select("tree", F.lit(len(passes)).alias("passes"), "digest")
        roots = done if roots is None else roots.unionByName(done)
        passes.append(blocks)
        nodes, more = tops.where("size > 1"), []
        if nodes.isEmpty():
            return passes, roots


def _paths(fanout: int, height: int, size: int, own: list[bytes], tail: tuple[bytes, list[int], list[int]]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Of each node of a block: its siblings on all levels up to the root, as one run of digests, and for
    each level how many of them stand before the node, and how many there are."""
    levels = matrices(_digests(own), fanout, min(height, rises(size, fanout)))[:-1]
    above = [tail]
    for m in reversed(levels):
        raw, n = m.tobytes(), len(m)
        start, end, before = (x.tolist() for x in runs(n, fanout))
        paths = []
        for j in range(n):
            sib, b, a = above[j // fanout] if m is not levels[-1] else tail
            paths.append((raw[HEX * start[j] : HEX * j] + raw[HEX * (j + 1) : HEX * end[j]] + sib, [before[j], *b], [end[j] - start[j] - 1, *a]))
        above = paths
    yield from above


def folded(leaf: str, siblings: bytes, before: list[int], among: list[int]) -> str:
    """The root that a leaf and its siblings give."""
    node, at = leaf.encode(), 0
    for b, n in zip(before, among, strict=True):
        left, right = siblings[at : at + HEX * b], siblings[at + HEX * b : at + HEX * n]
        node, at = sha256(left + node + right).hexdigest().encode(), at + HEX * n
    return node.decode()


def _opened(passes: list[DataFrame], tails: DataFrame, fanout: int, height: int, label: str) -> DataFrame:
    """The blocks of the first pass, each with the path of its own top. tails: tree, passes and PATH's
    columns of each tree's root."""
    span, at = fanout**height, ["subroot", "root", "siblings", "before", "among"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                first = row["block"] * span
                got = list(_paths(fanout, height, row["size"], row["digests"], (row["siblings"], row["before"], row["among"])))
                yield pa.RecordBatch.from_pylist([{"tree": row["tree"], "pos": first + i, "subroot": row["subroot"], "root": row["root"], "siblings": s, "before": x, "among": n} for i, (s, x, n) in enumerate(got)], b_schema)

    b_schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("siblings", pa.binary()), ("before", pa.list_(pa.int32())), ("among", pa.list_(pa.int32()))])
    above = None
    for k in range(len(passes) - 1, -1, -1):
        ends = tails.where(F.col("passes") == k).select("tree", F.lit(0).cast("long").alias("block"), *at)
        if above is not None:
            ends = ends.unionByName(above.select("tree", F.col("pos").alias("block"), *at))
        opened = passes[k].join(ends, ["tree", "block"])
        if k:
            above = stored(opened.select("tree", "block", "size", "digests", *at).mapInArrow(run, PATH), f"{label}-paths")
    return opened


def prove(leaves: DataFrame, fanout: int = 16, height: int = 3, with_siblings: bool = False) -> DataFrame:
    """Of leaves (source, doc_id, digest, presented): PROOF's columns, for every row. A source's leaves stand by
    doc_id, null ids first, and among equal ids by digest; sources stand by their bytes, the null one first.
    folded_root is what `presented` (null: the leaf itself) gives with the leaf's siblings, verified whether
    that is the root; with_siblings adds the siblings, one list for each level.

    Each run of `fanout` nodes, the last one shorter, becomes the digest of its digests in hex, while a tree
    has more than one node; the digest of the lone node of a last run is one of one. Repeated rows are leaves
    of their own and, being equal, may change places; an empty table gives no rows."""
    # the null source comes first, and no other is like it
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    nodes = stored(leaves.select(tree.alias("tree"), "doc_id", "digest", "presented"), "merkle-leaves")
    passes, roots = build(numbered(nodes, ["doc_id", "digest"], "merkle-rows"), ["doc_id", "presented"], fanout, height, "merkle")
    sources = stored(roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "passes", "digest"), "merkle-sources")
    shelf, top = build(numbered(sources, ["source"], "merkle-order"), ["source", "passes"], fanout, height, "merkle-top")
    text = lambda c: F.lower(F.hex(c))
    none = F.array().cast("array<int>")
    start = top.select("tree", "passes", F.lit("").alias("subroot"), text("digest").alias("root"), F.lit(b"").alias("siblings"), none.alias("before"), none.alias("among"))
    tails = stored(_tails(_opened(shelf, start, fanout, height, "merkle-top"), fanout, height), "merkle-tails")
    return _proofs(_opened(passes, tails, fanout, height, "merkle"), fanout, height, with_siblings)


def _tails(opened: DataFrame, fanout: int, height: int) -> DataFrame:
    """Of the blocks of subroots: tree, passes and the path of each subroot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                paths = _paths(fanout, height, row["size"], row["digests"], (row["siblings"], row["before"], row["among"]))
                for source, done, own, (s, x, n) in zip(row["source"], row["passes"], row["digests"], paths, strict=True):
                    yield pa.RecordBatch.from_pylist([{"tree": source, "passes": done, "subroot": own.hex(), "root": row["root"], "siblings": s, "before": x, "among": n}], schema)

    schema = pa.schema([("tree", pa.string()), ("passes", pa.int32()), ("subroot", pa.string()), ("root", pa.string()), ("siblings", pa.binary()), ("before", pa.list_(pa.int32())), ("among", pa.list_(pa.int32()))])
    return opened.mapInArrow(run, "tree string, passes int, subroot string, root string, siblings binary, before array<int>, among array<int>")


def _proofs(opened: DataFrame, fanout: int, height: int, with_siblings: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                paths = _paths(fanout, height, row["size"], row["digests"], (row["siblings"], row["before"], row["among"]))
                out: list[list] = [[] for _ in names]
                for doc, own, other, (sib, before, among) in zip(row["doc_id"], row["digests"], row["presented"], paths, strict=True):
                    leaf = own.hex()
                    root = folded(leaf if other is None else other.hex(), sib, before, among)
                    cells = [doc, leaf, row["subroot"], row["root"], sha256(sib).hexdigest(), root, root == row["root"]]
                    if with_siblings:
                        end = np.cumsum([0, *among]).tolist()
                        cells.append([[sib[HEX * i : HEX * (i + 1)].decode() for i in range(s, e)] for s, e in zip(end, end[1:])])
                    for column, cell in zip(out, cells, strict=True):
                        column.append(cell)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names)

    text = pa.string()
    names = [x.split(" ")[0] for x in PROOF.split(", ")] + ["siblings"] * with_siblings
    kinds = [pa.int64(), *[text] * 5, pa.bool_(), pa.list_(pa.list_(text))][: len(names)]
    return opened.mapInArrow(run, PROOF + ", siblings array<array<string>>" * with_siblings)


def document_leaves(docs: DataFrame, presented: Column | None = None, shown: Column | None = None) -> DataFrame:
    """The leaves of documents: doc_id, source, lang, n_chars and text. Where `shown` holds, a leaf with the
    text `presented` is shown against the proof. Other columns are dropped."""
    rest = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    other = F.lit(None).cast("binary") if presented is None else F.when(shown, leaf_digest(*rest, presented))
    return docs.select("source", rest[0].alias("doc_id"), leaf_digest(*rest, F.col("text")).alias("digest"), other.alias("presented"))
