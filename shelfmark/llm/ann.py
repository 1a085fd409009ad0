"""Nearest neighbours by inner product: stable projections, a kd-tree, and a chi-square stopping test.

Vectors are dealt into bands of like length. Inside a band inner product becomes Euclidean distance: every
vector gets one more component that gives all of them the band's greatest length, a query gets 0 there.
Gaussian (2-stable) projections, made orthogonal, are indexed by kd-trees: the upper levels of each band's
tree, fitted on a bounded sample, name cells that Spark deals out; each cell, cut into blocks of bounded
size, gets the lower levels in its task. The squared projected distance of a point over its squared true
distance follows a chi-square law (orthogonal projections spread less, so the law is on the safe side). A
point that would be nearer than the k-th found therefore lies, with the chosen confidence, within a known
multiple of the k-th's distance in the projection: trees are walked by the distance of their boxes and
stop beyond it, and of a leaf's points only those within it are verified on the original vectors.

A first pass looks into the cells that promise most, which settles a k-th score for each query; a second
one goes to the cells that can still win. Of copies of one vector only the k + 1 least ids can be anybody's
neighbours, so a hot vector leaves no more. Queries and blocks meet in work items of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

DIMS = 24
LEAF = 256
#: Bands of length in a doubling of it.
BANDS = 8


def chi_square_cdf(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Of an even number of dims, in closed form."""
    half = np.minimum(x, 1e4) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def stop_ratio(confidence: float, dims: int = DIMS) -> float:
    """The squared projected over squared true distance that a share `confidence` stays under."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(np.array(mid), dims) < confidence else (lo, mid)
    return hi


def band_of(x: np.ndarray) -> np.ndarray:
    """The band of each vector's length, borders away from the powers of two."""
    top = np.abs(x).max(1)
    return np.floor(BANDS * (np.log2(top) + 0.5 * np.log2(((x / top[:, None]) ** 2).sum(1))) + 0.5).astype(np.int64)


def _split(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Median cuts of the widest dimension down to leaves of at most `leaf` points."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        i = todo.pop()
        if len(i) <= leaf:
            done.append(i)
            continue
        own = points[i]
        order = np.argsort(own[:, int(np.ptp(own, axis=0).argmax())], kind="stable")
        half = len(i) // 2
        todo += [i[order[half:]], i[order[:half]]]
    return done


def _box_distance(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, a row for each point."""
    far = np.zeros((len(p), len(low)))
    for d in range(p.shape[1]):
        at = p[:, d, None]
        far += np.maximum(0, np.maximum(low[None, :, d] - at, at - high[None, :, d])) ** 2
    return far


@dataclass
class Tree:
    """The upper levels of a band's kd-tree: inner nodes (axis, cut) in heap order, all leaves at one depth."""

    reach: float
    first: int
    depth: int
    axis: np.ndarray
    cut: np.ndarray

    def leaf(self, p: np.ndarray) -> np.ndarray:
        at = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            at = 2 * at + (p[np.arange(len(p)), self.axis[at]] > self.cut[at])
        return at - (1 << self.depth)


@dataclass
class Cells:
    matrix: np.ndarray
    trees: dict[int, Tree]

    def project(self, x: np.ndarray, reach: np.ndarray | None = None) -> np.ndarray:
        """Of queries, or of vectors that are brought to the squared length `reach`."""
        p = x @ self.matrix[:-1]
        return p if reach is None else p + np.sqrt(np.maximum(0, reach - (x * x).sum(1)))[:, None] * self.matrix[-1]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, projections and reaches."""
        cell, reach, p = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros((len(x), DIMS))
        bands = band_of(x)
        for band in np.unique(bands):
            at, tree = bands == band, self.trees[int(band)]
            reach[at] = tree.reach
            p[at] = self.project(x[at], reach[at])
            cell[at] = tree.first + tree.leaf(p[at])
        return cell, p, reach


def fit_cells(sample: np.ndarray, bands: list[tuple[int, int, float]], dims: int, block: int, seed: int = 5) -> Cells:
    """bands: (band, rows, greatest squared length). A tree has about a cell for each `block` rows of its
    band, and at least 8 sampled rows for each cell."""
    basis = np.random.default_rng(seed).standard_normal((max(dims + 1, DIMS), DIMS))
    matrix = np.linalg.qr(basis)[0][: dims + 1] * np.sqrt(dims + 1) if dims + 1 >= DIMS else basis[: dims + 1]
    cells, of, first = Cells(matrix, {}), band_of(sample), 0
    for band, rows, reach in bands:
        own = sample[of == band]
        depth = max(0, min(int(np.ceil(np.log2(max(1, rows / block)))), int(np.log2(max(1, len(own) / 8)))))
        tree = Tree(reach, first, depth, np.zeros(1 << depth, np.int64), np.zeros(1 << depth))
        p = cells.project(own, np.full(len(own), reach))
        held = {1: np.arange(len(p))}
        for at in range(1, 1 << depth):
            i = held.pop(at)
            if len(i):
                tree.axis[at] = int(np.ptp(p[i], axis=0).argmax())
                tree.cut[at] = np.median(p[i, tree.axis[at]])
            right = p[i, tree.axis[at]] > tree.cut[at]
            held[2 * at], held[2 * at + 1] = i[~right], i[right]
        cells.trees[band], first = tree, first + (1 << depth)
    return cells


class Block:
    """The lower levels of the kd-tree over one block's rows of one reach, and its search. seen and
    verified count pairs of a query and a vector: all, and those whose true score was worked out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray, reach: float):
        leaves = _split(p, LEAF)
        order = np.concatenate(leaves)
        self.ids, self.x, self.p, self.reach = ids[order], x[order], p[order], reach
        self.pp = (self.p * self.p).sum(1)
        self.edge = np.concatenate([[0], np.cumsum([len(i) for i in leaves])])
        self.low = np.array([p[i].min(0) for i in leaves])
        self.high = np.array([p[i].max(0) for i in leaves])
        self.seen = self.verified = 0

    def _scores(self, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Row by row, so equal vectors get equal scores wherever they lie; in runs that stay in the cache."""
        out = np.empty(len(r))
        for s in range(0, len(r), 2048):
            cut = slice(s, s + 2048)
            out[cut] = (q[r[cut]] * self.x[c[cut]]).sum(1)
        return out

    def _apart(self, leaf: np.ndarray, row: np.ndarray, pq: np.ndarray, pp: np.ndarray) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
        """Leaf by leaf the queries that go there, its rows, and their squared projected distances."""
        by = np.argsort(leaf, kind="stable")
        edge = np.concatenate([[0], np.flatnonzero(np.diff(leaf[by])) + 1, [len(by)]]) if len(by) else [0]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            mine, here = row[by[s:e]], slice(self.edge[leaf[by[s]]], self.edge[leaf[by[s]] + 1])
            yield mine, here, pp[mine][:, None] + self.pp[here][None] - 2 * (pq[mine] @ self.p[here].T)

    def search(self, qid: np.ndarray, q: np.ndarray, pq: np.ndarray, k: int, ratio: float, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k (score, id) of each query; slots without one have the score minus infinity. bound:
        a score that is already found elsewhere for the k-th place.

        A query without one starts with the nearest of its nearest leaf. Then the points within the limit,
        which shrinks with the k-th score, are verified from the nearer to the farther in the projection."""
        n = len(qid)
        best, who = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        far = _box_distance(self.low, self.high, pq)
        qq, pp = (q * q).sum(1), (pq * pq).sum(1)
        slack = 1e-9 * (1 + ratio) * (self.reach + qq)
        self.seen += n * len(self.ids)

        def limit() -> np.ndarray:  # infinite while there is no k-th
            return ratio * np.maximum(self.reach + qq - 2 * np.maximum(best[:, -1], bound), 0) + slack

        def verify(r: np.ndarray, c: np.ndarray) -> None:
            self.verified += len(r)
            score = self._scores(q, r, c)
            good = score >= np.maximum(best[:, -1], bound)[r]
            at, col = np.nonzero(best > -np.inf)
            at, i, s = np.concatenate([at, r[good]]), np.concatenate([who[at, col], self.ids[c[good]]]), np.concatenate([best[at, col], score[good]])
            by = np.lexsort((i, -s, at))
            at, i, s = at[by], i[by], s[by]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            top = place < k
            best[at[top], place[top]], who[at[top], place[top]] = s[top], i[top]

        done = np.full(n, -1.0)  # what lies up to here in a query's nearest leaf is verified
        nearest, new = far.argmin(1), np.flatnonzero(bound == -np.inf)
        for mine, here, apart in self._apart(nearest[new], new, pq, pp):
            m = min(3 * k, apart.shape[1])
            done[mine] = np.partition(apart, m - 1, axis=1)[:, m - 1]
            r, c = np.nonzero((apart <= done[mine][:, None]) & (self.ids[here][None] != qid[mine][:, None]))
            verify(mine[r], c + here.start)
        row, leaf = np.nonzero(far <= limit()[:, None])
        rows, cols, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        now = limit()
        for mine, here, apart in self._apart(leaf, row, pq, pp):
            least = np.where(self.edge[nearest[mine]] == here.start, done[mine], -np.inf)
            r, c = np.nonzero((apart <= now[mine][:, None]) & (apart > least[:, None]) & (self.ids[here][None] != qid[mine][:, None]))
            rows.append(mine[r])
            cols.append(c + here.start)
            dist.append(apart[r, c])
        r, c, apart = map(np.concatenate, (rows, cols, dist))
        for share in (0.4, 0.6, 0.8, 1.0):
            if not len(r):
                break
            now = limit()
            inside = apart <= share * now[r]
            verify(r[inside], c[inside])
            left = ~inside & (apart <= limit()[r])
            r, c, apart = r[left], c[left], apart[left]
        return best, who


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _facts(good: DataFrame) -> list[tuple[int, int, float]]:
    """(band, rows, greatest squared length) of each band; there are at most BANDS for each power of two
    that a double can hold, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                names, at = np.unique(band_of(x), return_inverse=True)
                reach = np.zeros(len(names))
                np.maximum.at(reach, at, (x * x).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at)), pa.array(reach)], ["band", "n", "reach"])

    rows = good.select("v").mapInArrow(run, "band long, n long, reach double").groupBy("band").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"))
    return [tuple(r) for r in rows.orderBy("band").collect()]


def _boxes(placed: DataFrame, cast) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cells, their rows and their boxes in the projection; there are at most about sample_rows / 8."""
    cols = [f"{s}{d}" for s in "lh" for d in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, p, _ = cast.value.place(_matrix(b.column(0)))
                names, at = np.unique(cell, return_inverse=True)
                low, high = np.full((len(names), DIMS), np.inf), np.full((len(names), DIMS), -np.inf)
                np.minimum.at(low, at, p)
                np.maximum.at(high, at, p)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at)), *(pa.array(x) for x in (*low.T, *high.T))], ["cell", "n", *cols])

    rows = placed.select("v").mapInArrow(run, ", ".join(["cell long, n long", *(f"{c} double" for c in cols)]))
    got = rows.groupBy("cell").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) if c[0] == "l" else F.max(c).alias(c) for c in cols)).toPandas().sort_values("cell")
    return got["cell"].to_numpy(), got["n"].to_numpy(), got[cols[:DIMS]].to_numpy(), got[cols[DIMS:]].to_numpy()


HITS = "query_id long, vec_id long, score double"


def _least_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """The places of rows that are among the `most` least ids of their vector."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, copy, n = np.unique(raw, return_inverse=True, return_counts=True)
    if n.max(initial=0) <= most:
        return np.arange(len(ids))
    order = np.lexsort((ids, copy))
    start = np.cumsum(n) - n
    return np.sort(order[np.arange(len(ids)) - np.repeat(start, n) < most])


def search(vectors: DataFrame, query_mod: int = 20, k: int = 20, confidence: float = 0.88, block: int = 8192, sample_rows: int = 65_536, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by query_mod its k nearest other
    rows by inner product in double precision, nearest first, ties to the smaller id; all other rows if
    they are fewer.

    Null ids, null and zero vectors, vectors with a null or non-finite component and such of another
    length than the commonest one (the least of several) take no part. Rows of one id with different
    vectors are candidates each, but none is a candidate of a query of that id; rows of the same id and
    vector are one candidate. A query id with several vectors is searched by the least of them. An empty
    table gives no rows; other columns, whatever their names, are dropped. The upper trees are fitted on
    about sample_rows rows, taken by a hash of the id; all rows are indexed. confidence is the stopping
    test's: the share of true neighbours that lie inside its limit, at the least."""
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = F.col("v")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id is not null and v is not null")
    good = good.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    common = good.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).agg(F.max_by("dims", F.struct("n", -F.col("dims"))).alias("dims"), F.sum("n").alias("n")).first()
    if not common["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = common["dims"], common["n"]
    good = good.where(F.size("v") == dims)
    rate = min(1.0, sample_rows / total)
    picked = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1 if rate < 1 else F.lit(True)).select("v").toArrow()
    sample = np.concatenate([_matrix(c) for c in picked.column(0).chunks if len(c)]) if picked.num_rows else np.ones((1, dims))
    cells = fit_cells(sample, _facts(good), dims, block)
    cast = spark.sparkContext.broadcast(cells)
    ratio = stop_ratio(confidence)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, ids = _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
                by = np.lexsort((*x.T, ids)) if len(np.unique(ids)) < len(ids) else np.arange(len(ids))
                same = np.zeros(len(ids), bool)
                same[1:] = (ids[by][1:] == ids[by][:-1]) & (x[by][1:] == x[by][:-1]).all(1)
                mine = by[~same]
                mine = mine[_least_copies(ids[mine], x[mine], k + 1)]
                own = pa.array(mine)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(cast.value.place(x[mine])[0])], ["id", "v", "cell"])

    # copies of a vector share a cell; only those of the k + 1 least ids can be among anyone's k nearest, and of
    # these each batch has sent on no more than its own k + 1
    copies = Window.partitionBy("cell", "h", "v").orderBy("id")
    rows = good.mapInArrow(place, f"id long, v {kind}, cell long").withColumn("h", F.xxhash64("v"))
    rows = rows.withColumn("r", F.dense_rank().over(copies)).where(F.col("r") <= k + 1).withColumn("last", F.lag("id").over(copies)).where(F.col("last").isNull() | (F.col("last") != F.col("id")))
    data = stored(rows.select("id", "v", "cell"), "ann-rows")
    names, sizes, low, high = _boxes(data, cast)
    tree_of = {t.first + i: t for t in cells.trees.values() for i in range(1 << t.depth)}
    reach = np.array([tree_of[int(c)].reach for c in names])
    rows_of = dict(zip(names.tolist(), sizes.tolist(), strict=True))
    queries = good.where(F.col("id") % query_mod == 0).groupBy("id").agg(F.min("v").alias("v"))

    def best_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Visits of each query to the two cells that promise the greatest inner product."""
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                hope = reach[None] - _box_distance(low, high, cast.value.project(x)) / DIMS
                top = np.argsort(-hope, axis=1, kind="stable")[:, :2]
                r = pa.array(np.repeat(np.arange(len(x)), top.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(names[top.ravel()]), b.column(0).take(r), b.column(1).take(r), pa.nulls(len(r), pa.float64())], ["cell", "id", "v", "bound"])

    def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Visits to the other cells that the stopping test can't rule out."""
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                bound = b.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                far = _box_distance(low, high, cast.value.project(x))
                top = np.argsort(-(reach[None] - far / DIMS), axis=1, kind="stable")[:, :2]
                true = np.maximum(reach[None] + (x * x).sum(1)[:, None] - 2 * bound[:, None], 0)
                go = far <= ratio * true + 1e-9 * (1 + ratio) * (reach[None] + (x * x).sum(1)[:, None])
                np.put_along_axis(go, top, False, 1)
                r, c = np.nonzero(go)
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(names[c]), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at)], ["cell", "id", "v", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, now, ids, xs, tree = cast.value, -1, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            item, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edge = np.concatenate([[0], np.flatnonzero((np.diff(item) != 0) | (np.diff(asks) != 0)) + 1, [len(item)]])
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if item[s] != now:
                    now, ids, xs, tree = item[s], [], [], None
                piece = b.slice(s, e - s)
                i, x = piece.column(2).to_numpy(zero_copy_only=False), _matrix(piece.column(3))
                if not asks[s]:
                    ids.append(i)
                    xs.append(x)
                    continue
                if not ids:
                    continue
                if tree is None:
                    whole = np.concatenate(xs)
                    _, p, r = c.place(whole)
                    tree = Block(np.concatenate(ids), whole, p, float(r[0]))
                for q in range(0, len(i), 512):
                    cut = slice(q, q + 512)
                    bound = piece.column(4).fill_null(-np.inf).to_numpy(zero_copy_only=False)[cut]
                    best, who = tree.search(i[cut], x[cut], c.project(x[cut]), k, ratio, bound)
                    r, col = np.nonzero(best > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(i[cut][r]), pa.array(who[r, col]), pa.array(best[r, col])], ["query_id", "vec_id", "score"])

    def hits(visits: DataFrame, label: str) -> DataFrame:
        """Each visited block meets each run of at most about `block` of its visitors in one work item."""
        visits = stored(visits, label)
        plan, items = [], 0
        for r in visits.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect():
            parts, runs = -(-rows_of[r["cell"]] // block), -(-r["n"] // block)
            plan.append((r["cell"], parts, runs, items))
            items += parts * runs
        small = F.broadcast(spark.createDataFrame(plan, "cell long, parts int, runs int, base int"))
        own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        there = data.join(small, "cell").withColumns({"part": own("parts", 1)}).withColumn("run", every("runs")).withColumns({"asks": F.lit(False), "bound": F.lit(None).cast("double")})
        here = visits.join(small, "cell").withColumn("run", own("runs", 2)).withColumn("part", every("parts")).withColumn("asks", F.lit(True))
        cols = [(F.col("base") + F.col("part") * F.col("runs") + F.col("run")).alias("item"), "asks", "id", "v", "bound"]
        met = there.select(*cols).unionByName(here.select(*cols)).repartition(max(1, min(items, 1 << 14)), "item")
        return met.sortWithinPartitions("item", "asks").mapInArrow(run, HITS)

    first = stored(hits(queries.select("id", "v").mapInArrow(best_first, f"cell long, id long, v {kind}, bound double"), "ann-visits"), "ann-first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first
    if len(names) > 2:
        ranked = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
        left = queries.join(ranked, "id", "left").select("id", "v", "bound").mapInArrow(still_open, f"cell long, id long, v {kind}, bound double")
        found = first.unionByName(hits(left, "ann-visits"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
