"""Operator 9, exact top-k search: KD-trees per shard.

Components are quantised to floor(scale * x); scores are inner products of these integers. Vectors that are null, or hold a
null or non-finite component, take no part, nor do those without id. Shorter vectors count as filled up with zeros. Every
row of queries is a query, repeated ones too; rows with the query's own id are no candidates; repeated rows are candidates
each. Ties go to the smaller id. Other columns are ignored; an empty table gives an empty result.

The upper levels of one KD-tree, grown from a bounded sample (SAMPLE_A_SHARD rows a shard, at most SHARDS shards), part the
space; a row lives in one shard, and a shard that many equal vectors fill is dealt to several by row number. Every shard has
a tight bounding box (at most SHARDS boxes reach the driver and the tasks). A query starts with the k-th score over a
pilot, PILOT rows of least id hash: a true lower bound. It is answered first in the shard whose box promises most; the k-th
score found there is passed on, and then only shards whose box can beat it get the query, and only shards that are asked
move. Within a shard a KD-tree (median splits of the widest dimension, tight boxes) is gone through best box first, by the
bound sum of max(q*lo, q*hi), until no box can beat the k-th score so far. Queries are dealt to blocks of BLOCK, so neither
side is ever gathered whole; a shard is copied once for each block that asks it.

All finite components are exact. Products of integers below a limit that the number of dimensions sets (about 2**28 for 64)
fit in 64 bits; vectors beyond it are compared with everything as Python integers. Scores that don't fit in long are ranked
by their true value (up to 38 digits) and returned as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import cut, discard

SHARD, BLOCK, PILOT, LEAF, SAMPLE_A_SHARD, SHARDS = 16384, 65536, 1024, 64, 16, 4096
LARGEST = 10**38 - 1
FOUND = "q long, own long, vec_id long, score decimal(38,0)"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v array<double>, of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("v"))
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of lists of numbers as a matrix, short ones filled up with zeros."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.list_(pa.float64()))
    out = np.zeros((len(whole), dims))
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(whole)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole.flatten().to_numpy(zero_copy_only=False)
    return out


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly unless it is beyond their range."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def integers(x: np.ndarray, scale: float) -> list[list[int]]:
    """floor(scale * x) as Python integers; beyond the range of doubles x is a whole number itself."""
    y = quantised(x, scale)
    return [[int(b) if np.isfinite(b) else int(a) * int(scale) for a, b in zip(r, s, strict=True)] for r, s in zip(x.tolist(), y.tolist(), strict=True)]


def modest(y: np.ndarray) -> np.ndarray:
    """Rows whose inner products with each other fit in 64 bits."""
    return np.abs(y).max(axis=1, initial=0) < 2.0 ** ((62 - np.log2(max(1, y.shape[1]))) / 2)


class Tree:
    """Nodes in arrays: tight boxes, children (-1 at leaves), and the range of rows of each leaf."""

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.arange(len(x))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int]] = []
        self.rows: list[tuple[int, int]] = []
        stack = [(0, len(x), -1, 0)]
        while stack:
            s, e, parent, side = stack.pop()
            part = x[self.order[s:e]]
            low, high = part.min(axis=0), part.max(axis=0)
            me = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.kids.append((-1, -1))
            self.rows.append((s, e))
            if parent >= 0:
                self.kids[parent] = (me, self.kids[parent][1]) if side == 0 else (self.kids[parent][0], me)
            axis = int(np.argmax(high - low))
            if e - s > LEAF and high[axis] > low[axis]:
                half = (e - s) // 2
                self.order[s:e] = self.order[s:e][np.argpartition(part[:, axis], half)]
                stack += [(s, s + half, me, 0), (s + half, e, me, 1)]
        self.x = x[self.order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product that any point of each box can have with each query."""
        return np.maximum(q, 0) @ np.array(self.high).T + np.minimum(q, 0) @ np.array(self.low).T


def best(tree: Tree, ids: np.ndarray, own: int, q: np.ndarray, bound: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """Best-first: (score, -id) of the k best rows; least is a k-th score known from elsewhere."""
    top: list[tuple[int, int]] = []
    heap = [(-int(bound[0]), 0)]
    while heap:
        b, node = heapq.heappop(heap)
        if -b < least:
            break
        left, right = tree.kids[node]
        if left >= 0:
            heapq.heappush(heap, (-int(bound[left]), left))
            heapq.heappush(heap, (-int(bound[right]), right))
            continue
        s, e = tree.rows[node]
        scores = tree.x[s:e] @ q
        for i in np.flatnonzero(scores >= least).tolist():
            if ids[s + i] != own:
                item = (int(scores[i]), -int(ids[s + i]))
                if len(top) < k:
                    heapq.heappush(top, item)
                elif item > top[0]:
                    heapq.heapreplace(top, item)
        if len(top) == k:
            least = max(least, top[0][0])
    return top


def exact(a: np.ndarray, b: np.ndarray) -> np.dtype:
    """Doubles hold all sums exactly where they stay below 2**53, and multiply faster."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.dtype(np.float64 if most < 2**53 else np.int64)


def part_space(sample: np.ndarray, leaves: int) -> tuple[object, int]:
    """The upper tree as nested (axis, value, below, from there on), leaves numbered from 0; and the number of leaves."""
    count = 0

    def node(x: np.ndarray, want: int) -> object:
        nonlocal count
        if want > 1 and len(x) > 1:
            axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            value = float(np.median(x[:, axis]))
            low = x[:, axis] < value
            if low.any():
                return axis, value, node(x[low], want // 2), node(x[~low], want - want // 2)
        count += 1
        return count - 1

    return node(sample, leaves), count


def place(tree: object, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    out, stack = np.zeros(len(x), np.int32), [(tree, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if not isinstance(node, tuple):
            out[rows] = node
        elif len(rows):
            low = x[rows, node[0]] < node[1]
            stack += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def promise(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box a score that no point of the box exceeds, rounding included."""
    with np.errstate(invalid="ignore", over="ignore"):
        best = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        slack = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-12 + 1
        return np.where(np.isfinite(best + slack), best + slack, np.inf)


def lowered(scores: np.ndarray) -> np.ndarray:
    """Doubles that are below the scores, whatever rounding has done to these."""
    return scores - 1 - np.abs(scores) * 1e-12


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, scale: float) -> list[tuple[int, int, int]]:
    """Number of the query, id and score of the k best rows for each query, as far as they can reach its least score."""
    y, p = quantised(x, scale), quantised(q, scale)
    plain, asks = modest(y), modest(p)
    out: list[tuple[int, int, int]] = []
    rows, queries = np.flatnonzero(plain), np.flatnonzero(asks)
    if len(rows) and len(queries):
        kind = exact(y[rows], p[queries])
        tree = Tree(y[rows])
        mine = ids[rows][tree.order]
        tree.x, tree.low, tree.high = tree.x.astype(kind), [v.astype(kind) for v in tree.low], [v.astype(kind) for v in tree.high]
        for at in range(0, len(queries), 256):
            some = queries[at : at + 256]
            part = p[some].astype(kind)
            for i, bound in enumerate(tree.bounds(part)):
                n = int(some[i])
                out += [(n, -v, s) for s, v in best(tree, mine, int(own[n]), part[i], bound, k, float(least[n]))]
    # What is left has a vector with large components on one side or on both.
    large = np.flatnonzero(~plain)
    for n in range(len(q)):
        others = large if asks[n] else np.arange(len(x))
        if len(others):
            (mine,) = integers(q[n : n + 1], scale)
            scored = []
            for at in range(0, len(others), 1024):
                some = others[at : at + 1024]
                scored += [(sum(a * b for a, b in zip(mine, v, strict=True)), -int(i)) for v, i in zip(integers(x[some], scale), ids[some], strict=True) if i != own[n]]
                scored = heapq.nlargest(k, scored)
            out += [(n, -v, s) for s, v in scored]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of queries the k best rows of vectors; both as usable() gives them."""
    vectors = cut(vectors, "vectors")
    asked = cut(queries.withColumn("q", F.monotonically_increasing_id()), "queries")
    n, dims = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(1, dims or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    shards = min(SHARDS, max(1, -(-n // SHARD)))
    blocks = max(1, -(-asked.count() // BLOCK))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(PILOT, SAMPLE_A_SHARD * shards)).collect()
    sample = quantised(matrix(pa.array([r[1] for r in chosen], pa.list_(pa.float64())), dims), scale)
    ids, fair = np.array([r[0] for r in chosen], np.int64), modest(sample)
    pilot, pilot_ids = sample[fair][:PILOT], ids[fair][:PILOT]
    tree, leaves = part_space(sample, shards)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = place(tree, quantised(matrix(b.column(1), dims), scale))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], ["vec_id", "v", "leaf"])

    def box(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each leaf of a task: how many rows, and the least and largest of each component."""
        many, low, high = np.zeros(leaves, np.int64), np.full((leaves, dims), np.inf), np.full((leaves, dims), -np.inf)
        for b in batches:
            y, leaf = quantised(matrix(b.column(1), dims), scale), b.column(2).to_numpy()
            many += np.bincount(leaf, minlength=leaves)
            np.minimum.at(low, leaf, y)
            np.maximum.at(high, leaf, y)
        some = np.flatnonzero(many)
        lists = lambda a: pa.array(a[some].tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(many[some]), lists(low), lists(high)], ["leaf", "n", "low", "high"])

    def joined(t: pa.Table) -> pa.Table:
        low, high = matrix(t.column("low"), dims).min(axis=0), matrix(t.column("high"), dims).max(axis=0)
        whole = [pa.array([t.column("leaf")[0].as_py()], pa.int32()), pa.array([sum(t.column("n").to_pylist())], pa.int64())]
        return pa.table([*whole, pa.array([low.tolist()]), pa.array([high.tolist()])], ["leaf", "n", "low", "high"])

    kind = "leaf int, n long, low array<double>, high array<double>"
    placed = cut(vectors.select("vec_id", "v").mapInArrow(deal, "vec_id long, v array<double>, leaf int"), "placed", drop=[vectors])
    boxes = sorted(placed.mapInArrow(box, kind).groupBy("leaf").applyInArrow(joined, kind).collect())  # at most SHARDS
    numbers = np.array([r.leaf for r in boxes], np.int32)
    low, high = (np.array([r[c] for r in boxes]).reshape(-1, dims) for c in ("low", "high"))
    shares = np.array([-(-r.n // SHARD) for r in boxes], np.int64)
    spark = placed.sparkSession
    known = spark.createDataFrame([(int(a), int(b)) for a, b in zip(numbers, shares, strict=True)], "leaf int, shares long")
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("shares")).cast("int")
    placed = cut(placed.join(F.broadcast(known), "leaf").select("leaf", number.alias("share"), "vec_id", "v"), "shards", drop=[placed])

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th score over the pilot, and the shard that promises most."""
        for b in batches:
            y, own = quantised(matrix(b.column(1), dims), scale), b.column(0).to_numpy()
            least, fair = np.full(len(y), -np.inf), modest(y)
            kind = exact(y[fair], pilot)
            for at in range(0, len(y), 512):
                some = np.flatnonzero(fair[at : at + 512]) + at
                scores = (y[some].astype(kind) @ pilot.T.astype(kind)).astype(float)
                scores[own[some, None] == pilot_ids[None, :]] = -np.inf
                if scores.shape[1] >= k:
                    least[some] = lowered(np.partition(scores, -k, axis=1)[:, -k])
            top = promise(y, low, high).argmax(axis=1) if len(numbers) else np.zeros(len(y), np.int64)
            share = b.column(2).to_numpy() % shares[top] if len(numbers) else top
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least), pa.array(numbers[top] if len(numbers) else top.astype(np.int32)), pa.array(share.astype(np.int32))], ["vec_id", "v", "q", "least", "leaf", "share"])

    def rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other shards that can still beat the k-th score."""
        for b in batches:
            y, least = quantised(matrix(b.column(1), dims), scale), b.column(3).to_numpy()
            done, done_share = b.column(4).to_numpy(), b.column(5).to_numpy()
            for at in range(0, len(y), 256):
                i, j = np.nonzero(promise(y[at : at + 256], low, high) >= least[at : at + 256, None])
                i += at
                many = shares[j]
                i, j, share = np.repeat(i, many), np.repeat(j, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                keep = (numbers[j] != done[i]) | (share != done_share[i])
                i, j, share = i[keep], j[keep], share[keep]
                for s in range(0, len(i), 4096):
                    rows = pa.array(i[s : s + 4096])
                    out = [*(b.column(c).take(rows) for c in range(4)), pa.array(numbers[j[s : s + 4096]]), pa.array(share[s : s + 4096].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(out, ["vec_id", "v", "q", "least", "leaf", "share"])

    def answer(rows: pa.Table, asks: pa.Table) -> pa.Table:
        q, own = asks.column("q").to_numpy(), asks.column("vec_id").to_numpy()
        found = search(matrix(rows.column("v"), dims), rows.column("vec_id").to_numpy(), matrix(asks.column("v"), dims), own, asks.column("least").to_numpy(), k, scale) if len(rows) else []
        who = np.array([r[0] for r in found], np.int64)
        scores = pa.array([max(-LARGEST, min(LARGEST, r[2])) for r in found], pa.decimal128(38, 0))
        return pa.table([pa.array(q[who]), pa.array(own[who]), pa.array([r[1] for r in found], pa.int64()), scores], ["q", "own", "vec_id", "score"])

    def answers(asks: DataFrame) -> DataFrame:
        """The best rows of each shard for those that ask it. Shards go to the blocks of queries that ask them."""
        asks = asks.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
        wanted = asks.select("leaf", "share", "block").distinct()
        names, columns = ("leaf", "share", "block"), ("leaf", "share", "block", "vec_id", "v")
        rows = placed.join(wanted, ["leaf", "share"]).select(*columns).toDF(*columns)
        return rows.groupBy(*names).cogroup(asks.groupBy(*names)).applyInArrow(answer, FOUND)

    asking = "vec_id long, v array<double>, q long, least double, leaf int, share int"
    asks = cut(asked.select("vec_id", "v", "q").mapInArrow(first, asking), "asks")
    found = cut(answers(asks), "found")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    every = found
    if shares.sum() > 1:  # else all rows have been asked
        score = F.col("score").cast("double")
        kth = found.withColumn("rank", rank).filter(F.col("rank") == k).select("q", (score - 1 - F.abs(score) * 1e-12).alias("kth"))  # as lowered()
        left = asks.join(kth, "q", "left").select("vec_id", "v", "q", F.greatest("least", "kth").alias("least"), "leaf", "share")
        more = cut(left.mapInArrow(rest, asking), "asks")
        every = cut(found.unionByName(answers(more)), "found", drop=[found, more])
    discard(asks, asked, placed)
    long = F.greatest(F.lit(-(1 << 63)), F.least(F.lit((1 << 63) - 1), F.col("score"))).cast("long")
    best_ = every.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best_.select(F.col("own").alias("query_id"), "rank", "vec_id", long.alias("score"))
