"""Operator 8, mixing sources to target weights by balanced sampling with the cube method.

Sizes are word counts. The weights 5, 2, 1 go to the sources in code-point order, null last, over and over. Targets share
the total of all sizes by weight; none is above CAP = 3 times its source's size, the excess being reshared by weight
(a water level, found from prefix sums over the sources in order of CAP * size / weight).

A document is due target / source size copies: the whole part for certain, and one more with the fraction as inclusion
probability. The cube method moves these probabilities within the null space of the two constraints, words and number
of documents, until all but a few are 0 or 1. Sources are parted by id hash into blocks of about BLOCK documents, so a
hot source is many tasks; what a block can't settle (two documents at most) goes on to flights over the leftovers of
FAN blocks at a time, round by round, and the last two or fewer of a source are the landing problem, solved by trying all
outcomes; the words that these still miss are made up by a few flips of settled documents at hand, for which each block
passes on SPARE settled documents of all sizes. Chance comes from hashes of the source and block, so reruns agree.

Null and empty texts have size 0. Documents of size 0 and sources without words take 0 words. Repeated rows are documents
each; null ids take part. Other columns are ignored; an empty table gives an empty result. Texts are counted whole.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import binary, cut

WEIGHTS, CAP, BLOCK, FAN, FLIPS, SPARE = (5, 2, 1), 3.0, 8192, 1024, 8, 16
EPS = 1e-9


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, source, size (words of the whole text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = binary(b.column(2))
            raw, at = memoryview(data), offsets.tolist()
            sizes = [len(bytes(raw[s:e]).split()) for s, e in itertools.pairwise(at)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, source string, size long")


def targets(rows: DataFrame) -> DataFrame:
    """Per source: source, n, source_size, target. One row per source goes through the windows, never a document."""
    sources = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")))
    capped = sources.withColumns({"most": CAP * F.col("source_size"), "ratio": CAP * F.col("source_size") / F.col("weight")})
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = capped.withColumn("level", level).withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return levels.select("source", "n", "source_size", F.least("most", F.col("weight") * F.coalesce("water", F.lit(float("inf")))).alias("target"))


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p within the null space of (1, size) until at most two entries are fractional; totals stay as they are."""
    p = p.copy()
    left = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))]
    chance = iter(rng.random(len(left) + 3))
    held: list[int] = []
    at = 0
    while True:
        while len(held) < 3 and at < len(left):
            held.append(left[at])
            at += 1
        if len(held) < 3:
            return p
        (i, j, k), (a, b, c) = held, (float(sizes[h]) for h in held)
        u = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        up = min(((1 - p[h]) / x if x > 0 else p[h] / -x) for h, x in zip(held, u, strict=True) if x)
        down = min((p[h] / x if x > 0 else (1 - p[h]) / -x) for h, x in zip(held, u, strict=True) if x)
        step = up if next(chance) * (up + down) < down else -down
        for h, x in zip(held, u, strict=True):
            p[h] = min(1.0, max(0.0, p[h] + step * x))
        now = [h for h in held if EPS < p[h] < 1 - EPS]
        if len(now) == 3:  # rounding left all three inside: the nearest one is settled
            h = min(now, key=lambda h: min(p[h], 1 - p[h]))
            p[h] = round(p[h])
            now.remove(h)
        held = now


def landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Settles the last fractional entries by the outcome whose words come nearest to the words still due.

    What then misses is made up by at most FLIPS further entries, each the one that mends most.
    """
    total = float((p * sizes).sum())
    p = np.where(p <= EPS, 0.0, np.where(p >= 1 - EPS, 1.0, p))
    open_ = np.flatnonzero((p > 0) & (p < 1))
    due = float((p[open_] * sizes[open_]).sum())
    p[open_] = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda x: (abs(float((np.array(x) * sizes[open_]).sum()) - due), x))
    for _ in range(FLIPS):
        miss = total - float((p * sizes).sum())
        after = np.abs(miss - np.where(p > 0.5, -sizes, sizes))
        i = int(np.argmin(after))
        if after[i] >= abs(miss):
            break
        p[i] = 1.0 - p[i]
    return p


def _fly(last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("size", "ascending")])
        source, block = table.column("source")[0].as_py(), table.column("block")[0].as_py()
        p, sizes = table.column("p").to_numpy().copy(), table.column("size").to_numpy()
        rng = np.random.default_rng([zlib.crc32(repr(source).encode()), block, last])
        p = flight(p, sizes, rng)
        open_ = (p > EPS) & (p < 1 - EPS)
        open_[np.argsort(sizes, kind="stable")[np.linspace(0, len(p) - 1, SPARE).astype(int)]] = True
        table = table.set_column(table.column_names.index("p"), "p", pa.array(landing(p, sizes) if last else p))
        return table.set_column(table.column_names.index("open"), "open", pa.array(open_))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies (how often the mix takes it), taken (copies * size)."""
    rows = cut(sized(docs, id_col, text_col, source_col), "sized")
    goal = cut(targets(rows), "targets")
    schema = "doc_id long, source string, size long, source_size long, target double, base long, p double, n long, block int, open boolean"
    blocks = lambda n, per: F.greatest(F.lit(1), F.ceil(n / F.lit(per))).cast("int")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = rows.join(F.broadcast(goal) if goal.count() < 10_000 else goal, rows.source.eqNullSafe(goal.source)).drop(goal.source)
    known = known.withColumns({"due": due, "block": F.pmod(F.xxhash64("doc_id", "size"), blocks(F.col("n"), BLOCK)).cast("int")})
    start = known.select("doc_id", "source", "size", "source_size", "target", F.floor("due").alias("base"), (F.col("due") - F.floor("due")).alias("p"), "n", "block", F.lit(True).alias("open"))
    most = goal.agg(F.max("n")).first()[0] or 0
    done, wide = [], -(-most // BLOCK)
    while True:  # at most log_FAN(blocks of the largest source) + 1 rounds
        last = wide <= 1
        state = cut(start.groupBy("source", "block").applyInArrow(_fly(last), schema), "flight")
        if last:
            done.append(state)
            break
        done.append(state.filter("NOT open"))
        wide = -(-wide // FAN)
        start = state.filter("open").withColumn("block", F.floor(F.col("block") / FAN).cast("int"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.round("p").cast("long")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
