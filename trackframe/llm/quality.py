"""Operator 5, quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is quality + (1 - toxic), 0 to 2. P(grade <= k) = logistic(threshold_k - w.x), with one shared weight
vector over hashed features and ordered thresholds. Features are the presence of each lower-cased word, word beginning
or run of signs in the whole text, hashed to 2**HASH_BITS places, and a few shape features (share of capitals, repetition by length).
Features without a significant relation to the grade are screened out and the weights are fitted by AdaGrad with an L1
step, so words without information stay at 0 and long texts aren't drowned in noise. All labelled documents take part in the
screening, by counts, and in the fit: they are dealt by a hash of the id to parts of about PART documents, each part is
fitted in a task of its own on the features that passed, and weights and thresholds are the mean of the parts' by their
number of documents (up to PART documents are one part). Scoring takes all documents, whole.

Results per row: expected grade, tail probability P(grade >= 2), and keep, which is tail >= KEEP.

Null and empty texts have no words and are scored on shape alone. Null ids are scored. Of repeated labels of an id the
lowest grade holds; labels with a null are left out. Repeated rows are scored each. Without any usable label the weights
are 0 and the thresholds make all grades equally likely but the tail 0.5, so that nothing is rejected. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import BYTE_CODES, LOWER, SIGN_KINDS, Chunk, Rolling, chunks, cut as write, discard, mix

HASH_BITS, PART, KEEP, GRADES = 20, 20_000, 0.5, 3
#: Labels up to which they are broadcast to the texts; beyond, both are joined by id.
FEW_LABELS = 200_000
EPOCHS, BATCH, RATE, L1, SCREEN, SEED = 30, 256, 0.3, 1e-3, 4.5, 5
#: Lengths in bytes of word beginnings that are features too, for words that share a stem.
PREFIXES = (4, 5)
_LOWER = np.frombuffer(LOWER, np.uint8)


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature places of each document: place and document number, by document."""
    small = Chunk(chunk.first, _LOWER[chunk.data], chunk.offsets)
    starts, ends, doc = small.words(SIGN_KINDS)
    rolling = Rolling(BYTE_CODES[small.data])
    word = rolling.of(starts, ends)
    docs, size = len(chunk), np.diff(chunk.offsets)
    shift = np.uint64(64 - HASH_BITS)
    keys = np.unique(doc.astype(np.uint64) << np.uint64(HASH_BITS) | word >> shift)
    heads = []
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        head = mix(rolling.of(starts[long], starts[long] + k) + np.uint64(k)) >> shift
        heads.append(np.unique(doc[long].astype(np.uint64) << np.uint64(HASH_BITS) | head))
    n, distinct = np.bincount(doc, minlength=docs), np.bincount((keys >> np.uint64(HASH_BITS)).astype(np.int64), minlength=docs)
    capitals = np.add.reduceat(np.append((chunk.data != small.data).astype(np.int64), 0), np.minimum(chunk.offsets[:-1], len(chunk.data)))
    capitals[size == 0] = 0
    share = np.minimum(9, 10 * capitals // np.maximum(size, 1))
    log = lambda x: np.log2(np.maximum(x, 1)).astype(np.int64)
    shape = [100 + share, 1000 + 32 * log(n) + np.minimum(31, (4 * np.log2(np.maximum(n, 1) / np.maximum(distinct, 1))).astype(np.int64))]
    extra = [np.arange(docs).astype(np.uint64) << np.uint64(HASH_BITS) | mix(s.astype(np.uint64)) >> shift for s in shape]
    keys = np.unique(np.concatenate([keys, *heads, *extra]))
    return (keys & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64), (keys >> np.uint64(HASH_BITS)).astype(np.int64)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def screen(grade: np.ndarray, places: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each place's documents have a mean grade SCREEN standard errors off the mean of all."""
    n = len(grade)
    centred, often, off = grade - grade.mean(), np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    for at in range(0, len(places), 1 << 20):
        part = places[at : at + (1 << 20)]
        often += np.bincount(part, minlength=len(often))
        off += np.bincount(part, weights=centred[row[at : at + (1 << 20)]], minlength=len(off))
    spread = max(grade.std(), 1e-9) * np.sqrt(often * np.maximum(1 - often / n, 1e-9))
    return (often > 0) & (np.abs(off) > SCREEN * spread)


def fit(grade: np.ndarray, places: np.ndarray, row: np.ndarray, good: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with a weight, their weights, and the ordered thresholds. row tells the document of each place, in order.

    good: the places that take part, if they have been screened before.
    """
    n = len(grade)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), np.array([-1.0, 0.0])
    good = screen(grade, places, row) if good is None else good
    held = good[places]
    column, row = (np.cumsum(good) - 1)[places[held]], row[held]
    used = np.flatnonzero(good)
    offsets = np.searchsorted(row, np.arange(n + 1))
    cum = np.clip(np.cumsum(np.bincount(grade, minlength=GRADES))[:-1] / n, 0.5 / n, 1 - 0.5 / n)
    cut = np.log(cum / (1 - cum))
    cut[1:] = np.maximum(cut[1:], cut[:-1] + 1e-3)
    w, seen, cut_seen = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(GRADES - 1, 1e-8)
    rng = np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(n), RATE / (1 + epoch / 4)
        for at in range(0, n, BATCH):
            d = order[at : at + BATCH]
            size = offsets[d + 1] - offsets[d]
            local = np.repeat(np.arange(len(d)), size)
            flat = column[np.arange(size.sum()) + np.repeat(offsets[d] - np.cumsum(size) + size, size)]
            s = np.bincount(local, weights=w[flat], minlength=len(d))
            edge = np.concatenate(([-np.inf], cut, [np.inf]))
            upper, lower = logistic(edge[grade[d] + 1] - s), logistic(edge[grade[d]] - s)
            upper[grade[d] == GRADES - 1], lower[grade[d] == 0] = 1.0, 0.0
            p = np.maximum(upper - lower, 1e-9)
            touched, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, weights=(1 - upper - lower)[local]) / len(d)
            seen[touched] += g * g
            pace = rate / np.sqrt(seen[touched])
            moved = w[touched] - pace * g
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - pace * L1, 0)
            for k in range(GRADES - 1):
                gk = (-(upper * (1 - upper) / p)[grade[d] == k].sum() + (lower * (1 - lower) / p)[grade[d] == k + 1].sum()) / len(d)
                cut_seen[k] += gk * gk
                cut[k] -= rate * gk / np.sqrt(cut_seen[k])
            cut[1:] = np.maximum(cut[1:], cut[:-1] + 1e-3)
    some = np.flatnonzero(w)
    return used[some], w[some], cut


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights by place (dense, 2**HASH_BITS) and thresholds, from docs (doc_id, text) and labels (doc_id, quality, toxic)."""
    grade = (F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")).alias("grade")
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade).filter("doc_id IS NOT NULL AND grade BETWEEN 0 AND 2").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = write(rated, "labels")
    known = F.broadcast(rated) if rated.count() <= FEW_LABELS else rated
    labelled = docs.join(known, "doc_id").select("doc_id", "grade", "text")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(2)):
                places, doc = features(c)
                at = np.searchsorted(doc, np.arange(len(c) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(places.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, len(c)), b.column(1).slice(c.first, len(c)), lists], ["doc_id", "grade", "places"])

    rows = write(labelled.mapInArrow(read, "doc_id long, grade int, places array<int>"), "features", drop=[rated])
    often = {r.grade: r.n for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # at most GRADES rows
    n, dense = sum(often.values()), np.zeros(1 << HASH_BITS)
    if not n:
        discard(rows)
        return dense.astype(np.float32), np.array([-1.0, 0.0])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRADES << HASH_BITS, np.int64)
        for b in batches:
            lists = b.column(1)
            grade = np.repeat(b.column(0).to_numpy().astype(np.int64), lists.value_lengths().to_numpy())
            keys, times = np.unique(grade << HASH_BITS | lists.flatten().to_numpy(), return_counts=True)
            total[keys] += times
        total = total.reshape(GRADES, -1)
        some = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some]) for t in total)], ["place", *(f"n{k}" for k in range(GRADES))])

    mean = sum(g * k for g, k in often.items()) / n
    deviation = max(np.sqrt(sum(k * (g - mean) ** 2 for g, k in often.items()) / n), 1e-9)
    grades = [f"n{k}" for k in range(GRADES)]
    places = rows.select("grade", "places").mapInArrow(count, "place long, " + ", ".join(f"{g} long" for g in grades)).groupBy("place").agg(*(F.sum(g).alias(g) for g in grades))
    all_, off = sum(F.col(g) for g in grades), sum(F.col(g) * (k - mean) for k, g in enumerate(grades))
    passed = F.abs(off) > SCREEN * float(deviation) * F.sqrt(all_ * F.greatest(1 - all_ / n, F.lit(1e-9)))
    good = np.zeros(1 << HASH_BITS, bool)
    good[places.filter(passed).select("place").toArrow().column("place").to_numpy()] = True  # at most 2**HASH_BITS rows

    def screened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten()
            held = good[flat.to_numpy()]
            at = np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat.filter(pa.array(held)))], b.schema.names)

    def learn(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.select(["doc_id", "grade", "places"]).sort_by([("doc_id", "ascending")]).combine_chunks()
        lists = table.column("places").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        row = np.repeat(np.arange(len(table), dtype=np.int32), lists.value_lengths().to_numpy())
        places, w, cut = fit(table.column("grade").to_numpy().astype(np.int64), lists.flatten().to_numpy(), row, good)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(table)], pa.int64()), "place": pa.array([places.tolist()], pa.list_(pa.int64())), "w": pa.array([w.tolist()], pa.list_(pa.float64())), "cut": pa.array([cut.tolist()], pa.list_(pa.float64()))})

    parts = -(-n // PART)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    # A fixed number of tasks: parts are few bytes and long to fit, and would else be put together in one task.
    dealt = rows.mapInArrow(screened, rows.schema).withColumn("part", part).repartition(4 * parts, "part")
    fitted = write(dealt.groupBy("part").applyInArrow(learn, "part int, n long, place array<long>, w array<double>, cut array<double>"), "parts", drop=[rows])
    cuts = np.zeros(GRADES - 1)
    for r in fitted.orderBy("part").toLocalIterator():
        dense[np.array(r.place, np.int64)] += np.array(r.w) * (r.n / n)
        cuts += np.array(r.cut) * (r.n / n)
    discard(fitted)
    return dense.astype(np.float32), cuts


def score(docs: DataFrame, weights: np.ndarray, cut: np.ndarray, keep_columns: bool = False) -> DataFrame:
    """Per row: doc_id, expected_grade, tail, keep; weights are 4 MB at most, whatever the corpus."""
    places = np.flatnonzero(weights).astype(np.int64)
    values = weights[places]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << HASH_BITS)
        dense[places] = values
        for b in batches:
            s = [np.bincount(doc, weights=dense[p], minlength=len(c)) for c in chunks(b.column(b.num_columns - 1)) for p, doc in [features(c)]]
            s = np.concatenate(s) if s else np.zeros(0)
            above = 1 - logistic(cut[None, :] - s[:, None])  # P(grade > k)
            result = [pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= KEEP)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *result], [*b.schema.names[:-1], "expected_grade", "tail", "keep"])

    inner = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("t")) if keep_columns else docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    head = inner.drop("t").schema if keep_columns else "doc_id long"
    schema = (f"row {head['row'].dataType.simpleString()}" if keep_columns else head) + ", expected_grade double, tail double, keep boolean"
    return inner.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, *train(docs, labels))
