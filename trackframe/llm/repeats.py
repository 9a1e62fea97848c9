"""What operators 2 and 6 share: finding windows that occur more than once, from anchors to spans.

A window is a run of a fixed number of units (words or bytes) of one document. The operator gives every window an anchor,
chosen from the window's content alone, so equal windows have equal anchors at equal places. Neighbouring windows mostly
share one; a row stands for an anchor and the windows around it:

    h    name of the anchor          did  document id (null: the smallest long)
    ctx  hash of all units of        at   first window << 16 | windows << 8 | anchor's offset
         its windows, and offset     bits 64-bit hash of the text and of whether there is an id; tells rows of one id apart

1. Names that occur once are dropped: a count with partial sums, then a join. No window of theirs can occur twice.
2. Rows with equal name and ctx are one class: all their windows are equal one by one. Classes are summed before they are
   shuffled, so thousands of copies are one row from here on.
3. Of names with several classes, the first member of each class goes, with its units, to a bucket by range of the leading
   units of its anchor, between splitters that Spark samples. There all windows of a name (suffixes, cut at the window's
   length) are put in the order of their units by a multikey sort, and neighbours are compared unit by unit.
4. The windows of a name with over HOT classes are range-partitioned themselves, so that a run of equal ones may go on over
   any number of buckets. Buckets sort and compare neighbours; the first and last row of each are compared across the
   boundary to the next (two rows a bucket reach the driver).
5. Spans are gathered by document and joined to the texts.

A long text is handled in pieces, so that what is held beside it doesn't grow with it; texts of 2**30 bytes or more are
refused. Rows that repeat an id and a text are told apart by nothing: the operator says what they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import Chunk, Rolling, chunks, cut, discard

#: Classes of a name that one bucket takes whole, and contexts that are compared at once as far as names allow.
HOT, ENOUGH = 2048, 1024
#: Bytes of a long text that are parted into units at once, and units whose anchors are found at once.
PIECE, STRIDE = 1 << 22, 1 << 20
NULL_ID = -(1 << 63)
ANCHOR = "h long, ctx long, did long, at long, bits long"
LONGEST = 1 << 30


@dataclass(frozen=True)
class Kind:
    """How an operator sees texts.

    window: units in a window. units(chunk): the units of a chunk, and where each document's begin. split(data, at): the
    first place from at on where bytes may be parted without parting a unit. codes(units): a 64-bit symbol for each.
    keys(units): for each place a number that orders by the next step units. anchors(units, first): of each window within
    a document, in order, its start, and name and place of its anchor. firsts: whether the first occurrence in order of
    (id, start) stays.
    """

    window: int
    dtype: type
    units: Callable[[Chunk], tuple[np.ndarray, np.ndarray]]
    split: Callable[[np.ndarray, int], int]
    codes: Callable[[np.ndarray], np.ndarray]
    keys: Callable[[np.ndarray], np.ndarray]
    step: int
    anchors: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    firsts: bool


def _rows(kind: Kind, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Name, ctx, document, first window, number of windows and offset of each anchor of some documents."""
    start, name, place = kind.anchors(units, first)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (name[1:] != name[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    lo, off = start[at], place[at] - start[at]
    ctx = Rolling(kind.codes(units)).of(lo, lo + n - 1 + kind.window) ^ off.astype(np.uint64)
    doc = np.searchsorted(first, lo, side="right") - 1
    return name[at].view(np.int64), ctx.view(np.int64), doc, lo - first[doc], n, off


def units_of(kind: Kind, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The units of a chunk; those of a long text piece by piece."""
    if len(c.data) >= LONGEST:
        raise ValueError("a text has 2**30 bytes or more")
    if len(c.data) <= PIECE or len(c) > 1:
        return kind.units(c)
    parts, at = [], 0
    while at < len(c.data):
        to = kind.split(c.data, min(len(c.data), at + PIECE))
        parts.append(kind.units(Chunk(0, c.data[at:to], np.array([0, to - at])))[0])
        at = to
    whole = np.concatenate(parts)
    return whole, np.array([0, len(whole)])


def _chunk_rows(kind: Kind, c: Chunk) -> Iterator[tuple[np.ndarray, ...]]:
    """_rows of a chunk; of a long text by overlapping pieces, which may part an anchor's windows in two rows."""
    units, first = units_of(kind, c)
    if len(units) <= STRIDE or len(c) > 1:
        yield _rows(kind, units, first)
        return
    for at in range(0, len(units) - kind.window + 1, STRIDE):
        part = units[at : at + STRIDE + kind.window - 1]
        h, ctx, doc, lo, n, off = _rows(kind, part, np.array([0, len(part)]))
        yield h, ctx, doc, lo + at, n, off


def _text_bits(text: Column, number: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), number.isNull())


def _anchors(texts: DataFrame, kind: Kind) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, bits = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in chunks(b.column(2)):
                for h, ctx, doc, lo, n, off in _chunk_rows(kind, c):
                    at, row = lo << 16 | n << 8 | off, c.first + doc
                    columns = [pa.array(x) for x in (h, ctx, did[row], at, bits[row])]
                    yield pa.RecordBatch.from_arrays(columns, ["h", "ctx", "did", "at", "bits"])

    return texts.select("did", "bits", "text").mapInArrow(run, ANCHOR)


def _contexts(joined: DataFrame, kind: Kind) -> DataFrame:
    """For each wanted (h, at) of a document its units as bytes, from its first window to the end of its last."""
    kinds = {"h": pa.int64(), "did": pa.int64(), "at": pa.int64(), "bits": pa.int64(), "hot": pa.bool_(), "units": pa.binary()}

    def emit(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, wanted, bits = b.column(0), b.column(2), b.column(3)
            out: dict[str, list] = {k: [] for k in kinds}
            size = 0
            for c in chunks(b.column(1)):
                units, first = units_of(kind, c)
                for d in range(len(c)):
                    for w in wanted[c.first + d].as_py():
                        lo, n = w["at"] >> 16, w["at"] >> 8 & 255
                        out["units"].append(units[first[d] + lo : first[d] + lo + n - 1 + kind.window].tobytes())
                        out["did"].append(did[c.first + d].as_py())
                        out["bits"].append(bits[c.first + d].as_py())
                        for k in ("h", "at", "hot"):
                            out[k].append(w[k])
                        size += len(out["units"][-1])
                        if size > 1 << 21:
                            yield emit(out)
                            out, size = {k: [] for k in kinds}, 0
            yield emit(out)

    return joined.mapInArrow(run, "h long, did long, at long, bits long, hot boolean, units binary")


def _windows(units: list[bytes], at: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of some contexts: context number, start in the document, place in the joined units; and these."""
    n, lo = at >> 8 & 255, at >> 16
    which = np.repeat(np.arange(len(at), dtype=np.int32), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum(n - 1 + kind.window) - (n - 1 + kind.window)
    return which, np.repeat(lo, n) + step, base[which] + step, np.frombuffer(b"".join(units), kind.dtype)


def suffix_order(key: Callable[[int, np.ndarray], np.ndarray], depth: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey sort: suffixes by their first key, those that tie by the second, and so on; equal ones stay in the given order.

    key(d, suffixes) gives the d-th of depth keys. Returns the order, and which places differ from the one before.
    A level looks only at suffixes that still tie, and sorts only groups in which that level's keys differ.
    """
    n = len(order)
    if not n:
        return order, np.zeros(0, bool)
    first = key(0, order)
    by = np.argsort(first, kind="stable")
    order, first = order[by], first[by]
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    for d in range(1, depth):
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        begin, size = begin[size > 1], size[size > 1]
        if not len(begin):
            break
        at = np.cumsum(size) - size
        place = np.repeat(begin - at, size) + np.arange(size.sum())
        now = key(d, order[place])
        apart = np.logical_or.reduceat(now != np.repeat(now[at], size), at)
        if not apart.any():
            continue
        some = np.repeat(apart, size)
        place, now, group = place[some], now[some], np.repeat(np.arange(len(size)), size)[some]
        by = np.lexsort((now, group))
        order[place], now = order[place[by]], now[by]
        new[place[1:][now[1:] != now[:-1]]] = True
    return order, new


def repeated(order: np.ndarray, new: np.ndarray, firsts: bool) -> np.ndarray:
    """The windows that are to be removed: of each run of equal ones all, or all but its first in the given order."""
    out = ~new
    if not firsts:
        out[:-1] |= ~new[1:]
    return order[out]


def _spans(which: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts as one span each: context number, first unit, end."""
    if not len(which):
        return which, start, start
    order = np.lexsort((start, which))
    which, start = which[order], start[order]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (start[1:] > start[:-1] + window)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(which)) - 1
    return which[at], start[at], start[last] + window


SPAN = "did long, bits long, s long, e long"


def _resolve(sorted_rows: DataFrame, kind: Kind) -> DataFrame:
    """Buckets: rows of a name stand together; its windows are compared once all are there."""

    def compare(did: np.ndarray, at: np.ndarray, bits: np.ndarray, units: list[bytes]) -> pa.RecordBatch:
        _, one = np.unique(np.stack([did, at, bits]), axis=1, return_index=True)  # a repeated row gives the same context again
        did, at, bits, units = did[one], at[one], bits[one], [units[i] for i in one]
        which, start, place, joined = _windows(units, at, kind)
        keys = kind.keys(joined)
        begin = np.lexsort((start, did[which])) if kind.firsts else np.arange(len(which))
        order, new = suffix_order(lambda d, w: keys[place[w] + d * kind.step], kind.window // kind.step, begin)
        gone = repeated(order, new, kind.firsts)
        w, s, e = _spans(which[gone], start[gone], kind.window)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (did[w], bits[w], s, e)], ["did", "bits", "s", "e"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, did, at, bits, units = *(np.zeros(0, np.int64) for _ in range(4)), []
        for b in batches:
            h, did, at, bits = (np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate((h, did, at, bits)))
            units += b.column(4).to_pylist()
            if len(h) < ENOUGH or h[0] == h[-1]:
                continue
            n = int(np.flatnonzero(h[1:] != h[:-1])[-1]) + 1  # the last name may go on in the next batch
            for s, e in _slices(h[:n]):
                yield compare(did[s:e], at[s:e], bits[s:e], units[s:e])
            h, did, at, bits, units = h[n:], did[n:], at[n:], bits[n:], units[n:]
        for s, e in _slices(h):
            yield compare(did[s:e], at[s:e], bits[s:e], units[s:e])

    return sorted_rows.select("h", "did", "at", "bits", "units").mapInArrow(run, SPAN)


def _slices(h: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts sorted names into pieces of about ENOUGH rows at the ends of names."""
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)) if len(h) else np.zeros(0, np.int64)
    s = 0
    for e in ends.tolist():
        if e - s >= ENOUGH or e == len(h):
            yield s, e
            s = e


def _resolve_hot(rows: DataFrame, kind: Kind, parts: int) -> tuple[DataFrame, DataFrame]:
    """The spans of one row for each window of hot names, range-partitioned; and the table that they are read from.

    A window's key is its first three keys and a hash of all its units; rows with equal keys are equal.
    """

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, at, bits, units = (*(b.column(k).to_numpy() for k in (1, 2, 3)), b.column(4).to_pylist())
            for s in range(0, len(b), 64):
                which, start, place, joined = _windows(units[s : s + 64], at[s : s + 64], kind)
                keys = kind.keys(joined)
                columns = [keys[place + d * kind.step] for d in range(3)] + [Rolling(kind.codes(joined)).of(place, place + kind.window)]
                packed = np.stack(columns, axis=1).astype(">u8").tobytes()
                key = pa.Array.from_buffers(pa.binary(32), len(which), [None, pa.py_buffer(packed)]).cast(pa.binary())
                mine = [pa.array(x) for x in (did[s : s + 64][which], start, bits[s : s + 64][which])]
                yield pa.RecordBatch.from_arrays([key, *mine], ["w", "did", "s", "bits"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that equal a neighbour, and as edge 1 and 2 the first and last of the bucket."""
        bucket, last, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            if not len(b):
                continue
            w = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)
            cols = [b.column(k).to_numpy() for k in (1, 2, 3)]
            if last is not None:
                w, cols = np.concatenate([last[0], w]), [np.concatenate(x) for x in zip(last[1], cols, strict=True)]
            same = (w[1:] == w[:-1]).all(axis=1)
            gone = np.zeros(len(w), bool)
            gone[1:] = same
            if not kind.firsts:
                gone[:-1] |= same
            if last is not None:
                gone[0] |= last[2]
            edge = np.zeros(len(w), np.int32)
            edge[0] = first
            yield pick(bucket, w[:-1], [c[:-1] for c in cols], gone[:-1], edge[:-1])
            if len(w) > 1:
                first = False
            last = (w[-1:], [c[-1:] for c in cols], bool(gone[-1]))
        if last is not None:
            if first:
                yield pick(bucket, *last[:2], np.array([False]), np.array([1], np.int32))
            yield pick(bucket, *last[:2], np.array([last[2]]), np.array([2], np.int32))

    def pick(bucket: int, w: np.ndarray, cols: list[np.ndarray], gone: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        out = np.flatnonzero(gone | (edge > 0))
        keys = [x.tobytes() if e else None for x, e in zip(w[out], edge[out], strict=True)]
        columns = [pa.array(np.full(len(out), bucket, np.int32)), pa.array(keys, pa.binary()), *(pa.array(c[out]) for c in cols), pa.array(gone[out]), pa.array(edge[out])]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "w", "did", "s", "bits", "gone", "edge"])

    windows = rows.select("h", "did", "at", "bits", "units").dropDuplicates(["did", "at", "bits"]).mapInArrow(explode, "w binary, did long, s long, bits long")
    buckets = windows.repartitionByRange(parts, "w", "did", "s", "bits").sortWithinPartitions("w", "did", "s", "bits")
    found = cut(buckets.mapInArrow(compare, "bucket int, w binary, did long, s long, bits long, gone boolean, edge int"), "hot")
    edges = sorted((r.bucket, r.edge, bytes(r.w), r.did, r.s, r.bits) for r in found.filter("edge > 0").collect())  # two a bucket
    across = []
    for (k1, e1, w1, *one), (k2, e2, w2, *two) in zip(edges[:-1], edges[1:], strict=True):
        if (e1, e2) == (2, 1) and k1 != k2 and w1 == w2:
            across += [two] if kind.firsts else [one, two]
    more = rows.sparkSession.createDataFrame([tuple(x) for x in across], "did long, s long, bits long")
    whole = found.filter("gone").select("did", "s", "bits").unionByName(more)
    return whole.select("did", "bits", "s", (F.col("s") + kind.window).alias("e")), found


def repeated_spans(docs: DataFrame, kind: Kind, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """Per row of docs: doc_id, text, spans (array of s, e in units, in any order, may overlap; null: none).

    Also the tables that this is read from, to be discarded when it has been.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text, number = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    did = F.coalesce(number, F.lit(NULL_ID)).alias("did")
    texts = docs.select(number.alias("doc_id"), did, _text_bits(text, number).alias("bits"), text.alias("text"))
    anchors = _anchors(texts, kind)
    # Both sides of the joins are tables, dealt out for the join alone, so that a hot name can be split.
    often = cut(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    shared = cut(anchors.join(often, "h"), "shared", drop=[often])
    member = F.struct("did", "at", "bits")
    # Where the first occurrence stays, rows that repeat an id and a text are one document; else each is a place of its own.
    many = (F.col("first") != F.col("last")) if kind.firsts else (F.col("n") > 1)
    classes = shared.groupBy("h", "ctx").agg(F.min(member).alias("first"), F.max(member).alias("last"), F.count("*").alias("n"))
    classes = cut(classes.select("h", "ctx", "first", many.alias("many")), "classes")
    direct = shared.join(classes.filter("many").select("h", "ctx", "first"), ["h", "ctx"])
    if kind.firsts:
        direct = direct.filter(member != F.col("first"))
    lo, n = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255))
    direct = cut(direct.select("did", "bits", lo.alias("s"), (lo + n - 1 + kind.window).alias("e")), "direct", drop=[shared])

    names = cut(classes.groupBy("h").agg(F.count("*").alias("classes")).filter("classes > 1"), "names")
    wanted = classes.join(names, "h").select("h", "first.did", "first.at", "first.bits", (F.col("classes") > HOT).alias("hot"))
    wanted = wanted.groupBy("did", "bits").agg(F.collect_list(F.struct("h", "at", "hot")).alias("wanted"))
    some = texts.join(wanted, ["did", "bits"]).select("did", "text", "wanted", "bits")
    contexts = cut(_contexts(some, kind), "contexts", drop=[classes, names])
    lead = F.expr(f"substring(units, cast((at & 255) * {np.dtype(kind.dtype).itemsize} + 1 as int), 16)")
    buckets = contexts.filter("NOT hot").withColumn("lead", lead).repartitionByRange(parts, "lead", "h").sortWithinPartitions("lead", "h")
    found, tables = direct.unionByName(_resolve(buckets, kind)), [direct]
    if contexts.filter("hot").limit(1).count():
        more, table = _resolve_hot(contexts.filter("hot"), kind, parts)
        found, tables = found.unionByName(more), [direct, table]
    spans = cut(found.groupBy("did", "bits").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans", drop=[*tables, contexts])
    return texts.join(spans, ["did", "bits"], "left").select("doc_id", "text", "spans"), [spans]


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The spans' union as runs in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def gaps(n: int, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of 0 to n the runs leave."""
    edges = [0, *(x for run in runs for x in run), n]
    return [(s, e) for s, e in zip(edges[::2], edges[1::2], strict=True) if e > s]


def finished(result: DataFrame, tables: list[DataFrame], name: str) -> DataFrame:
    """The result as a table of its own, without the tables that it was read from."""
    out = cut(result, name)
    discard(*tables)
    return out
