"""Operator 3, benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Words are runs of letters and digits, ASCII capitals lowered. The SEED-word n-grams of all test items are counted in
the whole corpus; of each item the RARE share of n-grams with the lowest counts (and all that tie with them) are its
seeds, so an item that has been copied very often still has seeds. Where a document holds a seed, the alignment of the
two along that diagonal is scored by Smith-Waterman (match 2, mismatch -1, gap -1) of the whole item against the words
around it. Its score over twice the item's number of words, 1 for an exact copy, must reach LEAST; items below SEED words
are looked for as one n-gram of their own length.

Seeds of at most BLOCK items and BLOCK_CHARACTERS characters at a time (some 40 MB) are broadcast to the tasks; more items take
more passes over the corpus. Results: doc_id, item_id, score and the words of the best alignment, one row per pair that
reaches LEAST. A document's regions are found and scored in the document's own task; nothing is collected.

Null and empty texts and items have no words and match nothing. Repeated items are reported by id with the best score;
repeated documents row by row. Null ids are reported as null. Other columns are ignored; an empty table gives an empty
result. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import BYTE_CODES, LETTER_KINDS, Chunk, Rolling, chunks, cut

SEED, RARE, LEAST, BAND = 3, 0.75, 0.5, 12
BLOCK, BLOCK_CHARACTERS = 20_000, 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where each document's words begin."""
    starts, ends, doc = chunk.words(LETTER_KINDS)
    return Rolling(BYTE_CODES[chunk.data]).of(starts, ends), np.searchsorted(doc, np.arange(len(chunk) + 1))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n-gram of a sequence of word hashes; those that cross documents are for the caller to leave out."""
    at = np.arange(max(0, len(words) - n + 1))
    return Rolling(words).of(at, at + n) if len(at) else np.zeros(0, np.uint64)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment of item in text: score and the place after its last word in text.

    Row by row; gaps along a row are a running maximum, so each row is a few vector operations.
    """
    slope = -GAP * np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        cell = np.maximum(row + GAP, 0)
        np.maximum(cell[1:], row[:-1] + np.where(text == w, MATCH, MISMATCH), out=cell[1:])
        row = np.maximum.accumulate(cell + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


class Seeds:
    """Sorted seed hashes by n-gram length, each with the items and places that have it."""

    def __init__(self, items: list[np.ndarray]) -> None:
        self.items = items
        self.grams: list[tuple[int, np.ndarray]] = [(min(SEED, len(w)), grams(w, min(SEED, len(w)))) for w in items]
        self.lengths = sorted({n for n, g in self.grams if n})

    def distinct(self, n: int) -> np.ndarray:
        return np.unique(np.concatenate([g for k, g in self.grams if k == n]))

    def rare(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: hashes in order, with item number and place, of each item's rarest n-grams."""
        out: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {n: [] for n in self.lengths}
        for i, (n, g) in enumerate(self.grams):
            if n:
                keys, often = counts[n]
                c = often[np.searchsorted(keys, g)]
                ok = np.flatnonzero(c <= np.sort(c)[int(np.ceil(RARE * len(c))) - 1])
                out[n].append((g[ok], np.full(len(ok), i), ok))
        made = {}
        for n, parts in out.items():
            h, i, q = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            made[n] = (h[order], i[order], q[order])
        return made


def _hits(words: np.ndarray, first: np.ndarray, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a chunk's n-grams that are among the sorted keys, and where in keys; n-grams within documents only."""
    g = grams(words, n)
    if not len(g) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(keys, g)
    at[at == len(keys)] = 0
    p = np.flatnonzero(keys[at] == g)
    last = first[np.searchsorted(first, p, side="right")] if len(p) else p
    return p[p + n <= last], at[p[p + n <= last]]


def _block(docs: DataFrame, ids: list, texts: list[bytes]) -> DataFrame:
    """The leaks of one block of items."""
    (every,) = chunks(pa.array(texts, pa.large_binary()), limit=1 << 30, lower=True)
    words, first = word_hashes(every)
    seeds = Seeds([words[s:e] for s, e in zip(first[:-1], first[1:], strict=True)])
    known = {n: seeds.distinct(n) for n in seeds.lengths}
    context = docs.sparkSession.sparkContext
    sent_known = context.broadcast(known)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent_known.value
        total = {n: np.zeros(len(k), np.int64) for n, k in known.items()}
        for b in batches:
            for c in chunks(b.column(1), lower=True):
                w, f = word_hashes(c)
                for n, k in known.items():
                    total[n] += np.bincount(_hits(w, f, n, k)[1], minlength=len(k))
        for n, k in known.items():
            some = np.flatnonzero(total[n])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(k[some].view(np.int64)), pa.array(total[n][some])], ["n", "gram", "times"])

    # At most BLOCK_CHARACTERS n-grams come back.
    found = docs.mapInArrow(count, "n int, gram long, times long").groupBy("n", "gram").agg(F.sum("times").alias("times")).toArrow()
    counts = {}
    for n, k in known.items():
        times, mine = np.zeros(len(k), np.int64), found.filter(pc.equal(found.column("n"), n))
        times[np.searchsorted(k, mine.column("gram").to_numpy().view(np.uint64))] = mine.column("times").to_numpy()
        counts[n] = (k, times)
    sent = context.broadcast((seeds.rare(counts), seeds.items, ids))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, items, ids = sent.value
        for b in batches:
            rows: list[tuple] = []
            for c in chunks(b.column(1), lower=True):
                w, f = word_hashes(c)
                regions = [np.zeros((0, 3), np.int64)]
                for n, (keys, item, place) in rare.items():
                    distinct = np.unique(keys)
                    p, at = _hits(w, f, n, distinct)
                    low, high = np.searchsorted(keys, distinct[at]), np.searchsorted(keys, distinct[at], side="right")
                    many = high - low
                    entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                    where = np.repeat(p, many)
                    doc = np.searchsorted(f, where, side="right") - 1
                    band = (where - place[entry]) // BAND
                    regions.append(np.unique(np.stack([doc, item[entry], band], axis=1), axis=0))
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for d, i, band in np.unique(np.concatenate(regions), axis=0).tolist():
                    lo, hi = max(int(f[d]), band * BAND - BAND), min(int(f[d + 1]), (band + 1) * BAND + len(items[i]) + BAND)
                    score, end = align(items[i], w[lo:hi])
                    ratio = score / (MATCH * len(items[i]))
                    if ratio >= LEAST and ratio > best.get((d, i), (0.0,))[0]:
                        back = align(items[i][::-1], w[lo : lo + end][::-1])[1]
                        best[d, i] = (ratio, lo + end - back - int(f[d]), lo + end - int(f[d]))
                rows += [(c.first + d, i, *v) for (d, i), v in best.items()]
            columns = [pa.array([b.column(0)[r[0]].as_py() for r in rows], pa.int64()), pa.array([ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[0] for r in rows], pa.int64())], ["doc_id", "item_id", "score", "word_start", "word_end", "row"])

    return docs.mapInArrow(search, "doc_id long, item_id long, score double, word_start long, word_end long, row long").drop("row")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, word_start, word_end of each pair of a document and an item that it holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, ids, texts, size = None, [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if ids and (len(ids) >= BLOCK or size + len(r[1]) > BLOCK_CHARACTERS):
            part = _block(rows, ids, texts)
            out, ids, texts, size = part if out is None else out.unionByName(part), [], [], 0
        ids.append(r[0])
        texts.append(r[1].encode())
        size += len(r[1])
    if ids:
        part = _block(rows, ids, texts)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, word_start long, word_end long")
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "word_start", "word_end")).alias("x")).select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose id has no leak; rows without id stay. The ids are far fewer than the rows, and are joined."""
    found = cut(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
