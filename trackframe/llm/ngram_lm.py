"""Operator 4, LM scoring: an interpolated modified Kneser-Ney bigram model.

Counting. Words become 64-bit hashes. Every map task packs its distinct (previous, word) pairs with their
counts, sorted, into one compressed block for each of PARTS model parts; pairs go to a part by their hash, so a frequent
word is spread over all parts. One task a part merges the blocks to its pair counts. These give, again as packed blocks
by word, the totals N1, N2 and N3+ of each context and the number of distinct contexts of each word, and the counts of
counts from which the three discounts come.

Model. Four kinds of sorted arrays in the shared folder: pair hashes with (c - D(c)) / c(context), context words with
their back-off mass, words with their Kneser-Ney probability (itself interpolated with the uniform distribution over all
words and one unknown), and words with their plain counts for the unigram score of the contract. Workers map the files
into memory and look a batch's distinct, sorted hashes up; nothing is loaded whole. Files appear by an atomic rename, so
a task that runs twice leaves the same file.

score is the log10 probability of the words and the end token, each given the word before; a text starts after a begin
mark that is never predicted. All probabilities given one context sum to 1, unknown words together having one share.

Null and empty texts are the end token alone. Repeated rows count as often as they occur. A null id is in training (its
remainder counts as 0). Other columns are ignored. An empty table gives an empty result; with nothing to train on the
model is uniform over one unknown word. Texts are taken whole.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import BYTE_CODES, Rolling, chunks, cut, discard, mix, shared_dir

#: Hashes of the end token and the begin mark, above all hashes of words, which are at most LAST.
LAST, END, BEGIN = (np.uint64((1 << 64) - k) for k in (3, 2, 1))
PART_BYTES = 12 << 20


def tokens(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk with an end token after each document: hashes, hashes of the token before, document numbers."""
    starts, ends, doc = chunk.words()
    words = np.minimum(Rolling(BYTE_CODES[chunk.data]).of(starts, ends), LAST)
    n = np.bincount(doc, minlength=len(chunk)) + 1
    stop = np.cumsum(n) - 1
    out = np.empty(int(n.sum()), np.uint64)
    mask = np.ones(len(out), bool)
    mask[stop] = False
    out[mask], out[stop] = words, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[stop - n + 1] = BEGIN
    return out, before, np.repeat(np.arange(len(chunk)), n)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of keys (columns of a 2-d array, first column first), sorted, with the sums of the rows of values."""
    if not keys.shape[1]:
        return keys, values
    order = np.lexsort(keys[::-1])
    keys, values = keys[:, order], values[:, order]
    new = np.ones(keys.shape[1], bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    return keys[:, at], np.add.reduceat(values, at, axis=1)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Sorted columns as one compressed block: differences of the first, then bytes of equal weight side by side."""
    planes = [np.array([len(arrays), len(arrays[0])], np.int64).tobytes()]
    for k, a in enumerate(arrays):
        a = np.diff(a.astype(np.uint64), prepend=np.uint64(0)) if k == 0 else a.astype(np.uint64)
        planes.append(a.view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    k, n = np.frombuffer(raw, np.int64, 2)
    out = []
    for i in range(k):
        a = np.frombuffer(raw, np.uint8, 8 * n, 16 + 8 * n * i).reshape(8, n).T.copy().view(np.uint64).ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if i == 0 else a)
    return out


def of_parts(part: np.ndarray, keys: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, with its rows in order of keys; what it costs doesn't grow with the number of parts there are."""
    order = np.argsort(part, kind="stable") if keys is None else np.lexsort((keys, part))
    found, at = np.unique(part[order], return_index=True)
    for p, rows in zip(found.tolist(), np.split(order, at[1:]) if len(found) else [], strict=True):
        yield p, rows


def blocks(keys: np.ndarray, values: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """One packed block for each part that has rows."""
    rows = [(p, pack([*keys[:, o], *values[:, o]])) for p, o in of_parts(part)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "block"])


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) ^ mix(word))


def local(path: str) -> str:
    """The shared folder as a path for open(): it must be mounted at the same place on all machines."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped models need a shared folder that is mounted, not {path}")
    return path


def save(folder: str, name: str, array: np.ndarray | bytes) -> None:
    """An array, or a packed block, that appears whole or not at all."""
    path = f"{folder}/{name}"
    with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(array) if isinstance(array, bytes) else np.save(f, array)
    os.replace(f.name, path if isinstance(array, bytes) else f"{path}.npy")


def packed(path: str, columns: int, written: bool) -> list[np.ndarray]:
    """The columns of a packed block that save() has written; empty ones for a part that nothing went to. A file that was
    written and isn't there is an error: the folder isn't the same on all machines."""
    if not written:
        return [np.zeros(0, np.uint64)] * columns
    with open(path, "rb") as f:
        return unpack(f.read())


@lru_cache(maxsize=4096)
def mapped(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def look_up(folder: str, kind: str, part: np.ndarray, keys: np.ndarray, columns: int) -> np.ndarray:
    """The values (0 where absent) of distinct keys in the arrays of a kind; keys are sorted within their part."""
    out = np.zeros((columns, len(keys)))
    for p, o in of_parts(part, keys):
        have, values = mapped(folder, f"{kind}-{p}-keys"), mapped(folder, f"{kind}-{p}-values")
        if len(have):
            i = np.searchsorted(have, keys[o])
            i[i == len(have)] = 0
            hit = have[i] == keys[o]
            out[:, o[hit]] = values[:, i[hit]]
    return out


def _merge(keys: int):
    """Merges packed blocks two by two as they come, so that memory follows the distinct rows."""

    def add(stack: list, item: tuple) -> None:
        stack.append(item)
        while len(stack) > 1 and stack[-2][0].shape[1] <= 2 * stack[-1][0].shape[1]:
            (k1, v1), (k2, v2) = stack.pop(), stack.pop()
            stack.append(summed(np.concatenate([k1, k2], axis=1), np.concatenate([v1, v2], axis=1)))

    def run(found: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        stack: list = []
        for b in found:
            a = unpack(b)
            add(stack, (np.array(a[:keys]), np.array(a[keys:]).astype(np.int64)))
        while len(stack) > 1:
            (k1, v1), (k2, v2) = stack.pop(), stack.pop()
            stack.append(summed(np.concatenate([k1, k2], axis=1), np.concatenate([v1, v2], axis=1)))
        return stack[0] if stack else (np.zeros((keys, 0), np.uint64), np.zeros((1, 0), np.int64))

    return run


class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    def __init__(self, folder: str, parts: int, total: int, distinct: int, uniform: float) -> None:
        self.folder, self.parts, self.total, self.distinct, self.uniform = folder, parts, total, distinct, uniform


def train(docs: DataFrame) -> Model:
    """Counts docs (text string) in Spark and leaves the model in the shared folder."""
    spark = docs.sparkSession
    folder = f"{local(shared_dir(spark))}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    step = np.uint64(parts)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        some = 0
        for b in batches:
            for c in chunks(b.column(0), lower=True):
                word, before, _ = tokens(c)
                held.append(summed(np.stack([before, word]), np.ones((1, len(word)), np.int64)))
                some += held[-1][0].shape[1]
                if some > 1 << 20:
                    yield emit(held)
                    held, some = [], 0
        if held:
            yield emit(held)

    def emit(held: list) -> pa.RecordBatch:
        k, v = summed(np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held], axis=1))
        return blocks(k, v, (pair_hash(k[0], k[1]) % step).astype(np.int64))

    def stats(key: tuple, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By word: of it as a context the pair count, N1, N2 and N3+; of it as a word the number of contexts; its count.
        (before, word), (c,) = _merge(2)(x.as_py() for b in found for x in b.column("block"))
        p = key[0].as_py()
        save(folder, f"raw-{p}", pack([before, word, c]))
        zero = np.zeros_like(c)
        as_context = np.stack([c, c == 1, c == 2, c > 2, zero, zero]).astype(np.int64)
        as_word = np.stack([zero, zero, zero, zero, zero + 1, c]).astype(np.int64)
        k, v = summed(np.concatenate([before, word])[None, :], np.concatenate([as_context, as_word], axis=1))
        out = blocks(k, v, (k[0] % step).astype(np.int64))
        of = np.array([(c == i).sum() for i in (1, 2, 3, 4)], np.int64)
        nothing = [pa.array([None] * out.num_rows, t) for t in (pa.binary(), pa.int32())]
        yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), *nothing], ["part", "block", "counts", "done"])
        mine = [pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([of.tobytes()]), pa.array([p], pa.int32())]
        yield pa.RecordBatch.from_arrays(mine, ["part", "block", "counts", "done"])

    def words(key: tuple, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, v = _merge(1)(x.as_py() for b in found for x in b.column("block"))
        p = key[0].as_py()
        save(folder, f"word-{p}", pack([*k, *v]))
        n = v[4]
        of = [*((n == i).sum() for i in (1, 2, 3, 4)), n.sum(), (n > 0).sum(), v[5].sum()]
        yield pa.RecordBatch.from_arrays([pa.array([np.array(of, np.int64).tobytes()]), pa.array([p], pa.int32())], ["counts", "done"])

    paired = docs.select("text").mapInArrow(count, "part int, block binary")
    first = cut(paired.groupBy("part").applyInArrow(stats, "part int, block binary, counts binary, done int"), "pair-stats")
    second = cut(first.filter("part >= 0").select("part", "block").groupBy("part").applyInArrow(words, "counts binary, done int"), "word-stats")
    pairs_of = sum((np.frombuffer(r[0], np.int64) for r in first.filter("part < 0").select("counts").toLocalIterator()), np.zeros(4, np.int64))
    words_of = sum((np.frombuffer(r[0], np.int64) for r in second.select("counts").toLocalIterator()), np.zeros(7, np.int64))
    d2, d1 = discounts(pairs_of), discounts(words_of[:4])
    types, distinct, total = (int(x) for x in words_of[4:])
    uniform = 1.0 / (distinct + 1)

    # The mass that the word level gives up to the uniform distribution: that of all discounts.
    n1, n2 = int(words_of[0]), int(words_of[1])
    freed = (d1[1] * n1 + d1[2] * n2 + d1[3] * (distinct - n1 - n2)) / types if types else 1.0

    def finish_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, written in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw, done = f"{folder}/word-{p}", f"{folder}/words-{p}-values.npy"
                if os.path.exists(done) and not os.path.exists(raw):
                    continue  # an earlier attempt has ended
                k, *v = packed(raw, 7, written)
                v = np.array(v).astype(np.int64)
                mass = (d2[1] * v[1] + d2[2] * v[2] + d2[3] * v[3]) / np.maximum(v[0], 1)
                low = np.where(v[4] > 0, (v[4] - d1[np.minimum(v[4], 3)]) / max(types, 1) + freed * uniform, freed * uniform)
                save(folder, f"words-{p}-keys", k)
                save(folder, f"words-{p}-values", np.stack([np.where(v[0] > 0, mass, 1.0), low, v[5].astype(float), v[0].astype(float)]))
                if os.path.exists(raw):
                    os.remove(raw)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64())], ["id"])

    def finish_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, written in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw, done = f"{folder}/raw-{p}", f"{folder}/pairs-{p}-values.npy"
                if os.path.exists(done) and not os.path.exists(raw):
                    continue
                before, word, c = packed(raw, 3, written)
                c = c.astype(np.int64)
                context, back = np.unique(before, return_inverse=True)
                of = look_up(folder, "words", (context % step).astype(np.int64), context, 4)[3]
                keys = pair_hash(before, word)
                order = np.argsort(keys)
                save(folder, f"pairs-{p}-keys", keys[order])
                save(folder, f"pairs-{p}-values", ((c - d2[np.minimum(c, 3)]) / of[back])[None, order].astype(np.float32))
                if os.path.exists(raw):
                    os.remove(raw)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64())], ["id"])

    for finish, stats_of in ((finish_words, second), (finish_pairs, first)):
        written = stats_of.filter("done IS NOT NULL").select(F.col("done").cast("long").alias("id"), F.lit(True).alias("written"))
        every = spark.range(0, parts, 1, min(parts, 4096)).join(written, "id", "left")
        every.select("id", F.coalesce("written", F.lit(False)).alias("written")).mapInArrow(finish, "id long").count()
    discard(first, second)
    return Model(folder, parts, total, distinct, freed * uniform)


def discounts(n: np.ndarray) -> np.ndarray:
    """The modified discounts of counts 0, 1, 2 and 3 or more, from the numbers of things seen 1, 2, 3 and 4 times.

    Where some number is 0 they aren't defined; then the plain estimate or one half is taken, kept within the count.
    """
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
    return np.array([0.0, *(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, held_out) with n_tokens, n_known, train_tokens, base_score and score."""
    folder, parts, step = model.folder, model.parts, np.uint64(model.parts)
    base_log = np.log10(model.total + 0.5 * (model.distinct + 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for c in chunks(b.column(1), limit=2 << 20, lower=True):
                word, before, doc = tokens(c)
                both, place = np.unique(np.concatenate([word, before]), return_inverse=True)
                mass, low, count, _ = look_up(folder, "words", (both % step).astype(np.int64), both, 4)
                w, v = place[: len(word)], place[len(word) :]
                mass[mass == 0] = 1.0  # an unseen context leaves all to the word level
                low[low == 0] = model.uniform
                h, back = np.unique(pair_hash(before, word), return_inverse=True)
                high = look_up(folder, "pairs", (h % step).astype(np.int64), h, 1)[0][back]
                p = np.log10(high + mass[v] * low[w])
                per = lambda x: np.bincount(doc, weights=x, minlength=len(c))  # noqa: B023, E731
                for o, x in zip(out, (np.bincount(doc, minlength=len(c)), per(count[w] > 0), per(np.log10(count[w] + 0.5) - base_log), per(p)), strict=True):
                    o.append(x)
            n, known, base, p = (np.concatenate(o) if o else np.zeros(0) for o in out)
            columns = [b.column(0), b.column(2), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.total, np.int64)), pa.array(base), pa.array(p)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the documents that aren't held out, and scores all."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    return score(rows, train(rows.filter(~F.col("held_out"))))
