"""Operator 6, suffix-array dedup: bytes in WINDOW-byte strings that occur more than once.

Sorting every suffix of a corpus would shuffle hundreds of times its size. Two equal strings of WINDOW bytes contain equal
strings of GRAM bytes at equal places, and the one with the smallest hash among them is the same in both: it is their
anchor. So only suffixes near anchors matter, and of those only the ones whose anchor occurs elsewhere; copies with equal
bytes all around an anchor are summed up first and one of them goes on. Suffixes are dealt out by range of the 16 bytes
that lead at their anchor, between splitters that the range partitioner samples; a bucket puts its suffixes in order by a
multikey sort of eight bytes a level, to the depth of WINDOW bytes, and compares neighbours. Suffixes around an anchor that
has very many surroundings are range-partitioned by themselves: a run of equal ones may then cross buckets, and the edges
of buckets are compared with those of the next (see repeats).

Null and empty texts have no bytes; texts shorter than WINDOW keep all of theirs. Matches never cross documents. Each row
is a document of its own, so rows that repeat an id, with the same text or another, are copies like any others. A null id
is an id like others. Other columns are ignored; an empty table gives an empty result. Texts are taken whole, long ones
piece by piece; texts of 2**30 bytes or more are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackframe.llm.common import BYTE_CODES, Chunk, Rolling, binary
from trackframe.llm.repeats import Kind, finished, gaps, merged, repeated_spans

WINDOW, GRAM = 200, 40
_PLACE = np.uint64((1 << 30) - 1)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of width values the place of the smallest; the first of equals (by their upper 34 bits)."""
    n = len(values)
    tagged = values & ~_PLACE | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = tagged
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(n - width + 1)
    return (np.minimum(behind[at], ahead[at + width - 1]) & _PLACE).astype(np.int64)


def anchors(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within a document: start, name and place of the gram with the smallest hash."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none.view(np.uint64), none
    at = np.arange(len(data) - GRAM + 1)
    grams = Rolling(BYTE_CODES[data]).of(at, at + GRAM)
    place = sliding_argmin(grams, WINDOW - GRAM + 1)
    inside = np.zeros(len(data) + 1, np.int64)
    size = np.diff(first)
    fits = size >= WINDOW
    np.add.at(inside, first[:-1][fits], 1)
    np.add.at(inside, first[1:][fits] - WINDOW + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    return start, grams[place[start]], place[start]


def big_endian(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there as one number, so that numbers are ordered as the bytes are."""
    out = np.zeros(max(0, len(data) - 7), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[k : k + len(out)].astype(np.uint64)
    return out


def units(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    return chunk.data, chunk.offsets


KIND = Kind(
    window=WINDOW, dtype=np.uint8, units=units, split=lambda data, at: at, codes=lambda data: BYTE_CODES[data], keys=big_endian, step=8, anchors=anchors, firsts=False
)
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless texts is False, kept (the bytes that stay, which may split characters)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = binary(b.column(1))
            raw, spans = memoryview(data), b.column(2)
            rows, hashes, kept, held, since = [], [], [], 0, 0
            for i in range(len(b)):
                text, gone = raw[offsets[i] : offsets[i + 1]], merged(spans[i].as_py())
                stay = gaps(len(text), gone)
                digest = hashlib.sha256()
                for s, e in stay:
                    digest.update(text[s:e])
                rows.append((len(text), sum(e - s for s, e in gone), len(gone)))
                hashes.append(digest.hexdigest())
                if texts:
                    kept.append(b"".join(text[s:e] for s, e in stay))
                    held += len(kept[-1])
                if held > 1 << 21 or i == len(b) - 1:
                    n, removed, runs = zip(*rows, strict=True)
                    columns = [b.column(0).slice(since, len(rows)), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(hashes)]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if texts else [])], names)
                    rows, hashes, kept, held, since = [], [], [], 0, i + 1

    names = [c.split()[0] for c in DIGEST.split(", ")] + ["kept"] * texts
    found, tables = repeated_spans(docs, KIND, id_col, text_col)
    out = found.mapInArrow(run, DIGEST + ", kept binary" * texts)
    return out if texts else finished(out, tables, "kept")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the bytes that stay don't leave the worker that hashes them."""
    return dedup(docs, texts=False)
