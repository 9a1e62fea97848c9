"""Operator 2, substring dedup by recompression: words in WINDOW-word windows that occurred before.

Recompression rounds name runs of equal symbols and pairs of neighbours: a word's symbol is its hash; a round gives each
run its own symbol; then ROUNDS rounds part all symbols in left and right ones by a bit of their name, and name each pair
of a left symbol and a right one. A name is a hash of what it stands for, so all tasks of the Spark job give the same
names without a shuffle: naming is global. What happens to a symbol hangs on its neighbours alone, so equal windows have
equal symbols inside, but for a few at either end that what stands outside could have merged with. From these inner
symbols the GRAM neighbours with the smallest name are the window's anchor: a high-level symbol that all its copies
share. Windows with too few inner symbols fall back on the symbols of a level below. Names are counted over the whole
corpus; those that occur once are dropped, and the windows around the rest are verified: copies with equal words all
around a name are summed up, the others are put in order word by word and compared with their neighbours, see repeats.

The first occurrence stays (by doc_id, then start; a null id counts as the smallest number); all other occurrences' words go. Windows are
judged on the input. Null and empty texts have no words. Rows that repeat an id and a text are one document (neither has
the smaller id); rows that repeat an id with another text are documents of their own. Other columns are ignored; an empty
table gives an empty result. Texts are taken whole, long ones piece by piece; texts of 2**30 bytes or more are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackframe.llm.common import BYTE_CODES, SPACES, Chunk, Rolling, binary, mix
from trackframe.llm.repeats import PIECE, Kind, finished, gaps, merged, repeated_spans

WINDOW, ROUNDS, GRAM = 20, 2, 3
_PLACE = np.uint64((1 << 30) - 1)


def units(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and where each document's words begin."""
    starts, ends, doc = chunk.words()
    return Rolling(BYTE_CODES[chunk.data]).of(starts, ends), np.searchsorted(doc, np.arange(len(chunk) + 1))


def name_runs(symbols: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the maximal runs of equal neighbours, and the run of each. fresh marks where documents begin."""
    new = fresh.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    long = np.diff(np.append(at, len(symbols)))
    named = np.where(long > 1, mix(symbols[at] + long.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), symbols[at])
    return named, np.cumsum(new) - 1


def name_pairs(symbols: np.ndarray, fresh: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after pairing, the new place of each old one, and which old ones are right symbols."""
    right = (mix(symbols + np.uint64(level)) & np.uint64(1)).astype(bool)
    joined = np.zeros(len(symbols), bool)  # to the one before
    joined[1:] = right[1:] & ~right[:-1] & ~fresh[1:]
    at = np.flatnonzero(~joined)
    named = symbols[at].copy()
    pair = np.zeros(len(symbols) + 1, bool)
    pair[:-1] = joined
    two = np.flatnonzero(pair[at + 1])
    named[two] = mix(mix(symbols[at[two]] + np.uint64(2 * level + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ symbols[at[two] + 1])
    return named, np.cumsum(~joined) - 1, right


def smallest(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the smallest name (by its upper 34 bits; the first of equals) in each range low to high, exclusive."""
    tagged = names & ~_PLACE | np.arange(len(names), dtype=np.uint64)
    tables, width = [tagged], 1
    while width * 2 <= int((high - low).max(initial=1)):
        t = tables[-1].copy()
        t[:-width] = np.minimum(t[:-width], t[width:])
        tables.append(t)
        width *= 2
    k = np.log2(np.maximum(high - low, 1)).astype(np.int64)
    stack = np.stack(tables)
    return (np.minimum(stack[k, low], stack[k, high - (1 << k)]) & _PLACE).astype(np.int64)


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within a document: start, name of its anchor, and the word at which that begins."""
    none = np.zeros(0, np.int64)
    inside = np.zeros(len(words) + 1, np.int64)
    fits = np.diff(first) >= WINDOW
    np.add.at(inside, first[:-1][fits], 1)
    np.add.at(inside, first[1:][fits] - WINDOW + 1, -1)
    start = np.flatnonzero(np.cumsum(inside) > 0)
    if not len(start):
        return none, none.view(np.uint64), none
    fresh = np.zeros(len(words) + 1, bool)
    fresh[first] = True
    fresh = fresh[:-1]

    # Levels: symbols, the word at which each begins, and for each window its inner symbols low to high, exclusive.
    levels = [(words, np.arange(len(words)), start, start + WINDOW)]
    symbols, to = name_runs(words, fresh)
    begin = np.flatnonzero(np.diff(to, prepend=-1))
    low, high = to[start] + 1, to[start + WINDOW - 1]
    fresh = fresh[begin]
    for level in range(1, ROUNDS + 1):
        named, to, right = name_pairs(symbols, fresh, level)
        some = high > low
        low, high = np.where(some, low, 0), np.where(some, high, 0)
        low = low + (some & right[low])
        high = high - (some & ~right[np.maximum(high - 1, 0)])
        some = high > low
        low, high = np.where(some, to[np.minimum(low, len(to) - 1)], 0), np.where(some, to[np.maximum(high - 1, 0)] + 1, 0)
        at = np.flatnonzero(np.diff(to, prepend=-1))
        symbols, begin, fresh = named, begin[at], fresh[at]
        levels.append((symbols, begin, low, high))

    name, place = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
    todo = np.arange(len(start))
    for number, (symbols, begin, low, high) in reversed([*enumerate(levels)]):
        lo, hi = low[todo], high[todo]
        mine = hi - lo >= GRAM
        if mine.any():
            at = np.arange(max(0, len(symbols) - GRAM + 1))
            grams = mix(Rolling(symbols).of(at, at + GRAM) + np.uint64(number))
            i = smallest(grams, lo[mine], hi[mine] - GRAM + 1)
            name[todo[mine]], place[todo[mine]] = grams[i], begin[i]
        todo = todo[~mine]
    return start, name, place


def next_separator(data: np.ndarray, at: int) -> int:
    """The first place from at on that no word crosses."""
    while at < len(data):
        part = np.flatnonzero(SPACES[data[at : at + (1 << 16)]])
        if len(part):
            return at + int(part[0])
        at += 1 << 16
    return len(data)


KIND = Kind(
    window=WINDOW, dtype=np.uint64, units=units, split=next_separator, codes=lambda words: words, keys=lambda words: words, step=1, anchors=anchors, firsts=True
)
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_pieces(text: np.ndarray) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time."""
    at = 0
    while at < len(text):
        to = next_separator(text, min(len(text), at + PIECE))
        yield bytes(text[at:to]).split()
        at = to


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, unless texts is False, kept (the words that stay, joined by one space)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = binary(b.column(1))
            spans = b.column(2)
            rows, hashes, kept, held, since = [], [], [], 0, 0
            for i in range(len(b)):
                gone = merged(spans[i].as_py())
                whole, digest, n, left = [], hashlib.sha256(), 0, 0
                for words in word_pieces(data[offsets[i] : offsets[i + 1]]):
                    here = [(max(s - n, 0), min(e - n, len(words))) for s, e in gone if s < n + len(words) and e > n]
                    stay = [w for s, e in gaps(len(words), here) for w in words[s:e]]
                    if stay:
                        part = b" " * (left > 0) + b" ".join(stay)
                        digest.update(part)
                        whole += [part] if texts else []
                    n, left = n + len(words), left + len(stay)
                rows.append((n, n - left))
                hashes.append(digest.hexdigest())
                if texts:
                    kept.append(b"".join(whole).decode())
                    held += len(kept[-1])
                if held > 1 << 21 or i == len(b) - 1:
                    words_in, removed = zip(*rows, strict=True)
                    columns = [b.column(0).slice(since, len(rows)), pa.array(words_in, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes)]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.string())] if texts else [])], names)
                    rows, hashes, kept, held, since = [], [], [], 0, i + 1

    names = [c.split()[0] for c in DIGEST.split(", ")] + ["kept"] * texts
    found, tables = repeated_spans(docs, KIND, id_col, text_col)
    out = found.mapInArrow(run, DIGEST + ", kept string" * texts)
    return out if texts else finished(out, tables, "kept")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the words that stay don't leave the worker that hashes them."""
    return dedup(docs, texts=False)
