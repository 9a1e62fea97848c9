"""Operator 7, token counts: byte-pair merging with a heap and a linked list.

The text is split as the tokenizer file says (special strings, normaliser, splitting pattern); each piece becomes its
byte symbols, the last of them marked as the end of a word, and the adjacent pair of lowest rank is merged until none is
left. Only the number of merges is kept: tokens of a piece = initial symbols - merges. No identifiers are made.

Nulls and empty texts count 0 bytes and 0 tokens. Rows are counted one by one, so repeated rows and null ids keep their
place. Other columns are ignored. An empty table gives an empty result. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: Counts of pieces that a worker remembers; when full, it starts anew. This bounds memory and changes no result.
MEMORY = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merges_of(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """How many merges are made: a heap of (rank, place) over a doubly linked list of symbols."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    made = 0
    while heap:
        r, i = heapq.heappop(heap)
        if not symbols[i] or (j := after[i]) < 0 or rank.get((symbols[i], symbols[j])) != r:
            continue  # one of the two has been merged away since
        symbols[i] += symbols[j]
        symbols[j] = ""
        made += 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := rank.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (k := before[i]) >= 0 and (r := rank.get((symbols[k], symbols[i]))) is not None:
            heapq.heappush(heap, (r, k))
    return made


class Counter:
    """Token counts under one tokenizer file of the word-end BPE kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["Split", "ByteLevel"] or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a word-end BPE file")
        self.rank = {tuple(m): i for i, m in reversed([*enumerate(model["merges"])])}
        self.end = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        names = sorted((t["content"] for t in spec["added_tokens"] if t["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        self.known: dict[str, int] = {}

    def piece(self, text: str) -> int:
        symbols = [self.letters[b] for b in text.encode()]
        symbols[-1] += self.end
        return len(symbols) - merges_of(symbols, self.rank)

    def segment(self, text: str) -> int:
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        known, total = self.known, 0
        if len(known) > MEMORY:
            known.clear()
        for p in self.pieces(text):
            n = known.get(p)
            if n is None:
                n = known[p] = self.piece(p)
            total += n
        return total

    def count(self, text: str) -> int:
        """Special strings count one token each; what stands between them is split and merged."""
        if self.special is None or not self.special.search(text):
            return self.segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.segment, parts))


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit). No shuffle; one pass over the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            n = pa.array([count(t.as_py()) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
