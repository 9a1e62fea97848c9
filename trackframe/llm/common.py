"""Shared pieces: vectorised text handling for Arrow batches; tables in the shared folder are trackframe.sources.shared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from trackframe.sources.shared import configure, cut, discard, shared_dir

__all__ = ["configure", "cut", "discard", "shared_dir"]

U64 = np.uint64

#: The word separators of the contracts: space and U+0009 to U+000D. ``bytes.split()`` splits on the same set.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

WORD_KINDS = (~SPACES).astype(np.int8)

#: Letters, digits and all bytes of longer UTF-8 characters are of class 1, other signs of class 2.
SIGN_KINDS = np.where(SPACES, 0, 2).astype(np.int8)
SIGN_KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
LETTER_KINDS = (SIGN_KINDS == 1).astype(np.int8)

#: ASCII capitals to small letters, byte by byte, so that UTF-8 stays valid.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Bytes of text that are handled at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-xor-multiply), so that structure in the input doesn't survive."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ODD = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, up to n."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for key, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit symbols in constant time each."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw ^ ((end - start).astype(U64) * U64(0x9E3779B97F4A7C15)))


class Chunk:
    """Some whole documents of a batch: their bytes one after the other, and where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of its document in the chunk.

        kinds gives each byte value its class; a word is a maximal run of one class other than 0. Without it, words are
        runs of all but separators.
        """
        n = len(self.data)
        kind = (WORD_KINDS if kinds is None else kinds)[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        turn = np.ones(n + 1, dtype=bool)
        turn[1:n] = kind[1:] != kind[:-1]
        turn |= edge
        starts = np.flatnonzero(turn[:n] & (kind > 0))
        ends = np.flatnonzero(turn[1:] & (kind > 0)) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if len(buffers) > 2 and buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, lower: bool = False) -> Iterator[Chunk]:
    """The documents of a column in chunks of about limit bytes, whole documents only."""
    data, offsets = binary(column)
    table = np.frombuffer(LOWER, dtype=np.uint8)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        part = data[offsets[at] : offsets[to]]
        yield Chunk(at, table[part] if lower else part, offsets[at : to + 1] - offsets[at])
        at = to
