"""Words of many texts as flat numpy arrays.

A batch of texts is one byte buffer with offsets, as Arrow holds it.  Words,
their 64-bit hashes and hashes of word windows come from array operations over
the whole buffer, so no Python code runs per word.

Hashes are polynomial (Rabin-Karp) over random byte values modulo 2**64 with a
final mix; two different words or windows collide with a probability of about
2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U(0xD6E8FEB86659FD93)

_bytes = np.arange(256)
#: Words split at ASCII white space: [^\x20\x09-\x0D]+
SPACED = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: ASCII letters and digits and all that is not ASCII.
ALNUM = (
    ((_bytes >= 0x30) & (_bytes <= 0x39))
    | ((_bytes >= 0x41) & (_bytes <= 0x5A))
    | ((_bytes >= 0x61) & (_bytes <= 0x7A))
    | (_bytes >= 0x80)
)
_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_folded = _values.copy()
_folded[0x41:0x5B] = _values[0x61:0x7B]


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return up(_BASE), up(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Texts(NamedTuple):
    """Bytes of some texts, one after another, with where each begins and ends."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def part(self, at: int, to: int) -> Texts:
        """Texts at to to - 1."""
        lo, hi = self.offsets[at], self.offsets[to]
        return Texts(self.data[lo:hi], self.offsets[at : to + 1] - lo)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """For each text the sum over its bytes."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words(NamedTuple):
    """Byte spans of words; words first[d] to first[d + 1] belong to text d."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts_of(column: pa.Array) -> Texts:
    """An Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def runs(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of whole items of about `most` bytes; a longer item comes alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def chunks(texts: Texts, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of texts of about `most` bytes, with their places."""
    for at, to in runs(texts.offsets, most):
        yield at, to, texts.part(at, to)


def words_of(texts: Texts, kept: np.ndarray) -> Words:
    """Maximal runs of bytes for which kept holds; no run crosses from one text to the next."""
    data, offsets = texts
    inside = kept[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[filled] = inside[filled]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans; fold: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = len(data) + 1
    power, inverse = _powers(max(size, CHUNK_BYTES + 1))
    total = np.zeros(size, np.uint64)
    values = (_folded if fold else _values)[data]
    values *= power[: len(data)]
    np.cumsum(values, out=total[1:], dtype=np.uint64)
    out = total[ends]
    out -= total[starts]
    out *= inverse[starts]
    out += (ends - starts).astype(np.uint64) * _STEP
    return mix(out)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of `size` words, wherever texts end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= _STEP
        out += hashes[k : k + n]
    return mix(out)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Word indexes at which a window of `size` words of one text starts."""
    n = int(first[-1])
    if n < size:
        return np.zeros(0, np.int64)
    whole = np.zeros(n, bool)
    lengths = np.diff(first)
    long = lengths >= size
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first[:-1][long], 1)
    np.add.at(edge, first[1:][long] - size + 1, -1)
    whole = np.cumsum(edge[:n]) > 0
    return np.flatnonzero(whole)


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places the half-open runs cover: their union."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] values), starts[1], ..."""
    total = int(counts.sum())
    shift = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(shift - starts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
