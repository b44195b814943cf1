"""Vectorised text helpers shared by the corpus operators (run inside Spark tasks).

Texts arrive as Arrow string columns; everything here works on the column's
UTF-8 bytes, half a megabyte at a time, so a task's memory is bounded by the
slice size plus the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_U = np.uint64
_BASE = _U(0xD6E8FEB86659FD93)
_BASE_INV = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

#: The characters that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            row = np.full(n, base, _U)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Rabin-Karp hashes of any stretch of a symbol sequence, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = powers(n + 1)
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(symbols * up[:n], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def windows(self, length: int) -> np.ndarray:
        """The hash of every window of that length, by its start."""
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:-length]) * self.down[:n] if n > 0 else np.zeros(0, _U)


@dataclass
class Slice:
    """Consecutive rows of a batch: row numbers [first, first + len(lo)), text i is data[lo[i]:hi[i]]."""

    first: int
    data: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.lo[i] : self.hi[i]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column without nulls, in slices of about `limit` bytes."""
    column = column.cast(pa.large_string()) if len(column) else column
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Slice(first, data[at[first] : at[last]], at[first:last] - at[first], at[first + 1 : last + 1] - at[first])
        first = last


@dataclass
class Words:
    """Word w is data[start[w]:end[w]]; text i has words [lo[i], hi[i])."""

    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def words(part: Slice) -> Words:
    """The maximal runs of other characters than space and \\x09-\\x0D; they never cross texts."""
    solid = ~SPACE[part.data]
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    some = part.hi > part.lo
    begin[part.lo[some]] |= solid[part.lo[some]]
    finish[part.hi[some] - 1] |= solid[part.hi[some] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Words(start, end, np.searchsorted(start, part.lo), np.searchsorted(start, part.hi))


def word_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    h = Rolling(BYTE_VALUE[data]).hash(found.start, found.end)
    return mix(h + (found.end - found.start).astype(_U) * _U(0x9E3779B97F4A7C15))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


_PLACE_BITS = _U(26)


def sliding_least(keys: np.ndarray, width: int, at_once: int = 1 << 25) -> np.ndarray:
    """The place of the least key (leftmost on a tie) of keys[i:i+width], for every i; keys are below 2**38, and so long as one likes."""
    n, out = len(keys) - width + 1, []
    at_once = min(at_once, (1 << 26) - width)
    for start in range(0, n, at_once):
        part = keys[start : start + min(at_once, n - start) + width - 1]
        least = sliding_min((part << _PLACE_BITS) | np.arange(len(part), dtype=_U), width)
        out.append((least & ((_U(1) << _PLACE_BITS) - _U(1))).astype(np.int64) + start)
    return np.concatenate(out)


@dataclass
class Runs:
    """Maximal stretches of windows [first, last] (by start) that share one anchor."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    content: np.ndarray


def window_runs(rolling: Rolling, lo: np.ndarray, hi: np.ndarray, length: int, gram: int) -> Runs:
    """Cut the windows of every text into runs around content-chosen anchors.

    The anchor of a window is the start of its `gram`-symbol substring of least
    hash (leftmost on a tie), so equal windows have equal anchors at equal
    offsets, wherever they stand. A run's `gram` is the hash at its anchor, its
    `content` identifies all symbols that its windows cover and where the anchor
    lies in them.
    """
    n = len(rolling.prefix) - 1
    fits = hi - lo >= length
    if n < length or not fits.any():
        z = np.zeros(0, np.int64)
        return Runs(z, z, z, z.astype(_U), z.astype(_U))
    hashes = mix(rolling.windows(gram))
    least = sliding_least(hashes >> _PLACE_BITS, length - gram + 1)
    edge = np.zeros(len(least) + 1, np.int32)
    np.add.at(edge, lo[fits], 1)
    np.add.at(edge, hi[fits] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    anchor = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    first, last, anchor = at[head], at[tail], anchor[head]
    shape = ((last - first).astype(_U) << _U(32)) | (anchor - first).astype(_U)
    return Runs(first, last, anchor, hashes[anchor], mix(rolling.hash(first, last + length) ^ mix(shape + _U(1))))

