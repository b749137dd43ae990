"""Vectorised words of an Arrow text column: bounds, 64-bit hashes and hashes of word windows.

Works on the UTF-8 bytes of many texts at once, so no Python object is made per word.  Hashes are
polynomials modulo 2**64 over fixed random byte values, followed by a mixing step; they depend on the
word alone and are equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

# Texts are taken in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)  # odd, and base - 1 is divisible by 4 only
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Words are runs without white space: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of digits, letters and non-ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
ALPHANUMERIC = np.ones(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    ALPHANUMERIC[_low:_high + 1] = False
SAME_BYTES = np.arange(256, dtype=np.uint8)
LOWER_ASCII = SAME_BYTES.copy()
LOWER_ASCII[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            step = np.full(n, _BASE)
            step[0] = 1
            self.up = np.cumprod(step, dtype=np.uint64)
            step[1:] = inverse
            self.down = np.cumprod(step, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent polynomial hash of values[start:end] for each pair."""
    up, down = _POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Words:
    """Words of a group of texts, in order: byte bounds in ``data`` and the text of each."""

    first_row: int
    data: np.ndarray
    bounds: np.ndarray  # byte offsets of the texts in data, one more than texts
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # text of each word, counted from first_row
    fold: np.ndarray  # byte mapping applied before hashing

    @property
    def n_rows(self) -> int:
        return len(self.bounds) - 1

    def part(self, which: slice | np.ndarray) -> Words:
        """Some of the words, of the same texts."""
        return Words(self.first_row, self.data, self.bounds, self.starts[which], self.ends[which], self.rows[which], self.fold)

    @cached_property
    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        sums = window_sums(_BYTE_VALUES[self.fold[self.data]], self.starts, self.ends)
        return mix(sums + (self.ends - self.starts).astype(np.uint64))

    @cached_property
    def row_bounds(self) -> np.ndarray:
        """Offsets of the texts in the list of words."""
        return np.searchsorted(self.rows, np.arange(self.n_rows + 1))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every window of ``size`` words inside one text."""
        n = len(self.starts)
        if n < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.rows[:n - size + 1] == self.rows[size - 1:])
        return at, mix(window_sums(self.hashes, at, at + size))


def _bounds(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, dtype=kind)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    return bounds, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def word_groups(
    text: pa.Array | pa.ChunkedArray, table: np.ndarray = NOT_SPACE, fold: np.ndarray = SAME_BYTES
) -> Iterator[Words]:
    """Words of all texts (null: none), group by group, every text whole in one group."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if not len(text):
        return
    text = text.fill_null("")
    bounds, data = _bounds(text)
    row = 0
    while row < len(text):
        end = int(np.searchsorted(bounds, bounds[row] + GROUP_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(text))
        own = bounds[row:end + 1] - bounds[row]
        part = data[bounds[row]:bounds[end]]
        n = len(part)
        word = table[part]
        edge = np.zeros(n + 1, dtype=bool)
        edge[own] = True
        before, after = edge[:n].copy(), edge[1:].copy()
        before[1:] |= ~word[:-1]
        after[:-1] |= ~word[1:]
        if n:
            before[0] = after[-1] = True
        starts = np.flatnonzero(word & before)
        ends = np.flatnonzero(word & after) + 1
        rows = np.searchsorted(own, starts, "right") - 1
        yield Words(row, part, own, starts, ends, rows, fold)
        row = end


def covered_words(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words that starts at one of ``starts``."""
    edge = np.zeros(n + size + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n] > 0
