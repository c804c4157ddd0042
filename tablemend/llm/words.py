"""Words of many texts at once, as 64-bit hashes over the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Odd constants of the hashes.
ODD, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters as they are.
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of words between white space: all but blank and 9 to 13.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Bytes of words of ASCII digits and letters and of everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that near inputs give unrelated outputs."""
    x = x + ODD
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in a row, and where each value begins and ends; null counts as empty."""
    values = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, name: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes in ``name`` each, or one value if it is longer."""
    if not len(batch):
        return
    ends = flat(batch.column(name))[1]
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a column of texts, ASCII letters lower-cased unless ``letters`` says otherwise.

    ``first[i]`` to ``first[i + 1]`` are the words of text i; ``hash``, ``start`` and ``end`` describe each word.
    """

    def __init__(self, column: pa.Array, kind: np.ndarray, letters: np.ndarray = LOWER) -> None:
        self.data, ends = flat(column)
        inside = kind[self.data]
        n = len(inside)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[ends[:-1][ends[:-1] < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = ends[1:] - 1
        after[last[last >= 0]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, ends)
        length = self.end - self.start
        if len(length):
            powers = np.cumprod(np.full(int(length.max()), MIX_1, np.uint64))
            gaps = np.diff(np.append(self.start, n))
            place = np.arange(self.start[0], n) - np.repeat(self.start, gaps)
            part = inside[self.start[0] :]
            value = np.where(part, letters[self.data[self.start[0] :]].astype(np.uint64) + np.uint64(1), np.uint64(0))
            value *= powers[np.where(part, place, 0)]
            self.hash = mix(np.add.reduceat(value, self.start - self.start[0]) + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    @cached_property
    def raw(self) -> bytes:
        """The bytes of all texts."""
        return self.data.tobytes()

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive), joined by blanks."""
        return b" ".join(LOWER[self.data[s:e]].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def spread(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * MIX_1 + hashes[k : k + n]
    return mix(total)
