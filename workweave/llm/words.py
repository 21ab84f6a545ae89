"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

Texts come as Arrow string arrays, straight from a task's record batch; nulls count as empty.
Equal words have equal hashes. Different ones differ but for odds of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space, which parts words: [\x20\x09-\x0D].
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text handled at a time inside a task; one longer text is a piece of its own.
PIECE = 1 << 18

_P = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["up"].size < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``values[start:end]`` that depends on its values and their order."""
    up, down = _power_tables(values.size + 1)
    sums = np.zeros(values.size + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * up[: values.size], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` values from each one on, as far as they reach."""
    if values.size < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(values.size + 1)
    sums = np.zeros(values.size + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: values.size], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: values.size - width + 1])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each begins (and the last ends)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[at[0]: at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges whose texts hold about ``limit`` bytes each."""
    _, at = flat(batch.column(column))
    first, rows = 0, batch.num_rows
    while first < rows:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of texts: hash, byte range in its text, and the first word of each text."""

    def __init__(self, texts: pa.Array, separator: np.ndarray = SEPARATOR,
                 fold: np.ndarray = LOWER):
        data, at = flat(texts)
        self.data, self.at = data, at
        part = separator[data]
        opens = np.zeros(data.size + 1, dtype=bool)
        opens[at] = True
        word = ~part
        left, right = word.copy(), word.copy()
        if data.size:
            left[1:] &= part[:-1] | opens[1:-1]
            right[:-1] &= part[1:] | opens[1:-1]
        self.starts, self.ends = np.flatnonzero(left), np.flatnonzero(right) + 1
        self.first = np.searchsorted(self.starts, at)
        self.hash = run_hash(fold[data].astype(np.uint64) + np.uint64(1), self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_hash(self) -> np.ndarray:
        """One hash for the word sequence of each text."""
        return run_hash(self.hash, self.first[:-1], self.first[1:])

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each word on; windows that cross texts mean nothing."""
        if self.hash.size == 0:
            return self.hash
        total = np.zeros_like(self.hash)
        factor = 1
        for j in range(width):
            shifted = self.hash[j:]
            total[: shifted.size] += shifted * np.uint64(factor)
            factor = factor * 0xA24BAED4963EE407 % (1 << 64)
        return mix(total)

    def shingles(self, width: int) -> Iterator[np.ndarray]:
        """Per text its sorted distinct shingles; a text with fewer words is one whole shingle."""
        every, whole = self.windows(width), self.text_hash()
        for i in range(self.first.size - 1):
            a, b = self.first[i], self.first[i + 1]
            if b - a >= width:
                found = np.sort(every[a: b - width + 1])
                new = np.ones(found.size, dtype=bool)
                new[1:] = found[1:] != found[:-1]
                yield found[new]
            else:
                yield whole[i: i + 1] if b > a else whole[:0]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)
