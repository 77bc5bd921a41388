"""Words of whole texts as numpy arrays.

A word is a maximal run of characters other than space and the ASCII controls 9 to 13. In UTF-8 these separators are
single bytes that never occur inside a character, so words are found on the bytes of a whole Arrow column at once.
NULL texts count as empty. Batches are cut into slices of a few megabytes, so memory follows the longest single text,
not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

# Text bytes handled at once; a longer single text makes a slice of its own.
SLICE_BYTES = 2 << 20

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# letters: a-z, A-Z and every byte of characters beyond ASCII
LETTER_BYTE = np.zeros(256, bool)
LETTER_BYTE[65:91] = LETTER_BYTE[97:123] = LETTER_BYTE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Fixed random numbers: one per byte value, and odd bases of the polynomial hashes.
_BYTE_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64)
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
SECOND_BASE = 0xA0761D6478BD642F

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2^64, of an odd base and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            tables.append(np.multiply.accumulate(p))
        have = tables[0], tables[1]
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


class Words:
    """Words of some texts: `start` and `end` are byte places in `data`; text i has words first[i] to first[i + 1]."""

    def __init__(self, texts: pa.Array, lower: bool = False, inside: np.ndarray = _WORD_BYTE):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets - offsets[0]
        n = len(data)
        inside = inside[data]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before[self.offsets[:-1][self.offsets[:-1] < n]] = False
            after[self.offsets[1:] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of every word, from prefix sums over the bytes."""
        up, down = powers(BYTE_BASE, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        terms = _BYTE_VALUE[self.data]
        terms *= up[: len(terms)]
        np.cumsum(terms, out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def windows(x: np.ndarray, length: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hashes of all windows of `length` consecutive values (modulo 2^64, scrambled)."""
    n = len(x) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up, out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[:n])


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Indexes of the words at which a window starts that ends in the same text."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    return np.repeat(first[:-1], counts) + ranges(counts)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for every count, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts hold about `limit` bytes, or one text if that is longer."""
    if batch.num_rows == 0:
        return
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of consecutive stretches of `values`."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def as_long(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed integers that Spark knows."""
    return np.ascontiguousarray(x).view(np.int64)
