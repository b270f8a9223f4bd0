"""Vectorised work on blocks of UTF-8 text inside Arrow tasks: words, and hashes of byte spans.

A block holds whole texts of a few megabytes together, so memory stays bounded
whatever the number of rows in an Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2_000_000
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NEWLINE = 10
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next block of a batch."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the offsets of each; NULL is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives memory back to the system that Arrow and the C library keep for later use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def text_blocks(batches: Iterable[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``size`` bytes of text; a longer text is a slice of its own.

    The powers go after each batch, and after the last one free memory goes back to the system: a worker
    that waits for its next task, of whatever operator, holds no more than its caches.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high > low:
                yield batch.slice(low, high - low)
        _powers.clear()
    release()


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of True that stay inside one text."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~first[:n] if n else inside
    after = np.concatenate((inside[1:], [False])) & ~first[1:] if n else inside
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs without the white space U+0020, U+0009 to U+000D."""
    return spans_of(~SPACE[data], offsets)


class Hasher:
    """64-bit hashes of spans of a sequence (bytes, or hashes), from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        values = BYTE_VALUES[data] if data.dtype == np.uint8 else data
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def sequence_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive items, themselves hashes."""
    out = np.zeros(max(0, len(items) - n + 1), np.uint64)
    for j, weight in enumerate(mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)):
        out += items[j : j + len(out)] * weight
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def gathered(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``values`` of these begins and sizes, one after another."""
    return values[np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
