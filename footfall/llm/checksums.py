"""CRC-32 of many byte spans at once."""

from __future__ import annotations

import zlib

import numpy as np

POLYNOMIAL = 0xEDB88320
LONG = 40  # bytes; longer spans go through zlib one by one
SPACE = 0x20


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    return table


TABLE = _table()


def step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """The register after one more byte of each span."""
    return TABLE[(state ^ byte) & np.uint32(255)] ^ state >> np.uint32(8)


def registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """The register after each span; ``state`` has the registers before them, so that spans can be carried on.

    Spans are taken by falling size, so that at every byte those still open lie together.
    """
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG + 1).astype(np.int8), kind="stable")
    start, size = starts[order], size[order]
    own = np.full(len(order), 0xFFFFFFFF, np.uint32) if state is None else state[order]
    n_long = int((size > LONG).sum())
    for i in range(n_long):
        span = data[start[i] : start[i] + size[i]].tobytes()
        own[i] = zlib.crc32(span, int(own[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = size[n_long:]
    open_ = len(short) - np.cumsum(np.bincount(short, minlength=1))  # spans longer than 0, 1, ... bytes
    for j, n in enumerate(open_.tolist()):
        if not n:
            break
        at = slice(n_long, n_long + n)
        own[at] = step(own[at], data[start[at] + j])
    out = np.empty(len(order), np.uint32)
    out[order] = own
    return out


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each span."""
    return ~registers(data, starts, ends)
