"""Numpy helpers over the UTF-8 bytes of Arrow string columns: words, rolling hashes and winnowed runs.

All arithmetic is modulo 2**64. A polynomial hash of any stretch comes from two prefix sums, so hashing every window of
a text costs a few vector operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

GRAM_BASE = 0x9E3779B97F4A7C15
RUN_BASE = 0xD6E8FEB86659FD93
SLICE_BYTES = 1 << 18
KEPT_POWERS = 1 << 19  # of one base; more are not kept, for a worker never gives them back
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_C_LIBRARY = ctypes.CDLL(None)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GRAM_BASE))


@lru_cache(maxsize=16)
def _powers_of(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); base must be odd."""
    if n > KEPT_POWERS:
        return _powers_of.__wrapped__(base, n)
    return _powers_of(base, KEPT_POWERS)[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefix(codes: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes)), out=out[1:])
    return out


def stretch_hash(prefixed: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scrambled hashes of the stretches [start, end), independent of where they lie."""
    total = len(prefixed)
    return mix((prefixed[ends] - prefixed[starts]) * powers(inverse(base), total)[starts])


def words(data: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than blank and \\t..\\r; none goes over a text's ``offsets``."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(_IS_SPACE[data], out=solid[1:-1])
    if offsets is None:
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        return edges[0::2], edges[1::2]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    return starts, ends


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word; its length is part of it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = stretch_hash(prefix(BYTE_CODES[data], GRAM_BASE), GRAM_BASE, starts, ends)
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(RUN_BASE))


def release() -> None:
    """Give freed memory back. Workers are kept for later tasks and would hold on to the most they ever needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_C_LIBRARY, "malloc_trim", None)
    if trim:
        trim(0)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text has a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end
        at = end


def pieces(n: int, width: int, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of symbols that together hold every window of ``width`` symbols once."""
    at = 0
    while n - at >= width:
        end = min(n, at + size + width - 1)
        yield at, end
        at = end - width + 1


def winnowed_runs(codes: np.ndarray, owner_of: np.ndarray, gram: int, width: int):
    """Cut the windows of ``width`` symbols into runs that share an anchor.

    The anchor of a window is its smallest gram of ``gram`` symbols, the rightmost of equal ones, so equal windows have
    equal anchors. ``owner_of`` names the text of each symbol; windows over two texts are left out. Returns arrays:
    anchor hash, hash of the run's whole stretch, first window, number of windows.
    """
    n = len(codes)
    assert n < 1 << 22
    empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < width:
        return empty
    grams_prefix = prefix(codes, GRAM_BASE)
    at = np.arange(n - gram + 1)
    grams = stretch_hash(grams_prefix, GRAM_BASE, at, at + gram)
    # The low bits hold the place, counted down, so that the smallest value is the rightmost smallest gram.
    low = np.uint64((1 << 22) - 1)
    span, best, reach = width - gram + 1, (grams & ~low) | (low - at.astype(np.uint64)), 1
    while reach < span:
        step = min(reach, span - reach)
        best = np.minimum(best[:-step], best[step:])
        reach += step
    best = (low - (best & low)).astype(np.int64)
    first = np.arange(len(best))
    valid = owner_of[first] == owner_of[first + width - 1]
    change = np.ones(len(best) + 1, bool)
    change[1:-1] = (best[1:] != best[:-1]) | (owner_of[1:len(best)] != owner_of[:len(best) - 1]) \
        | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = valid[starts]
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return empty
    whole = stretch_hash(prefix(codes, RUN_BASE), RUN_BASE, starts, ends + width - 1)
    return grams[best[starts]], mix(whole + (ends - starts).astype(np.uint64)), starts, ends - starts


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(max(0, len(codes) - width + 1))
    return stretch_hash(prefix(codes, RUN_BASE), RUN_BASE, at, at + width)
