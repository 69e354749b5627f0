"""Texts of an Arrow batch as one byte array: words, their 64-bit hashes, and blocks of bounded size.

Everything here runs inside a task, on one batch, in NumPy. A word is a run of
bytes from a byte class; UTF-8 bytes from 0x80 belong to words, so no class cuts
a character. Hashes are of the bytes with A-Z lower-cased.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes looked at together; longer texts are cut between words.
STEP = 1 << 19
#: Bytes of texts that form one block.
BLOCK = 1 << 21

#: Words of more bytes than this are hashed by BLAKE2b.
LONG_WORD = 256

_BYTES = np.arange(256)
#: Words between ASCII white space.
BETWEEN_SPACES = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words of ASCII letters, digits and all characters beyond ASCII.
LETTERS_DIGITS = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _values() -> np.ndarray:
    values = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits; different values stay different."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def release() -> None:
    """Hands free memory back when a task ends; Spark keeps its Python processes for the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A task's function that hands back memory when it ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with one more offset for the end. Null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `size` bytes together, or one longer row."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, and for each text the number of its first word (one more for the end)."""
    found, lo, n = [], 0, len(data)
    while lo < n:
        hi = min(lo + STEP, n)
        while hi < n and kind[data[hi - 1]]:
            gaps = np.flatnonzero(~kind[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                hi = min(hi + STEP, n)
        found.append(_piece(data[lo:hi], at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo, kind, lo))
        lo = hi
    if found:
        start, end, h = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        start, end, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return start, end, h, np.searchsorted(start, at)


def _piece(data: np.ndarray, cuts: np.ndarray, kind: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    inside = kind[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    start, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    up, down = _powers(max(STEP, 1 << (n - 1).bit_length()))
    total = np.cumsum(_values()[data] * up[:n], dtype=np.uint64)
    h = total[last] - np.where(start > 0, total[start - 1], np.uint64(0))
    h = mix(h * down[start] ^ ((last - start).astype(np.uint64) << np.uint64(40)))
    # Modulo 2^64, words that are long and made for it collide.
    for i in np.flatnonzero(last - start >= LONG_WORD):
        lower = data[start[i] : last[i] + 1].tobytes().lower()  # of bytes, so A-Z only
        h[i] = int.from_bytes(hashlib.blake2b(lower, digest_size=8).digest(), "little")
    return start + base, last + 1 + base, h


def shingles(h: np.ndarray, lo: int, hi: int, n: int) -> np.ndarray:
    """Sorted distinct hashes of the `n` consecutive words in h[lo:hi]; fewer words, but not none, are one shingle."""
    size = hi - lo
    if size == 0:
        return np.zeros(0, np.uint64)
    width = min(n, size)
    total = np.full(size - width + 1, width, np.uint64)
    for i in range(width):
        total = mix(total * np.uint64(_BASE) + h[lo + i : hi - width + 1 + i])
    return np.unique(total)
