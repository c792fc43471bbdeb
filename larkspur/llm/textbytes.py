"""Vectorised work on the UTF-8 bytes of many texts at once.

A chunk is (buf, off): one uint8 buffer with all texts of a batch and the int64 offsets of each.
Words are maximal runs of bytes outside space and 0x09-0x0D; UTF-8 never uses those inside a
character. Hashes are 64 bits wide; where two different words or shingles may not be confused, callers say so.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_U = np.uint64
_rng = np.random.RandomState(20240917)
_TABLE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


_memos: list = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def memo(make):
    """make with its last two results kept in the worker, until lean() clears them."""
    _memos.append(lru_cache(2)(make))
    return _memos[-1]


def lean(run, keeps=None):
    """run, a function of batches, in a worker that has no memos but keeps and that gives memory back to the system before and after.

    A worker serves one operator after the other; without this it holds the most that each of them took.
    """

    def task(batches):
        _give_back(keeps)
        yield from run(batches)
        _give_back(keeps)

    return task


def _give_back(keeps) -> None:
    for made in _memos:
        if made is not keeps:
            made.cache_clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES):
    """Yields (first row, buf, off) over a string column; nulls are empty; no text is divided."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def lowered(buf: np.ndarray) -> np.ndarray:
    return buf | ((buf - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def _power(name: str, base, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, _U)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes; spans() turns them into hashes of spans."""
    out = np.zeros(len(buf) + 1, _U)
    np.cumsum(_TABLE[buf] * _power("up", _BASE, len(buf) + 1)[: len(buf)], out=out[1:])
    return out


def spans(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, a function of its bytes and length alone."""
    down = _power("down", _INV, len(pre) + 1)
    return mix((pre[ends] - pre[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each text and after the last."""
    solid = ~SPACE[buf]
    n = len(buf)
    begin, end = solid.copy(), solid.copy()
    if n:
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        begin[edge] = solid[edge]
        end[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def windows(hashes: np.ndarray, cuts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k words in a row inside one text, and the text's number."""
    n = len(hashes)
    texts = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = np.zeros(n - k + 1, _U)
    for i in range(k):
        out += mix(hashes[i : n - k + 1 + i] + _U(i * 0x632BE59BD9B4E019 % 2**64)) * _U(2 * i + 3)
    inside = texts[: n - k + 1] == texts[k - 1 :]
    return mix(out[inside]), texts[: n - k + 1][inside]


def continuation(buf: np.ndarray) -> np.ndarray:
    """Bytes that continue a character; the rest count code points."""
    return (buf & 0xC0) == 0x80


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set inside each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
