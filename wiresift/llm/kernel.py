"""Vectorised text kernel that the Arrow stages share.

A batch of texts is one UTF-8 buffer.  Words are found with byte masks and
named by a polynomial hash from prefix sums, so no Python loop runs over
words or characters.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts of a batch are worked on in runs of about so many bytes, to bound memory and stay in the cache.
CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE_NAME = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z were lower-cased
WORDY = np.zeros(256, bool)
WORDY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: everything but the line feed
LINED = np.ones(256, bool)
LINED[10] = False

_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    if _powers.get("n", 0) < n:
        size = max(n, CHUNK_BYTES + (1 << 18))
        up, down = np.full(size, U64(_BASE)), np.full(size, U64(_INVERSE))
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


class Words(NamedTuple):
    """Words of several texts: `name` has a 64-bit hash of each, text i owns `name[cut[i]:cut[i + 1]]`."""

    name: np.ndarray
    cut: np.ndarray
    start: np.ndarray  # of each word in the buffer
    end: np.ndarray
    buffer: np.ndarray  # the texts' bytes
    text_cut: np.ndarray  # of each text in the buffer

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.cut) - 1), np.diff(self.cut))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    cut = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[cut[0] : cut[-1]], cut - cut[0]


def runs(cut: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes each; a longer text is a run of its own."""
    at, n = 0, len(cut) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + most, "right")) - 1)
        yield at, to
        at = to


def segments(raw: np.ndarray, cut: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of `kind` in texts `raw[cut[i]:cut[i + 1]]`."""
    inside = kind[raw]
    full = np.diff(cut) > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = cut[:-1][full], cut[1:][full] - 1  # a text's end ends a run
    first[heads], last[tails] = inside[heads], inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: np.ndarray, cut: np.ndarray, kind: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Words of texts `raw[cut[i]:cut[i + 1]]`: maximal runs of bytes of `kind`, cut where a text ends."""
    low = _LOWER[raw] if lower else raw
    start, end = segments(low, cut, kind)
    return Words(spans(_BYTE_NAME[low], start, end), np.searchsorted(start, cut), start, end, raw, cut)


def text_marks(raw: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A checksum of each text's bytes and length: tells apart texts that stand under one id."""
    ends = cut.tolist()
    return np.array([text_mark(raw[a:z]) for a, z in zip(ends[:-1], ends[1:])], np.int64)


def text_mark(data) -> int:
    return zlib.crc32(data) | min(len(data), 0x7FFFFFFF) << 32


def spans(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each value[start:end]."""
    n = len(value)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(value * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and which of them lie within one text."""
    n = len(w.name)
    if n < k:
        return np.zeros(n, U64), np.zeros(n, bool)
    h = np.zeros(n, U64)
    out = w.name[: n - k + 1].copy()
    for i in range(1, k):
        out *= U64(0x9FB21C651E98DF25)
        out += w.name[i : n - k + 1 + i]
    h[: n - k + 1] = mix(out + U64(k))
    left = np.repeat(w.cut[1:], np.diff(w.cut)) - np.arange(n)
    return h, left >= k


def rolling(name: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive names, for large k: from prefix sums, one step a position."""
    n = len(name)
    if n < k:
        return np.zeros(0, U64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(name * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + U64(k))


def sequence_hash(w: Words) -> np.ndarray:
    """One hash for each text's whole word sequence."""
    return spans(w.name, w.cut[:-1], w.cut[1:])


def distinct_by_text(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, sorted by text and then hash; `owner` is ascending."""
    if not len(h):
        return h, owner
    bounds = np.flatnonzero(np.diff(owner)) + 1
    out = h.copy()
    for a, b in zip(np.r_[0, bounds], np.r_[bounds, len(h)]):
        out[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], owner[fresh]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LongType."""
    return x.view(np.int64)


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    name = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None
    if trim is not None:
        trim(0)
