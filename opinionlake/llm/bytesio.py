"""Whole texts as bytes inside a task: blocks of bounded size, words and hashes.

An Arrow string column keeps all its texts in one buffer. The functions here
work on slices of that buffer with numpy, so that no Python string is made per
word. A block holds whole documents while they fit, and a long document is cut
into several blocks at separators; callers add up or join the pieces.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

# Fixed odd multipliers of the hash functions (any odd 64-bit numbers do).
BASE = np.uint64(0x9E6C63D0876A9A35)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
GRAM = np.uint64(0xD6E8FEB86659FD93)


class Block(NamedTuple):
    """Bytes of consecutive segments; segment i is data[starts[i]:ends[i]] and belongs to input row rows[i]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


@functools.cache
def _trim() -> Callable[[int], int]:
    """The C library's call that returns free pages, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def give_back() -> None:
    """Return memory that Arrow and numpy have freed to the machine."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(fn: Callable) -> Callable:
    """``fn`` for mapInArrow, or for applyInArrow of one or two tables, after which a worker keeps no freed memory.

    Spark uses its Python workers again, and their allocators hold on to what a task has freed: an executor's workers
    together would stay at the largest need that each of them has ever had.
    """
    if inspect.isgeneratorfunction(fn):

        def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from fn(given)
            give_back()

        return batches

    if len(inspect.signature(fn).parameters) == 2:

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            out = fn(left, right)
            give_back()
            return out

        return pair

    def group(rows: pa.Table) -> pa.Table:
        out = fn(rows)
        give_back()
        return out

    return group


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of an Arrow string array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _cut(data: np.ndarray, lo: int, hi: int, may_cut: Callable[[np.ndarray], np.ndarray] | None) -> int:
    """The last place in (lo, hi] before which a text may be cut, or the next one after hi."""
    if may_cut is None:
        return hi
    back = np.flatnonzero(may_cut(data[lo : hi + 1])[1:])
    if len(back):
        return lo + 1 + int(back[-1])
    at = hi + 1
    while at < len(data):
        # The bytes before a place may count, so some of them are shown too.
        ahead = np.flatnonzero(may_cut(data[at - 4 : at + BLOCK])[4:])
        if len(ahead):
            return at + int(ahead[0])
        at += BLOCK
    return len(data)


def at_white(data: np.ndarray) -> np.ndarray:
    return WHITE[data]


def blocks(col, may_cut: Callable[[np.ndarray], np.ndarray] | None = None, limit: int = BLOCK) -> Iterator[Block]:
    """The column in blocks of about ``limit`` bytes.

    A document longer than the limit is cut where ``may_cut`` (given bytes,
    which may be cut before) allows it; without one, exactly at multiples of
    the limit. Every input row appears, an empty one as an empty segment.
    """
    data, at = column_bytes(col)
    n = len(at) - 1
    i = 0
    while i < n:
        if at[i + 1] - at[i] > limit:
            lo, end = int(at[i]), int(at[i + 1])
            while lo < end:
                hi = end if end - lo <= limit else min(end, _cut(data[:end], lo, lo + limit, may_cut))
                yield Block(data[lo:hi], np.array([0]), np.array([hi - lo]), np.array([i]))
                lo = hi
            i += 1
            continue
        j = int(np.searchsorted(at, at[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield Block(data[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i], np.arange(i, j))
        i = j


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2^64."""
    if len(_powers.get("up", ())) < max(n, 1):
        size = max(n, BLOCK + 64)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of (byte + 1) * BASE^place, from which the hash of any range follows."""
    up, _ = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many ranges at once, equal for equal bytes."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


# Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = byte_table((0x20, 0x20), (0x09, 0x0D))


def word_bounds(block: Block, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, segment index) of the words between separators; a segment's end also ends a word."""
    inside = ~separator[block.data]
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[block.starts] = True
    first = first[:n]
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    last = np.ones(n, bool)
    if n:
        last[:-1] = ~inside[1:] | first[1:]
    ends = np.flatnonzero(inside & last) + 1
    segment = np.searchsorted(block.starts, starts, side="right") - 1
    # Of equal starts (empty segments) the last one holds the bytes.
    return starts, ends, segment


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = out * GRAM + words[i : i + n]
    return mix(out)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
