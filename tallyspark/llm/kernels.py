"""Vectorised text kernels that run inside Arrow batches.

A word is a maximal run of bytes other than space and 0x09-0x0D, so the kernels work on UTF-8 bytes
and never on Python word lists. A word's hash absorbs its bytes eight at a time through a mixing
bijection (very long words go through xxh3), which no pattern of letters cancels as it would in a
polynomial modulo 2**64. Hashes of runs of words are Rabin-Karp polynomials modulo the prime
2**61 - 1, read off prefix sums, so a batch costs a fixed number of numpy passes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash

_U = np.uint64
_MASK = (1 << 64) - 1
#: Bytes hashed in one pass; one longer document makes a pass of its own.
PASS_BYTES = 1 << 21
#: Runs of words hashed in one pass.
RUN = 1 << 15
#: Words of more bytes than this are hashed one by one.
LANE_BYTES = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

P61 = (1 << 61) - 1
_P61, _LOW31, _LOW30 = _U(P61), _U((1 << 31) - 1), _U((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Residues modulo 2**61 - 1 of any 64-bit integers."""
    x = (x & _P61) + (x >> _U(61))
    return np.where(x >= _P61, x - _P61, x)


def times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of residues: 31-bit halves keep every sum below 2**64."""
    a1, a0, b1, b0 = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _U(1)) + (middle >> _U(30)) + ((middle & _LOW30) << _U(31)) + a0 * b0)


class _Powers:
    """base**i and base**-i modulo 2**61 - 1, grown on demand by doubling."""

    def __init__(self, base: int):
        self.steps = (base, pow(base, -1, P61))
        self.tables = [np.ones(1, _U), np.ones(1, _U)]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for k, base in enumerate(self.steps):
            while len(self.tables[k]) < n:
                have = self.tables[k]
                self.tables[k] = np.concatenate([have, times61(have, np.full(len(have), pow(base, len(have), P61), _U))])
        return self.tables[0][:n], self.tables[1][:n]


_bases = (_Powers(0x12D5F2C9A8E6B347), _Powers(0x0B7F3C51D9E4862F))


@dataclass
class Words:
    """The words of some documents, in order."""

    first: np.ndarray  # index of each document's first word, and the total at the end
    start: np.ndarray  # byte offsets into the joined buffer
    end: np.ndarray
    hashes: np.ndarray
    buffer: bytes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _word_hashes(buffer: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    lanes = np.ndarray(len(buffer) + 1, "<u8", buffer + bytes(8), strides=(1,))
    found = mix64(size.astype(_U))
    left, at = np.flatnonzero(size <= LANE_BYTES), 0
    while len(left):
        rest = size[left] - at
        lane = lanes[start[left] + at]
        short = rest < 8
        lane = np.where(short, lane & ((_U(1) << (_U(8) * np.minimum(rest, 7).astype(_U))) - _U(1)), lane)
        found[left] = mix64((found[left] ^ lane) + _U(0x9E3779B97F4A7C15))
        at += 8
        left = left[rest > 8]
    for k in np.flatnonzero(size > LANE_BYTES):
        found[k] = xxhash.xxh3_64_intdigest(buffer[start[k] : end[k]])
    return found


def _words_of_pass(texts: list[bytes], lower: bool) -> Words:
    buffer = b" ".join(texts) + b" "
    raw = np.frombuffer(buffer, np.uint8)
    gap = SPACE[raw]
    before = np.empty_like(gap)
    before[0] = True
    before[1:] = gap[:-1]
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(gap & ~before)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    first = np.searchsorted(start, offsets)
    hashes = _word_hashes(_LOWER[raw].tobytes() if lower else buffer, start, end)
    return Words(first, start, end, hashes, buffer)


def words(texts: list[bytes], lower: bool = False) -> Words:
    """Words of UTF-8 texts; ``lower`` reads A-Z as a-z in the hashes."""
    passes, group, size = [], [], 0
    for text in texts:
        if group and size + len(text) > PASS_BYTES:
            passes.append(_words_of_pass(group, lower))
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group or not passes:
        passes.append(_words_of_pass(group, lower) if group else Words(np.zeros(1, np.int64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, _U), b""))
    if len(passes) == 1:
        return passes[0]
    word_shift = np.cumsum([0] + [p.first[-1] for p in passes])
    byte_shift = np.cumsum([0] + [len(p.buffer) for p in passes])
    return Words(
        np.concatenate([p.first[:-1] + word_shift[i] for i, p in enumerate(passes)] + [word_shift[-1:]]),
        np.concatenate([p.start + byte_shift[i] for i, p in enumerate(passes)]),
        np.concatenate([p.end + byte_shift[i] for i, p in enumerate(passes)]),
        np.concatenate([p.hashes for p in passes]),
        b"".join(p.buffer for p in passes),
    )


def windows(hashes: np.ndarray, first: np.ndarray, n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every run of ``n`` words inside one document, and where each starts.
    There are two bases, for two independent hashes."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    counts = np.diff(first)
    limit = np.repeat(first[1:], counts)[: total - n + 1]
    at = np.flatnonzero(np.arange(total - n + 1) + n <= limit)
    if n == 1:
        return mix64(_reduced(hashes)[at] + _U(n)), at
    out = np.empty(len(at), _U)
    for k in range(0, len(at), RUN):  # stretches that stay in cache, each with powers from 0
        spot = at[k : k + RUN]
        begin, end = int(spot[0]), int(spot[-1]) + n
        up, down = _bases[base].get(end - begin)
        terms = times61(_reduced(hashes[begin:end]), up)
        # prefix sums of 31-bit halves stay below 2**64 for 2**33 words
        high, low = (np.concatenate([[_U(0)], np.cumsum(half, dtype=_U)]) for half in (terms >> _U(31), terms & _LOW31))
        spot = spot - begin
        high, low = high[spot + n] - high[spot], low[spot + n] - low[spot]
        rolled = times61(_reduced(times61(_reduced(high), np.full(len(spot), 1 << 31, _U)) + _reduced(low)), down[spot])
        out[k : k + RUN] = mix64(rolled + _U(n))
    return out, at


def to_planes(values: np.ndarray) -> bytes:
    """Integers as byte planes: the slow planes of sorted hashes and small counts shrink to nothing
    in the shuffle's own compression."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def part_runs(sorted_hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts (equal ranges of the hash space) that sorted hashes fall into, and where the run
    of each begins, with the total at the end; parts without hashes are not named."""
    width = -(-(1 << 64) // parts)
    part = (sorted_hashes // _U(width)).astype(np.int64) if parts > 1 else np.zeros(len(sorted_hashes), np.int64)
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return part[begin], np.append(begin, len(part))


def binary_list(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is the empty text."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Hands memory that the process no longer uses to the system, where the C library can: a worker
    lives on between tasks, and what a large batch took would stay with it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def grouped(work: Callable) -> Callable:
    """A function of a key and its rows that gives back what it took."""

    def run(key, table):
        out = work(key, table)
        give_back()
        return out

    return run


def cogrouped(work: Callable) -> Callable:
    """The same of a key and the rows of both sides."""

    def run(key, left, right):
        out = work(key, left, right)
        give_back()
        return out

    return run
