"""Periodic runs of words by Main-Lorentz divide and conquer.

The words of a batch of texts are interned to integers and laid end to end, with a number of its own
between two texts, so that no run crosses an edge. The array is halved again and again; at each level
all segments are looked at together. A run that crosses a segment's midpoint has at least two periods
on one side of it, so a Z-function from the midpoint (to the right, and on the reversed array to the
left) reaches at least one period. The first words of a period are compared for all segments in a few
numpy passes; the Z-function then visits only places where those agree. A stretch is extended past
the midpoint; where it goes on beyond its segment, the segment that holds it whole has it. Stretches
over the same words are one run, and its period is the smallest.

Once the stretch of one period q covers [m, m + 2q') for a later candidate q', both are periods of
those words, so is their greatest common divisor (Fine and Wilf), and the stretch of q' is one already
found. Only the few primitive squares at a midpoint are therefore extended, and the work on any text
is proportional to n log n, whatever repeats.

Edge cases: a null or empty text, or one of white space alone, has no words, no runs and an empty
collapsed text; rows that repeat, and rows without an id, each get a row; an empty table gives an
empty result; other columns of the input are ignored. A text is held by one task, as all its words
may be one run.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Words handled in one pass; a longer text makes a pass of its own.
PASS_WORDS = 1 << 18
#: Words of a period that are compared for all segments at once.
FIRST = 8

_OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def intern(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each text followed by a number that occurs nowhere else, filled up
    with such numbers to a power of two; and where each text begins."""
    numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    ids = np.empty(1 << max(3, int(first[-1] - 1).bit_length()), np.int32)
    for at, words in zip(first, texts):
        ids[at : at + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    alone = np.concatenate([first[1:] - 1, np.arange(first[-1], len(ids))])
    ids[alone] = len(numbers) + np.arange(len(alone))
    return ids, first[:-1]


def _common(w: np.ndarray, i: int, j: int, stop: int) -> int:
    """Length of the longest common prefix of w[i:] and w[j:stop], i < j."""
    n, size = 0, 16
    while n < stop - j:
        size = min(size, stop - j - n)
        differ = w[i + n : i + n + size] != w[j + n : j + n + size]
        at = int(differ.argmax())
        if differ[at]:
            return n + at
        n, size = n + size, 4 * size
    return n


def _candidates(w: np.ndarray, size: int, power: int) -> Iterator[tuple[int, list[int]]]:
    """For the segments of ``size``, each midpoint and the periods whose first words repeat there."""
    half, most = size // 2, size // power
    table = w.reshape(-1, size)
    row, q = np.nonzero(table[:, half + 1 : half + 1 + most] == table[:, half : half + 1])
    middle, q = row * size + half, q + 1
    for k in range(1, FIRST):
        at = middle + np.minimum(k, q - 1)
        held = w[at] == w[at + q]
        middle, q = middle[held], q[held]
    edges = np.flatnonzero(np.diff(middle, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(middle[a]), q[a:b].tolist()


def _stretches(w: np.ndarray, back: np.ndarray, size: int, power: int) -> Iterator[tuple[int, int, int]]:
    """(start, stop, period) of maximal stretches inside segments that repeat right of a midpoint."""
    for m, periods in _candidates(w, size, power):
        begin, stop = m - size // 2, m + size // 2
        z: dict[int, int] = {}
        left = right = reach = 0  # offsets from m; w[m + left : m + right] equals the words from m on
        for q in periods:
            k = 0
            if q < right and (known := z.get(q - left)) is not None:
                k = min(known, right - q)
            if not 0 < k < right - q:
                k += _common(w, m + k, m + q + k, stop)
            z[q] = k
            if q + k > right:
                left, right = q, q + k
            if k < q or 2 * q <= reach:
                continue
            reach = q + k
            start = m - _common(back, len(w) - m - q, len(w) - m, len(w) - begin)
            yield start, m + q + k, q


def find_runs(ids: np.ndarray, least: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of at least ``least`` words and ``power``
    periods, by start and period. ``ids`` has a power of two of entries; ``power`` is at least 4."""
    if power < 4 or least < 2:
        raise ValueError("runs must have at least four periods and two words")
    n, found = len(ids), {}
    reverse = np.ascontiguousarray(ids[::-1])
    size = max(1 << (least - 1).bit_length(), 4)
    while size <= n:
        for mirrored, (w, back) in enumerate(((ids, reverse), (reverse, ids))):
            for start, stop, q in _stretches(w, back, size, power):
                if mirrored:
                    start, stop = n - stop, n - start
                whole = (start == 0 or ids[start - 1] != ids[start - 1 + q]) and (stop == n or ids[stop] != ids[stop - q])
                if whole and stop - start >= max(least, power * q):
                    found[start, stop] = min(q, found.get((start, stop), q))
        size *= 2
    return sorted((start, stop - start, q) for (start, stop), q in found.items())


def _passes(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    group: list[list[bytes]] = []
    size = 0
    for words in texts:
        if group and size + len(words) + 1 > PASS_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words) + 1
    if group:
        yield group


def periodic_runs(docs: DataFrame, least: int = 6, power: int = 4) -> DataFrame:
    """One row a text: its words, its maximal runs by start and period, and the text in which each
    run keeps its first period alone, words joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            # bytes.split() parts words at just the six characters that are white space here
            for texts in _passes(t.split() for t in kernels.binary_list(batch.column(1))):
                ids, first = intern(texts)
                runs: list[list[dict[str, int]]] = [[] for _ in texts]
                dropped: list[list[tuple[int, int]]] = [[] for _ in texts]
                found = find_runs(ids, least, power)
                own = np.searchsorted(first, [start for start, _, _ in found], "right") - 1
                for d, (start, length, q) in zip(own.tolist(), found):
                    start -= int(first[d])
                    runs[d].append({"start": start, "length": length, "period": q})
                    dropped[d].append((start + q, start + length))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(at, len(texts)),
                    "n_words": pa.array([len(t) for t in texts], pa.int64()),
                    "runs": pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                    "collapsed": pa.array([_without(t, spans) for t, spans in zip(texts, dropped)], pa.binary()).cast(pa.string()),
                })
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, _OUT)


def _without(words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, stop in sorted(spans):
        kept += words[at:start]
        at = max(at, stop)
    return b" ".join(kept + words[at:])
