"""Byte-exact substring dedup by a common-prefix-aware distributed merge sort of suffixes.

A stretch of ``length`` bytes is represented by one of its suffixes, the anchor: of its first
``reach`` + 1 positions the one whose next ``length`` - ``reach`` bytes hash least. Equal stretches
have their anchors at equal places, so only about one suffix in ten has to be sorted.

1. Each chunk of documents sends the hashes of its suffixes' beginnings to ranges of the hash space,
   which answer for each whether documents of more than one id have it. A beginning that one document
   alone has distinguishes its suffix, which goes no further.
2. A chunk sorts the remaining suffixes, each with the bytes before its anchor read backwards behind
   it, and sends every range one sorted run, front-coded: what a suffix shares with the one before it
   is a number. Equal suffixes of a chunk are one, under the smallest id.
3. A range merges its runs by a loser tree that keeps for each loser how much it shares with its
   winner. Two suffixes that share unequally much with the last one out are told apart by these
   numbers; only equal numbers make it read on, from there. The prefixes shared by neighbours in the
   merged order (and in that of the bytes before) number the stretches; a stretch whose document is
   not the smallest that has it is marked, and the marks go back.

Hashes only choose what to compare: results come from bytes and are exact.

Edge cases: a null or empty text has no bytes and an empty kept text; a text shorter than ``length``
is kept whole; rows that share an id are parts of one document, so none of them makes another lose
bytes; a null id counts as larger than all others; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid, kernels

_U = np.uint64
#: Bytes whose suffixes are hashed in one pass.
PASS_BYTES = 1 << 18
#: Suffixes copied at once.
BLOCK = 1 << 13
_LAST_ID = np.iinfo(np.int64).max
_OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"


@dataclass
class Chunk:
    """Documents of a chunk in an order of their own, and their anchors."""

    places: list[int]  # rows of the table, in that order
    texts: list[bytes]
    ids: np.ndarray
    raw: np.ndarray  # all bytes, and zeros behind them
    edges: np.ndarray  # where each document begins, and the end of the last
    at: np.ndarray  # anchors: position in raw,
    doc: np.ndarray  # document,
    low: np.ndarray  # and the stretches they stand for: those that begin ``low`` to ``high`` bytes before
    high: np.ndarray
    hashes: np.ndarray


def _beginnings(raw: np.ndarray, count: int, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each of the first ``count`` positions."""
    lanes = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    found = np.full(count, size, _U)
    for k in range(0, size, 8):
        lane = lanes[k : k + count]
        if size - k < 8:
            lane = lane & _U((1 << 8 * (size - k)) - 1)
        found = (found ^ lane) * _U(0x9E3779B97F4A7C15)
        found ^= found >> _U(32)
    return kernels.mix64(found)


def _anchors(raw: np.ndarray, edges: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """Position, document, least and largest distance of a stretch's begin, and hash, of each anchor
    of the documents at ``edges``; ``raw`` has 8 bytes more."""
    starts = int(edges[-1]) - length + 1
    if starts <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, _U),)
    hashes = _beginnings(raw, starts + reach, length - reach)
    # the upper half of the hash, and on ties the smaller position
    least, span = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=_U), 1
    while 2 * span <= reach + 1:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span <= reach:
        least = np.minimum(least[: len(least) - (reach + 1 - span)], least[reach + 1 - span :])
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[:starts]
    start = np.flatnonzero(np.arange(starts) + length <= edges[doc + 1])
    at = (least[start] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(new[1:], len(at)) - 1
    return at[new], doc[start[new]], at[last] - start[last], at[new] - start[new], hashes[at[new]]


def read_chunk(table: pa.Table, length: int, reach: int) -> Chunk:
    ids, texts = table["doc_id"].to_pylist(), kernels.binary_list(table["text"])
    places = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    texts = [texts[i] for i in places]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw = np.frombuffer(b"".join(texts) + bytes(8 + length), np.uint8)
    parts, a = [], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + PASS_BYTES, "right")) - 1)
        at, doc, low, high, hashes = _anchors(raw[edges[a] : edges[b] + 8], edges[a : b + 1] - edges[a], length, reach)
        parts.append((at + edges[a], doc + a, low, high, hashes))
        a = b
    at, doc, low, high, hashes = (np.concatenate(x) for x in zip(*parts)) if parts else _anchors(raw, edges, length, reach)
    numbers = np.array([_LAST_ID if ids[i] is None else ids[i] for i in places], np.int64)
    # anchors have small hashes: mixed again, they spread over all ranges
    hashes = kernels.mix64(hashes + _U(0x9E3779B97F4A7C15)) & ~_U(0xFFFF)
    return Chunk(places, texts, numbers, raw, edges, at.astype(np.int32), doc.astype(np.int32), low.astype(np.uint8), high.astype(np.uint8), hashes)


def _begun(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, whether documents of two ids have each here, and which each anchor has."""
    order = np.argsort(chunk.hashes, kind="stable")
    hashes = chunk.hashes[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1]]))
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    ids = chunk.ids[chunk.doc[order]]
    several = np.minimum.reduceat(ids, new) != np.maximum.reduceat(ids, new) if len(new) else np.zeros(0, bool)
    return hashes[new], several, which


def _words(keys: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of integers that sort as the rows do."""
    wide = np.zeros((len(keys), -(-keys.shape[1] // 8) * 8), np.uint8)
    wide[:, : keys.shape[1]] = keys
    return list(wide.view(">u8").astype(_U).T)


def _shared(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it; 0 for the first."""
    differ = np.ones((max(0, len(rows) - 1), rows.shape[1] + 1), bool)
    np.not_equal(rows[1:], rows[:-1], out=differ[:, :-1])
    return np.concatenate([np.zeros(min(1, len(rows)), np.int64), differ.argmax(axis=1)])


@dataclass
class Runs:
    """The suffixes of a chunk that may repeat elsewhere, in sorted runs by range of their hash."""

    parts: np.ndarray
    edges: np.ndarray  # of each part's run
    keys: np.ndarray  # distinct suffixes, each with the bytes before it, and ``low`` and ``high``
    ids: np.ndarray  # the smallest id that has each
    which: np.ndarray  # of the anchors in ``own``
    own: np.ndarray


def sorted_runs(chunk: Chunk, open_: np.ndarray, parts: int, length: int, reach: int) -> Runs:
    """Runs of the anchors ``open_``. Bytes that none of an anchor's stretches holds are zeros."""
    at, low, high = chunk.at[open_].astype(np.int64), chunk.low[open_].astype(np.int64), chunk.high[open_].astype(np.int64)
    ahead, behind = np.arange(length), np.arange(reach)
    keys = np.empty((len(at), length + reach + 2), np.uint8)
    for k in range(0, len(at), BLOCK):
        own = slice(k, k + BLOCK)
        np.multiply(chunk.raw[at[own, None] + ahead], ahead < (length - low)[own, None], out=keys[own, :length])
        np.multiply(chunk.raw[np.maximum(at[own, None] - 1 - behind, 0)], behind < high[own, None], out=keys[own, length:-2])
    keys[:, -2], keys[:, -1] = low, high
    part = (chunk.hashes[open_] // _U(-(-(1 << 64) // parts))).astype(np.int64) if parts > 1 else np.zeros(len(at), np.int64)
    order = np.lexsort([*_words(keys)[::-1], part])
    keys, part = keys[order], part[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]).any(axis=1)]))
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    ids = chunk.ids[chunk.doc[open_[order]]]
    keys, part = keys[new], part[new]
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, np.int64)
    return Runs(part[edges[:-1]], edges, keys, np.minimum.reduceat(ids, new) if len(new) else ids, which, open_)


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """What each row shares with the one before it, and the bytes that it does not."""
    shared = _shared(rows)
    return shared.astype(np.uint8).tobytes(), zstandard.compress(rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes(), 1)


def front_decode(shared: bytes, rest: bytes, width: int) -> np.ndarray:
    lcp = np.frombuffer(shared, np.uint8)
    rows = np.zeros((len(lcp), width), np.uint8)
    rows[np.arange(width) >= lcp[:, None]] = np.frombuffer(zstandard.decompress(rest), np.uint8)
    line = np.arange(len(lcp))
    for k in range(width):  # a byte stays from the last row that named it
        rows[:, k] = rows[np.maximum.accumulate(np.where(lcp <= k, line, 0)), k]
    return rows


def _keys(run: bytes, width: int) -> Iterator[bytes]:
    return (run[k : k + width] for k in range(0, len(run), width))


def merge(runs: list[tuple[Iterable[bytes], Iterable[int]]]) -> Iterator[tuple[int, int]]:
    """The run of each next key in the merged order, and what the key shares with the one before.

    ``runs`` are sorted keys of one width and what each shares with its predecessor. A node of the
    tree holds the run that lost there; its ``shared`` counts the bytes it has in common with the
    winner that passed, so of two runs that meet again the one that shares more with the last key
    comes first, and no byte below the smaller count is read again.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    keys, counts = [iter(k) for k, _ in runs], [iter(c) for _, c in runs]
    head: list[bytes | None] = [next(k, None) for k in keys] + [None] * (size - len(runs))
    shared = [next(c, 0) for c in counts] + [0] * (size - len(runs))
    winners, loser = [0] * size + list(range(size)), [0] * size
    for node in range(size - 1, 0, -1):
        x, y = winners[2 * node], winners[2 * node + 1]
        winners[node] = _first(head, shared, x, y)
        loser[node] = x + y - winners[node]
    x = winners[1]
    while head[x] is not None:
        yield x, shared[x]
        a, p = next(keys[x], None), next(counts[x], 0)
        node = (size + x) >> 1
        while node:  # ``_first`` written out, for this is all the work there is
            y = loser[node]
            b = head[y]
            if b is not None:
                q = shared[y]
                if a is None or p < q:
                    beaten = True
                elif p > q:
                    beaten = False
                else:
                    rest, other = a[p:], b[p:]
                    beaten = other < rest
                    known = p + len(rest) - ((int.from_bytes(rest) ^ int.from_bytes(other)).bit_length() + 7) // 8
                    if beaten:
                        p = known
                    else:
                        shared[y] = known
                if beaten:
                    head[x], shared[x], loser[node] = a, p, x
                    x, a, p = y, b, q
            node >>= 1
        head[x], shared[x] = a, p


def _first(head: list[bytes | None], shared: list[int], x: int, y: int) -> int:
    """Which of two runs has the smaller head; the other's count becomes what it shares with it."""
    a, b = head[x], head[y]
    if a is None or b is None:
        return y if a is None else x
    p, q = shared[x], shared[y]
    if p != q:
        return x if p > q else y
    a, b = a[p:], b[p:]
    differ = (int.from_bytes(a) ^ int.from_bytes(b)).bit_length()
    won, lost = (x, y) if a <= b else (y, x)
    shared[lost] = p + len(a) - (differ + 7) // 8
    return won


def smaller_elsewhere(keys: np.ndarray, shared: np.ndarray, ids: np.ndarray, length: int, reach: int) -> np.ndarray:
    """For suffixes in merged order, a bit for each distance: the stretch that begins so far before
    the anchor is one of theirs and also one of a document with a smaller id."""
    n, low, high = len(keys), keys[:, -2], keys[:, -1]
    before = keys[:, length:-2]
    order = np.lexsort(_words(before)[::-1]) if reach else np.arange(n)
    alike = _shared(before[order])
    marks, rank = np.zeros(n, np.uint32), np.empty(n, np.int64)
    for distance in range(reach + 1):
        own = np.flatnonzero((low <= distance) & (distance <= high))
        rank[order] = np.cumsum(alike < distance)
        stretch = (np.cumsum(shared < length - distance) * (n + 1) + rank)[own]
        by = np.argsort(stretch, kind="stable")
        new = np.flatnonzero(np.diff(stretch[by], prepend=-1))
        if len(new):
            who = ids[own[by]]
            least = np.repeat(np.minimum.reduceat(who, new), np.diff(np.append(new, len(who))))
            marks[own[by[who > least]]] |= np.uint32(1 << distance)
    return marks


def duplicated_spans(docs: DataFrame, length: int = 50, chunk_bytes: int = grid.CHUNK_BYTES, range_bytes: int = grid.CHUNK_BYTES) -> DataFrame:
    """One row per input row: its UTF-8 bytes, the maximal byte spans [start, end) covered by
    stretches of ``length`` bytes that also start in a document with a smaller id, and the bytes that
    are left (which may cut a character).

    ``chunk_bytes`` and ``range_bytes`` are the texts' bytes for each chunk and each range of the
    sort; a task holds a chunk, or the suffixes of a range that may repeat, some 20 bytes for each
    byte of text at most.
    """
    if not 2 <= length <= 200:
        raise ValueError("length must be from 2 to 200 bytes")
    reach = min(18, length // 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = grid.text_bytes(rows)
    chunks, ranges = grid.chunk_count(size, chunk_bytes), grid.chunk_count(size, range_bytes)
    chunked = grid.dealt(rows, chunks)

    def begin(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, several, _ = _begun(read_chunk(table, length, reach))
        parts, edges = kernels.part_runs(hashes, ranges)
        cut = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({
            "part": pa.array(parts, pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()),
            "hashes": pa.array([kernels.to_planes(hashes[c] >> _U(16)) for c in cut], pa.binary()),
            "several": pa.array([np.packbits(several[c]).tobytes() for c in cut], pa.binary()),
        })

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blobs = [kernels.from_planes(x, _U) for x in table["hashes"].to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(b)] for x, b in zip(table["several"].to_pylist(), blobs)]).astype(bool)
        every = np.concatenate(blobs)
        order = np.argsort(every, kind="stable")
        hit, same = several[order], every[order[1:]] == every[order[:-1]]
        hit[1:] |= same
        hit[:-1] |= same
        answer = np.empty(len(every), bool)
        answer[order] = hit
        ends = np.cumsum([len(b) for b in blobs])
        return pa.table({
            "chunk": table["chunk"],
            "part": pa.array([key[0].as_py()] * len(blobs), pa.int32()),
            "size": pa.array([len(b) for b in blobs], pa.int32()),
            "bits": pa.array([np.packbits(answer[e - len(b) : e]).tobytes() for b, e in zip(blobs, ends)], pa.binary()),
        })

    def still_open(chunk: Chunk, answers: list[tuple[int, int, bytes]]) -> np.ndarray:
        bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for _, n, b in sorted(answers)] or [np.zeros(0, np.uint8)]).astype(bool)
        hashes, _, which = _begun(chunk)
        assert len(bits) == len(hashes), "a chunk changed between its readings"
        return np.flatnonzero(bits[which])

    def send(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = read_chunk(left, length, reach)
        answers = list(zip(right["part"].to_pylist(), right["size"].to_pylist(), right["bits"].to_pylist()))
        runs = sorted_runs(chunk, still_open(chunk, answers), ranges, length, reach)
        cut = [slice(a, b) for a, b in zip(runs.edges[:-1], runs.edges[1:])]
        coded = [front_code(runs.keys[c]) for c in cut]
        return pa.table({
            "part": pa.array(runs.parts, pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(cut), pa.int32()),
            "shared": pa.array([a for a, _ in coded], pa.binary()),
            "rest": pa.array([b for _, b in coded], pa.binary()),
            "ids": pa.array([kernels.to_planes(runs.ids[c]) for c in cut], pa.binary()),
        })

    def sort(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        width = length + reach + 2
        runs = [front_decode(a, b, width) for a, b in zip(table["shared"].to_pylist(), table["rest"].to_pylist())]
        edges = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        one_by_one = [(_keys(r.tobytes(), width), c) for r, c in zip(runs, table["shared"].to_pylist())]
        out = np.fromiter(merge(one_by_one), np.dtype((np.int32, 2)), int(edges[-1]))
        by_run = np.argsort(out[:, 0], kind="stable")  # a run's keys come out in its own order
        keys, ids = np.concatenate(runs), np.concatenate([kernels.from_planes(x, np.int64) for x in table["ids"].to_pylist()])
        order = np.empty(len(by_run), np.int64)
        order[by_run] = np.arange(len(by_run))
        marks = np.empty(len(order), np.uint32)
        marks[order] = smaller_elsewhere(keys[order], out[:, 1], ids[order], length, reach)
        return pa.table({
            "chunk": table["chunk"],
            "part": pa.array([key[0].as_py()] * len(runs), pa.int32()),
            "size": pa.array([-len(r) for r in runs], pa.int32()),
            "bits": pa.array([zstandard.compress(kernels.to_planes(marks[a:b]), 1) for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
        })

    def remove(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = read_chunk(left, length, reach)
        answers = list(zip(right["part"].to_pylist(), right["size"].to_pylist(), right["bits"].to_pylist()))
        runs = sorted_runs(chunk, still_open(chunk, [a for a in answers if a[1] > 0]), ranges, length, reach)
        blobs = [kernels.from_planes(zstandard.decompress(b), np.uint32) for _, n, b in sorted(answers) if n < 0]
        marks = np.concatenate(blobs or [np.zeros(0, np.uint32)])
        assert len(marks) == len(runs.keys), "a chunk changed between its readings"
        at, own = chunk.at[runs.own].astype(np.int64), runs.own
        # another document of the chunk has the same suffix and a smaller id: all its stretches go
        later = chunk.ids[chunk.doc[own]] > runs.ids[runs.which]
        steps = np.zeros(len(chunk.raw) + 1, np.int16)
        for distance in range(reach + 1):
            whole = later & (chunk.low[own] <= distance) & (distance <= chunk.high[own])
            start = at[whole | ((marks[runs.which] >> np.uint32(distance)) & np.uint32(1)).astype(bool)] - distance
            steps[start] += 1  # a stretch has one anchor, so starts differ
            steps[start + length] -= 1
        gone = np.cumsum(steps, dtype=np.int16) > 0  # at most ``length`` stretches hold a byte
        spans, kept, removed = [], [], []
        for text, a, b in zip(chunk.texts, chunk.edges[:-1], chunk.edges[1:]):
            own_gone = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own_gone.view(np.int8), [0]])))
            spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
            kept.append(chunk.raw[a:b][~own_gone].tobytes() if len(edge) else text)
            removed.append(len(text) - len(kept[-1]))
        return pa.table({
            "doc_id": left["doc_id"].take(chunk.places),
            "n_bytes": pa.array([len(t) for t in chunk.texts], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "kept": pa.array(kept, pa.binary()),
        })

    told = "chunk int, part int, size int, bits binary"
    begun = chunked.groupBy("chunk").applyInArrow(kernels.grouped(begin), "part int, chunk int, hashes binary, several binary")
    met = begun.groupBy("part").applyInArrow(kernels.grouped(meet), told)
    sent = chunked.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(kernels.cogrouped(send), "part int, chunk int, shared binary, rest binary, ids binary")
    marked = sent.groupBy("part").applyInArrow(kernels.grouped(sort), told)
    return chunked.groupBy("chunk").cogroup(met.union(marked).groupBy("chunk")).applyInArrow(kernels.cogrouped(remove), _OUT)
