"""Exact substring dedup over fixed-length word windows.

Each chunk of documents hashes every window of ``window`` consecutive words (Rabin-Karp on prefix
sums, to two bases) and ships its distinct hashes to the parts of the hash space; a part counts them
over the corpus and answers with one bit a hash; the chunk merges repeated windows into maximal
intervals and removes those. Shuffled are the texts once, ten to twelve bytes a window, and one bit
back.

Two windows are one if both their hashes agree, 61 bits modulo a prime and 32 bits of an independent
second one: among the 1.5e13 windows of 100 TB, 0.01 false repeats are expected in all.

Edge cases: a null or empty text has no words, no windows and an empty kept text; a document of
fewer words than a window is kept whole; rows that repeat (same id and text) count as separate
documents, so their windows repeat; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid, kernels

_OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"


def _in_order(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Rows' places and texts in an order that does not depend on how the shuffle delivered them."""
    ids, texts = table["doc_id"].to_pylist(), kernels.binary_list(table["text"])
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return order, [texts[i] for i in order]


def _ranked(hashes: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash and second hash, and where each distinct pair begins in it."""
    order = np.argsort(hashes, kind="stable")
    for again in (False, True):
        h, s = hashes[order], seconds[order]
        tie, same = h[1:] == h[:-1], s[1:] == s[:-1]
        if again or not (tie & ~same).any():
            break
        order = np.lexsort((seconds, hashes))  # windows that only the second hash tells apart
    return order, np.concatenate([np.ones(min(1, len(h)), bool), ~(tie & same)])


def _chunk_windows(texts: list[bytes], window: int):
    """Words, where windows start, which distinct window each is, and those: hash, second hash, and
    whether it starts more than once here."""
    found = kernels.words(texts)
    hashes, at = kernels.windows(found.hashes, found.first, window)
    seconds = kernels.windows(found.hashes, found.first, window, base=1)[0].astype(np.uint32)
    order, new = _ranked(hashes, seconds)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    first = order[new]
    return found, at, where, hashes[first], seconds[first], np.bincount(where, minlength=len(first)) > 1


def repeated_windows(docs: DataFrame, window: int = 35, chunk_bytes: int = grid.CHUNK_BYTES, keep_spacing: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: word counts, the removed word intervals [start, end), and what is kept.

    ``kept_text`` joins kept words by one space; with ``keep_spacing`` it is the text itself with
    the removed intervals cut out, unchanged where nothing was removed. Columns named in ``carry``
    stay with their row.
    """
    if window < 1:
        raise ValueError("window must be at least one word")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    chunks = parts = grid.chunk_count(grid.text_bytes(rows), chunk_bytes)
    chunked = grid.dealt(rows, chunks)

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, texts = _in_order(table)
        *_, distinct, seconds, again = _chunk_windows(texts, window)
        full, edges = kernels.part_runs(distinct, parts)
        cut = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({
            "part": pa.array(full, pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(full), pa.int32()),
            "hashes": pa.array([kernels.to_planes(distinct[c]) for c in cut], pa.binary()),
            "seconds": pa.array([seconds[c].tobytes() for c in cut], pa.binary()),
            "again": pa.array([np.packbits(again[c]).tobytes() for c in cut], pa.binary()),
        })

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blobs = [kernels.from_planes(x, np.uint64) for x in table["hashes"].to_pylist()]
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(b)] for x, b in zip(table["again"].to_pylist(), blobs)]).astype(bool)
        every, seconds = np.concatenate(blobs), np.frombuffer(b"".join(table["seconds"].to_pylist()), np.uint32)
        order, new = _ranked(every, seconds)
        hit = again[order]
        hit[1:] |= ~new[1:]
        hit[:-1] |= ~new[1:]
        answer = np.empty(len(every), bool)
        answer[order] = hit
        ends = np.cumsum([len(b) for b in blobs])
        return pa.table({
            "chunk": table["chunk"],
            "part": pa.array([key[0].as_py()] * len(blobs), pa.int32()),
            "size": pa.array([len(b) for b in blobs], pa.int32()),
            "repeated": pa.array([np.packbits(answer[e - len(b) : e]).tobytes() for b, e in zip(blobs, ends)], pa.binary()),
        })

    def remove(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        places, texts = _in_order(left)
        found, at, where, distinct, *_ = _chunk_windows(texts, window)
        answers = sorted(zip(right["part"].to_pylist(), right["size"].to_pylist(), right["repeated"].to_pylist()))
        bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for _, n, b in answers] or [np.zeros(0, np.uint8)]).astype(bool)
        assert len(bits) == len(distinct), "a chunk changed between its two readings"
        starts, size = at[bits[where]], len(found.hashes) + 1
        steps = np.bincount(starts, minlength=size) - np.bincount(starts + window, minlength=size)
        gone = np.cumsum(steps[:-1]) > 0
        counts = found.counts
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[found.first[1:]] - total[found.first[:-1]]
        spans, kept = [], []
        for d, text in enumerate(texts):
            a, b = found.first[d], found.first[d + 1]
            if removed[d]:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
                runs = edge.reshape(-1, 2)
            else:
                runs = np.zeros((0, 2), np.int64)
            spans.append([{"start": int(s), "end": int(e)} for s, e in runs])
            kept.append(_kept(text, found, a, runs, keep_spacing))
        return pa.table({
            "doc_id": left["doc_id"].take(places),
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            **{c: left[c].take(places) for c in carry},
        })

    sent = chunked.groupBy("chunk").applyInArrow(kernels.grouped(send), "part int, chunk int, hashes binary, seconds binary, again binary")
    back = sent.groupBy("part").applyInArrow(kernels.grouped(count), "chunk int, part int, size int, repeated binary")
    return chunked.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(kernels.cogrouped(remove), ", ".join([_OUT, *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)]))


def _kept(text: bytes, found: kernels.Words, first: int, runs: np.ndarray, keep_spacing: bool) -> bytes:
    if not len(runs):
        return text if keep_spacing else b" ".join(text.split())
    base = int(found.start[first]) - (len(text) - len(text.lstrip(b" \t\n\r\x0b\f")))
    out, at = [], 0
    for s, e in runs:
        out.append(text[at : int(found.start[first + s]) - base])
        at = int(found.end[first + e - 1]) - base
    out.append(text[at:])
    if keep_spacing:
        return b"".join(out).strip(b" \t\n\r\x0b\f")
    return b" ".join(b" ".join(out).split())
