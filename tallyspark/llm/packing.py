"""Best-fit packing by a configuration linear program over the length histogram.

Texts longer than a sequence are cut into full pieces behind a first, shorter one; full pieces fill
sequences alone. The lengths of the others form a histogram of at most ``capacity`` bins, the only
thing the driver sees. A configuration is a multiset of lengths that fits one sequence. The covering
program (fewest configurations that hold the histogram) is solved by multiplicative weights. A length's
weight is its price; one knapsack dynamic program, bounded by what is left, gives the dearest filling
behind each leading length. A step takes a share of each, rounded up to whole sequences, and then the
weight of every length that fell behind the average progress rises and that of the others falls, by a
factor exponential in the difference. So the cover is whole from the start and holds every piece exactly
once. Prices at which no configuration is dearer than 1 bound all covers from below; ``Program`` states
the best such bound it met, and the gap.

Pieces are matched to places without a global sort: rows of each length are numbered in 256 or more
groups, dealt evenly, whose sizes give each group its first number, so a length that a third of the rows
share is split as well. A plan row says which numbers of a length go to which places.

Ids are those of the vocabulary file read by ``tokenizers``: where a text holds one of the file's
added tokens (``<|endoftext|>``), that is its one id and the text on each side is encoded by itself.

Edge cases: a null or empty text is the end token alone; repeated rows are pieces of their own
(their numbering is arbitrary among equals); an empty table gives an empty result; a piece longer
than a sequence does not exist; other columns are ignored.
"""

from __future__ import annotations

import binascii
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import text_bytes
from .monoid_bpe import encoder
from .storage import written

CAPACITY, END = 2048, 0
Config = tuple[tuple[int, int], ...]  # (length, how often), longest first


def best_configurations(prices: np.ndarray, stock: np.ndarray, capacity: int) -> list[Config]:
    """Knapsack bounded by ``stock``: behind each length over half the capacity (or, where there is
    none, each length) the filling of greatest price, and the best filling without a leader."""
    lengths = np.flatnonzero(prices > 0)
    fill, large = lengths[2 * lengths <= capacity], lengths[2 * lengths > capacity]
    items = []
    for s in fill.tolist():
        n, k = min(int(stock[s]), capacity // s), 1
        while n > 0:
            items.append((s, min(k, n)))
            n, k = n - k, 2 * k
    best, value = np.zeros(capacity + 1), np.empty(capacity + 1)
    took = np.zeros((len(items), capacity + 1), bool)
    for j, (s, k) in enumerate(items):
        with_it = value[s * k :]
        np.add(best[: capacity + 1 - s * k], prices[s] * k, out=with_it)
        np.greater(with_it, best[s * k :], out=took[j, s * k :])
        np.maximum(best[s * k :], with_it, out=best[s * k :])
    lead = large if len(large) else fill
    room = np.append(capacity - lead, capacity)
    found = [Counter({s: 1}) for s in lead.tolist()] + [Counter()]
    for j in range(len(items) - 1, -1, -1):
        s, k = items[j]
        hit = np.flatnonzero(took[j, room])
        room[hit] -= s * k
        for h in hit.tolist():
            found[h][s] += k
    return [tuple(sorted(c.items(), reverse=True)) for c in found if c and all(stock[s] >= k for s, k in c.items())]


@dataclass(frozen=True)
class Program:
    """A cover, how often each configuration is taken, and a dual price vector: ``prices`` by length, at
    which no configuration that the histogram allows costs more than 1, and what they make of it."""

    used: Counter
    prices: np.ndarray
    bound: float

    @property
    def sequences(self) -> int:
        return sum(self.used.values())

    @property
    def gap(self) -> float:
        return self.sequences / self.bound if self.bound else 1.0


def _dual(prices: np.ndarray, stock: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The prices scaled until no configuration costs more than 1, and their total over the histogram."""
    most = max(sum(prices[s] * k for s, k in c) for c in best_configurations(prices, stock, capacity))
    scaled = prices / (most * (1 + 1e-12))
    return float(scaled @ stock), scaled


def solve_configurations(histogram: dict[int, int], capacity: int = CAPACITY, share: float = 0.1, rate: float = 0.25) -> Program:
    """Configurations that together hold the histogram exactly. ``share``: of what stock allows of a
    configuration, the part that one step takes; ``rate``: how fast prices answer to progress, 0 for
    prices that stay."""
    stock, size = np.zeros(capacity + 1, np.int64), np.arange(capacity + 1, dtype=float)
    for length, n in histogram.items():
        stock[length] = n
    left, used, step = stock.copy(), Counter(), 0
    # long pieces begin dearer than their share of room, for what they leave is hard to fill
    weight = np.where(stock > 0, 2 * np.log(size + 1e-9), -np.inf)
    best = (float(size @ stock) / capacity, size / capacity)  # nothing fills a sequence beyond its room
    while left.any():
        there = left > 0
        prices = np.where(there, np.exp(weight - weight[there].max()), 0.0)
        before = left.copy()
        found = best_configurations(prices, left, capacity)
        for _, config in sorted(((sum(prices[s] * k for s, k in c), c) for c in found), reverse=True):
            n = math.ceil(min(int(left[s]) // k for s, k in config) * share)
            if n:
                used[config] += n
                for s, k in config:
                    left[s] -= n * k
        done = (before - left)[there] / before[there]
        weight[there] += rate * (float(size @ (before - left)) / float(size @ before) - done)
        if step in (1, 4, 16):
            best = max(best, _dual(np.where(stock > 0, np.exp(weight - weight[stock > 0].max()), 0.0), stock, capacity), key=lambda x: x[0])
        step += 1
    return Program(used, best[1], best[0])


def _plan_rows(used: Counter) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, first sequence, places a sequence, offset of the first place)."""
    number: Counter = Counter()
    sequence, rows = 0, []
    for config, n in sorted(used.items()):
        offset = 0
        for s, k in config:
            rows.append((s, number[s], number[s] + n * k, sequence, k, offset))
            number[s] += n * k
            offset += s * k
        sequence += n
    return rows


def encode_pieces(docs: DataFrame, vocabulary_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each text's ids and the end token."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder(vocabulary_path, pattern).encode, allowed_special="all")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for doc_id, text in zip(ids, texts):
                tokens = np.array([*encode(text.as_py() or ""), END], "<u4")
                head = len(tokens) % capacity or capacity
                edges = [0, *range(head, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    rows.append((doc_id, k, a, b - a, binascii.crc32(tokens[a:b].tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all texts with sequence_id and offset."""
    spark = docs.sparkSession
    deals = max(256, text_bytes(docs) >> 30)  # groups that the rows of one length are numbered in
    pieces = encode_pieces(docs, vocabulary_path, pattern, capacity).withColumn("deal", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(deals)).cast("int"))
    pieces = written(pieces, "pieces")
    groups = written(pieces.groupBy("length", "deal").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = _plan_rows(solve_configurations(histogram, capacity).used)

    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.withColumn("place", F.row_number().over(Window.partitionBy("length", "deal").orderBy("doc_id", "piece")) - 1)
    numbered = numbered.join(first, ["length", "deal"]).withColumn("number", F.col("first") + F.col("place"))

    by_length: dict[int, list[tuple]] = {}
    for s, *row in plan:
        by_length.setdefault(s, []).append(row)
    tables = {s: np.array(sorted(rows), np.int64) for s, rows in by_length.items()}
    shared = spark.sparkContext.broadcast(tables)  # a few rows for each of at most `capacity` lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                rows = shared.value[int(s)]
                row = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
                inside = number[at] - row[:, 0]
                sequence[at] = row[:, 2] + inside // row[:, 3]
                offset[at] = row[:, 4] + inside % row[:, 3] * s
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
