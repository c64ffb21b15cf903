"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles (A-Z lower-cased). Register i of its SetSketch is
``floor(1 - log_b(min h_i))`` over the set, ``h_i`` exponentially distributed hashes, cut to 0..q+1:
two sketches merge by the register-wise maximum and a register agrees with probability close to the
Jaccard similarity J. Bands of registers propose candidates: with 32 bands of 5, a pair at J = 0.8
shares a band with probability 1 - 3e-6. A candidate is dropped only if the joint maximum
likelihood of J, from the counts of greater, smaller and equal registers and both set sizes, lies
more than four standard deviations below the threshold; every link is confirmed on full sets.

Nothing emits all pairs of a group. Documents with one set collapse first. Then each document is
held against one leader (the smallest member of a bucket), again against the leaders of its other
buckets where the component still differs, and what then remains in more than one component is
settled exactly: buckets of at most ``small`` members pair by pair, larger ones in blocks of
``block`` members, where members outside the bucket's main component meet all others and a local
union-find skips pairs already joined.

Edge cases: null or empty text, or one without words, has an empty set and no links; fewer words
than a shingle form one shingle; rows that share an id are one document: they are in one component,
whatever their texts, and each row tells its own text's number of shingles; a null id is kept without
links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .components import components
from .storage import written

_U = np.uint64
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, LARGEST = 1.02, 4094
_rng = np.random.default_rng(20_11)
_MULTIPLY = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    found = kernels.words(texts, lower=True)
    counts, first = found.counts, found.first
    hashes, at = kernels.windows(found.hashes, first, n)
    edge = np.searchsorted(at, first)
    out = []
    for d in range(len(texts)):
        if counts[d] >= n:
            out.append(np.unique(hashes[edge[d] : edge[d + 1]]))
        elif counts[d]:
            own = found.hashes[first[d] : first[d + 1]]
            out.append(kernels.windows(own, np.array([0, len(own)]), len(own))[0])
        else:
            out.append(np.zeros(0, _U))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16), one row a set, none of which may be empty."""
    minima = np.empty((REGISTERS, len(sets)), np.uint32)
    begin = 0
    while begin < len(sets):  # passes that stay in cache
        end, size = begin, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[begin:end])
        x = (x >> _U(32)).astype(np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets[begin : end - 1]])]).astype(np.int64)
        for i in range(REGISTERS):
            minima[i, begin:end] = np.minimum.reduceat(x * _MULTIPLY[i] + _ADD[i], offsets)
        begin = end
    h = -np.log1p(-(minima.T.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def likeliest_similarity(equal, above, below, size_a, size_b) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of sketch pairs (arrays)."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def log_likelihood(j):
        over, under = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return above * np.log(over + tiny) + below * np.log(under + tiny) + equal * np.log(np.maximum(1 - over - under, tiny))

    golden = (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        right = log_likelihood(a) < log_likelihood(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    return (low + high) / 2


def _could_link(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    near = np.minimum(size, sizes) * 100 >= percent * np.maximum(size, sizes)
    at = np.flatnonzero(near)
    if len(at):
        above, below = (one > others[at]).sum(1), (one < others[at]).sum(1)
        j = likeliest_similarity(REGISTERS - above - below, above, below, np.full(len(at), float(size)), sizes[at].astype(float))
        t = percent / 100
        near[at] = j >= t - 4 * math.sqrt(t * (1 - t) / REGISTERS)
    return near


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _sketched(docs: DataFrame, n: int) -> DataFrame:
    def work(batches):
        import zstandard

        for batch in batches:
            ids, texts = batch.column(0), kernels.binary_list(batch.column(1))
            done = 0
            while done < len(texts) or done == 0:
                end, size = done, 0
                while end < len(texts) and (end == done or size + len(texts[end]) <= kernels.PASS_BYTES):
                    size += len(texts[end])
                    end += 1
                part = texts[done:end]
                sets = shingle_sets(part, n)
                full = [i for i, s in enumerate(sets) if len(s)]
                rows = sketch([sets[i] for i in full]) if full else []
                registers: list = [None] * len(part)
                for i, row in zip(full, rows):
                    registers[i] = row.tobytes()
                press = zstandard.ZstdCompressor(level=1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(done, end - done),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "k1": pa.array([int(np.sum(s).astype(np.int64)) for s in sets], pa.int64()),
                    "k2": pa.array([int(np.bitwise_xor.reduce(kernels.mix64(s)).astype(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                    "registers": pa.array(registers, pa.binary()),
                    "packed": pa.array([press.compress(t) if len(s) else None for t, s in zip(part, sets)], pa.binary()),
                })
                done = end
                if done >= len(texts):
                    break
            del texts, batch
            kernels.give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_shingles long, k1 long, k2 long, registers binary, packed binary")


class _Members:
    """The documents of one task, unpacked on demand."""

    def __init__(self, table: pa.Table, n: int):
        import zstandard

        self.ids, self.packed, self.n = table["doc_id"].to_pylist(), table["packed"].to_pylist(), n
        self.registers = np.array([np.frombuffer(x, np.uint16) for x in table["registers"].to_pylist()]).reshape(-1, REGISTERS)
        self.sizes = np.array(table["n_shingles"].to_pylist(), np.int64)
        self._sets: dict[int, np.ndarray] = {}
        self._unpack = zstandard.ZstdDecompressor().decompress

    def set(self, i: int) -> np.ndarray:
        if i not in self._sets:
            self._sets[i] = shingle_sets([self._unpack(self.packed[i])], self.n)[0]
        return self._sets[i]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges_table(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=_EDGE)


def _verified(pairs: DataFrame, nodes: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """The pairs (a, b) that are linked. A leader's partners are dealt to tasks of about ``block``."""
    per_leader = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("deals"))
    dealt = pairs.join(per_leader, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("deal"))
    own = [F.col(c).alias(c) for c in ("doc_id", "n_shingles", "registers", "packed")]
    leaders = dealt.select("a", "deal").distinct().join(nodes, F.col("a") == F.col("doc_id")).select(F.col("a").alias("lead"), F.col("deal").alias("deal"), *own)
    members = dealt.join(nodes, F.col("b") == F.col("doc_id")).select(F.col("a").alias("lead"), F.col("deal").alias("deal"), *own)

    def check(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        lead, rest, found = _Members(left, n), _Members(right, n), []
        for i in range(len(lead.ids)):
            for k in np.flatnonzero(_could_link(lead.registers[i], rest.registers, lead.sizes[i], rest.sizes, percent)):
                if _linked(lead.set(i), rest.set(k), percent):
                    found.append((rest.ids[k], lead.ids[i]))
        return _edges_table(found)

    return leaders.groupBy("lead", "deal").cogroup(members.groupBy("lead", "deal")).applyInArrow(check, "a long, b long")


def _blocks(members: DataFrame, nodes: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """Edges that join components inside large buckets. ``members``: key, doc_id, comp."""
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    rows = members.join(main, "key").withColumn("right", F.ceil(F.col("all") / block).cast("int")).withColumn("left", F.ceil((F.col("all") - F.col("most")) / block).cast("int"))
    spot = F.abs(F.xxhash64("doc_id", "key"))
    outer = rows.filter("comp <> main").select("key", "doc_id", "comp", F.lit(True).alias("outer"), (spot % F.col("left")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("right") - 1)).alias("j"))
    every = rows.select("key", "doc_id", "comp", F.lit(False).alias("outer"), F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("i"), (spot % F.col("right")).cast("int").alias("j"))

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        seen, comps, outer_flags = _Members(table, n), table["comp"].to_pylist(), table["outer"].to_pylist()
        parent = {c: c for c in comps}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        rest = np.array([k for k, o in enumerate(outer_flags) if not o], np.int64)
        found = []
        for i in (k for k, o in enumerate(outer_flags) if o):
            if not len(rest):
                break
            for k in rest[_could_link(seen.registers[i], seen.registers[rest], seen.sizes[i], seen.sizes[rest], percent)]:
                x, y = root(comps[i]), root(comps[k])
                if x != y and _linked(seen.set(i), seen.set(int(k)), percent):
                    parent[x] = y
                    found.append((seen.ids[i], seen.ids[int(k)]))
        return _edges_table(found)

    return outer.unionByName(every).join(nodes, "doc_id").groupBy("key", "i", "j").applyInArrow(settle, "a long, b long")


def _same_id(table: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges between the sets of rows that share an id but not a text."""
    pair = F.struct("k1", "k2")
    several = table.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(pair).alias("lo"), F.max(pair).alias("hi")).filter("lo <> hi")
    texts = table.filter("n_shingles > 0").join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct()
    held = texts.join(sets.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep")
    return held.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, small: int = 8, block: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept, for every row."""
    table = written(_sketched(docs, shingle).withColumn("row", F.monotonically_increasing_id()), "sketches")
    sets = table.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by("row", F.struct("doc_id", "row")).alias("row"))
    sets = written(sets, "sets")
    width = 2 * ROWS
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * width + 1, F.lit(width))))
    banded = table.join(sets.select("row"), "row", "left_semi").select("row", "doc_id", F.explode(key).alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).filter("n > 1")
    members = written(banded.join(buckets, "key"), "members")
    # texts travel on only for documents that share a bucket
    nodes = written(table.join(members.select("row").distinct(), "row", "left_semi").select("doc_id", "n_shingles", "registers", "packed"), "nodes")

    led = members.filter("doc_id <> leader")
    first = led.groupBy("doc_id", "leader").agg(F.count("*").alias("times")).groupBy("doc_id").agg(F.max_by("leader", F.struct("times", -F.col("leader"))).alias("a"))
    first = written(first.select("a", F.col("doc_id").alias("b")), "pairs")
    edges = written(_verified(first, nodes, shingle, percent, block).unionByName(_same_id(table, sets)), "links")

    def labelled(frame: DataFrame, ids: str, name: str, found: DataFrame) -> DataFrame:
        return frame.join(found.select(F.col("node").alias(ids), F.col("label").alias("_label")), ids, "left").withColumn(name, F.coalesce("_label", ids)).drop("_label")

    found = components(edges)
    second = labelled(labelled(led.select("doc_id", "leader").distinct(), "doc_id", "x", found), "leader", "y", found).filter("x <> y")
    second = second.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).join(first, ["a", "b"], "left_anti")
    second = written(second, "pairs")
    edges = written(edges.unionByName(_verified(second, nodes, shingle, percent, block)), "links")

    found = components(edges)
    state = labelled(members.select("key", "n", "doc_id"), "doc_id", "comp", found)
    split = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_ = written(state.join(split, "key", "left_semi"), "open")
    few = open_.filter(F.col("n") <= small)
    pairs = few.alias("p").join(few.alias("q"), "key").filter("p.doc_id < q.doc_id and p.comp <> q.comp").select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b")).distinct()
    pairs = written(pairs.join(first.unionByName(second), ["a", "b"], "left_anti"), "pairs")
    last = _verified(pairs, nodes, shingle, percent, block).unionByName(_blocks(open_.filter(F.col("n") > small).select("key", "doc_id", "comp"), nodes, shingle, percent, block))
    found = components(edges.unionByName(last))

    classes = labelled(sets.select("k1", "k2", "rep"), "rep", "component_id", found).drop("rep")
    out = table.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
