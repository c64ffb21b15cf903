"""Nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are rotated by a random orthogonal matrix, after which the first d of D components of a
difference carry about d/D of its squared length. Each list of a k-means index (fitted on a bounded
sample; every vector is indexed) is stored in column blocks. A query scans its probed lists block by
block, nearest list first: after each block, a candidate whose partial distance is larger than the
current k-th distance allows, by a test that errs with a probability set by ``epsilon``, is
abandoned; those that reach the last block are measured again on the original vectors in double
precision.

There are 4 sqrt(N) lists, or as many as the sample can fit with 16 vectors each. How many of them a
query probes is learnt from the sample: enough to hold the share ``target`` of the sample's own
nearest neighbours. Lists lie in shards of up to ``block`` vectors, neighbours (by a second k-means,
of the centroids) together, and a list of more vectors takes several shards, so a list that a third
of all vectors share is just more shards. A shard meets the queries that probe one of its lists in
deals of about ``deal`` queries, each deal in one task, and the k best of each are ranked per query.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do those whose number of components is not the most common one (ties: the smaller), for between
numbers of components there is no distance; a query is never its own neighbour, though another row
with its vector is; equal distances go to the smaller id; fewer candidates than k give fewer rows; an
empty table gives an empty result; of rows that share an id the one with the least vector (component
by component) takes part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the sample that the index is fitted on, and of the queries that probes are learnt from.
SAMPLE, PROBED = 20_000, 200


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int, int]:
    """vec_id, v (array<double>) of the rows that take part, their number of components, and theirs."""
    v = F.col(vector_column).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter(good & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims, n = (sizes["d"], sizes["count"]) if sizes else (0, 0)
    rows = rows.filter(F.size("v") == dims)
    again = rows.groupBy("vec_id").count().filter("count > 1").select("vec_id")
    if again.limit(1).count():  # ids alone were shuffled until here
        least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
        rows = rows.join(again, "vec_id", "left_anti").unionByName(least)
        n = rows.count()
    return rows, dims, n


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means centroids of a sample; an emptied list restarts at a random row."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    if len(distinct) <= lists:
        return distinct
    centres = distinct[rng.choice(len(distinct), lists, replace=False)]
    for _ in range(rounds):
        near = nearest_lists(sample, centres, 1)[:, 0]
        for c in range(lists):
            own = sample[near == c]
            centres[c] = own.mean(0) if len(own) else distinct[rng.integers(len(distinct))]
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    d = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    if n == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def learn_probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float, queries: int = PROBED) -> int:
    """Lists to probe so that the share ``target`` of the sample's own k nearest lie in them."""
    own = nearest_lists(sample, centres, 1)[:, 0]
    ranks = []
    for q in range(min(queries, len(sample))):
        d = ((sample - sample[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        place = np.empty(len(centres), np.int64)
        place[nearest_lists(sample[q : q + 1], centres, len(centres))[0]] = np.arange(len(centres))
        ranks.append(place[own[near]])
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, np.int64)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1 if len(ranks) else len(centres)


def shards(sizes: dict[int, int], centres: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each list, and how many it takes."""
    first, taken = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
    top = nearest_lists(centres, fit_lists(centres, max(1, int(np.sqrt(len(centres))))), 1)[:, 0]
    shard, held = 0, 0
    for c in np.lexsort((np.arange(len(centres)), top)).tolist():
        n = sizes.get(c, 0)
        if held and held + n > block:
            shard, held = shard + 1, 0
        first[c], taken[c] = shard, max(1, -(-n // block))
        held += n
        if taken[c] > 1:
            shard, held = shard + int(taken[c]), 0
    return first, taken


def scan(own_id: int, original: np.ndarray, rotated: np.ndarray, order: np.ndarray, columns: list[np.ndarray], vectors: np.ndarray, ids: np.ndarray, k: int, epsilon: float) -> list[tuple[float, int]]:
    """The k nearest (distance, id) of the candidates in ``order``; ``columns`` hold rotated components
    by block."""
    dims = vectors.shape[1]
    best: list[tuple[float, int]] = []
    limit, at, chunk = np.inf, 0, 4 * k
    while at < len(order):  # a short chunk first, for a limit to test against
        left = order[at : at + chunk]
        left = left[ids[left] != own_id]
        at, chunk = at + chunk, len(order)
        partial, seen = np.zeros(len(left)), 0
        for block in columns:
            partial += ((block[left] - rotated[seen : seen + block.shape[1]]) ** 2).sum(1)
            seen += block.shape[1]
            if seen < dims and np.isfinite(limit):
                bound = limit**2 * seen / dims * (1 + epsilon / np.sqrt(seen)) ** 2
                alive = partial <= bound * (1 + 1e-9) + 1e-12
                left, partial = left[alive], partial[alive]
        if len(left):
            exact = np.sqrt(((vectors[left] - original) ** 2).sum(1))
            best = sorted([*best, *_least(exact, ids[left], k)])[:k]
        if len(best) == k:
            limit = best[-1][0]
    return best


def _least(distance: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    order = np.lexsort((ids, distance))[:k]
    return list(zip(distance[order].tolist(), ids[order].tolist()))


def _array(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", target: float = 0.965, block: int = 32_768, deal: int = 8192, column_block: int = 16, epsilon: float = 2.1, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance). ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    rows, dims, n = usable(vectors, id_column, vector_column)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = _array(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"], dims)
    centres = fit_lists(drawn, max(1, min(int(4 * np.sqrt(n)), len(drawn) // 16)))
    probes, turn = learn_probes(drawn, centres, k, target), rotation(dims)
    block = min(block, max(1024, n // 64))  # smaller shards where few would leave cores idle

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest_lists(_array(batch.column(1), dims), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=["vec_id", "v", "list"])

    indexed = rows.mapInArrow(assign, "vec_id long, v array<double>, list int")
    counted = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most sample / 16 rows
    first, taken = shards(counted, centres, block)
    asked = rows.filter(is_query)
    deals = -(-max(1, asked.count()) // deal)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest_lists(_array(batch.column(1), dims), centres, probes)
                asked_of = [np.unique(np.concatenate([np.arange(first[c], first[c] + taken[c]) for c in own])).tolist() for own in near]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(asked_of, pa.list_(pa.int32()))], names=["vec_id", "v", "shards"])

    # arrays of at most sample / 16 numbers
    spread = F.pmod(F.xxhash64("vec_id", "v"), F.lit(taken.tolist())[F.col("list")])
    held = indexed.select((F.lit(first.tolist())[F.col("list")] + spread).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "list", "vec_id", "v")
    asked = asked.mapInArrow(probe, "vec_id long, v array<double>, shards array<int>")
    asked = asked.select(F.explode("shards").alias("shard"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(deals)).cast("int").alias("deal"), "vec_id", "v")

    def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, held_v, own_list = left["vec_id"].to_numpy(), _array(left["v"], dims), left["list"].to_numpy()
            turned = held_v @ turn
            columns = [np.ascontiguousarray(turned[:, c : c + column_block]) for c in range(0, dims, column_block)]
            asked_v = _array(right["v"], dims)
            for query_id, original in zip(right["vec_id"].to_pylist(), asked_v):
                near = nearest_lists(original[None, :], centres, probes)[0]
                place = np.full(len(centres), len(centres))
                place[near] = np.arange(len(near))
                order = np.argsort(place[own_list], kind="stable")
                order = order[: int((place[own_list] < len(centres)).sum())]
                found += [(query_id, i, d) for d, i in scan(query_id, original, original @ turn, order, columns, held_v, ids, k, epsilon)]
        query, near, distance = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(distance, pa.float64())})

    met = held.groupBy("shard", "deal").cogroup(asked.groupBy("shard", "deal")).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
