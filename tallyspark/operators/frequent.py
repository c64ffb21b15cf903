"""The most frequent values of a column, exactly, without counting all the others.

Each partition keeps a space-saving summary of bounded size: its values' counts, each at most ``error``
too small, where a value that is not kept has been seen at most ``error`` times. Summaries merge by
addition. Whatever may be among the first k by these bounds is then counted again, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a partition's summary keeps.
CAPACITY = 4096
#: Values counted again by a broadcast; beyond that all values are counted.
RECOUNTED = 100_000


class Summary:
    """Counts of at most ``capacity`` strings; every true count lies within ``error`` above its own."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.error = capacity, {}, 0

    def add(self, counts: dict[str, int]) -> None:
        for value, n in counts.items():
            self.counts[value] = self.counts.get(value, 0) + n
        if len(self.counts) > self.capacity:
            least = sorted(self.counts.values(), reverse=True)[self.capacity]
            self.counts = {v: n - least for v, n in self.counts.items() if n > least}
            self.error += least


def _weighted(rows: DataFrame, column: str, weight: str | None) -> DataFrame:
    own = rows.select(F.col(column).cast("string").alias("value"), (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("n"))
    return own.filter("value is not null and n > 0")


def summaries(rows: DataFrame, column: str, capacity: int = CAPACITY, weight: str | None = None) -> DataFrame:
    """value, n, error of every partition: its kept values, and one row without a value that has the
    partition's error. ``weight``: how often a row counts, once by default; also below."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for batch in batches:
            seen = pa.Table.from_batches([batch]).group_by("value").aggregate([("n", "sum")])
            summary.add(dict(zip(seen["value"].to_pylist(), seen["n_sum"].to_pylist())))
        yield pa.RecordBatch.from_pydict({
            "value": pa.array([None, *summary.counts], pa.string()), "n": pa.array([0, *summary.counts.values()], pa.int64()),
            "error": pa.array([summary.error] + [0] * len(summary.counts), pa.int64()),
        })

    return _weighted(rows, column, weight).mapInArrow(work, "value string, n long, error long")


def survivors(merged: DataFrame, k: int) -> DataFrame | None:
    """The values that may be among the k most frequent; None where also an unknown one may be."""
    error = merged.agg(F.coalesce(F.sum("error"), F.lit(0)).alias("e")).first()["e"]
    lower = merged.filter("value is not null").groupBy("value").agg(F.sum("n").alias("n"))
    first = [r["n"] for r in lower.orderBy(F.desc("n")).limit(k).select("n").collect()]
    if len(first) < k:
        return lower.select("value") if error == 0 else None
    return lower.filter(F.col("n") + error >= first[-1]).select("value") if error < first[-1] else None


def frequent(rows: DataFrame, column: str, k: int, capacity: int = CAPACITY, weight: str | None = None) -> DataFrame:
    """value, n of the k most frequent values that are not null, ties by value.

    ``rows`` is read twice, so it should be a table. Where counts are so even that the summaries tell
    nothing apart, or too many values stay, all are counted.
    """
    values = _weighted(rows, column, weight)
    kept = survivors(summaries(rows, column, capacity, weight), k)
    if kept is not None and kept.limit(RECOUNTED + 1).count() <= RECOUNTED:
        values = values.join(F.broadcast(kept), "value", "left_semi")
    return values.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(k)
