"""Most frequent values against plain counts, and what the summaries promise."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import frequent as H


def zipf(rng, n, distinct):
    return [f"p{min(int(rng.paretovariate(0.7)), distinct)}" for _ in range(n)]


def plain(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


def test_a_summary_is_never_wrong_by_more_than_its_error():
    rng = random.Random(1)
    for capacity in (1, 3, 20):
        summary, seen = H.Summary(capacity), Counter()
        for _ in range(40):
            part = Counter(zipf(rng, 50, 200))
            summary.add(part)
            seen.update(part)
            assert len(summary.counts) <= capacity
            assert all(summary.counts.get(v, 0) <= n <= summary.counts.get(v, 0) + summary.error for v, n in seen.items())
            assert summary.error * (capacity + 1) <= sum(seen.values())


@pytest.mark.parametrize(("values", "capacity"), [("zipf", 50), ("zipf", 4), ("even", 8), ("few", 4096), ("ties", 6), ("none", 5)])
def test_the_first_are_exact(spark, values, capacity):
    rng = random.Random(2)
    own = {
        "zipf": zipf(rng, 4000, 900), "even": [f"v{i % 300}" for i in range(3000)], "few": ["a", "b", None, "a"], "ties": ["x"] * 40 + ["y"] * 40 + ["z"] * 40 + [f"u{i}" for i in range(200)], "none": [None] * 9,
    }[values]
    rows = spark.createDataFrame([(v,) for v in own], "payee string").repartition(5)
    assert [tuple(r) for r in H.frequent(rows, "payee", 5, capacity).collect()] == plain(own, 5)


def test_survivors_are_few_and_hold_the_first(spark):
    own = zipf(random.Random(3), 20_000, 5_000)
    rows = spark.createDataFrame([(v,) for v in own], "payee string").repartition(4)
    kept = {r["value"] for r in H.survivors(H.summaries(rows, "payee", 200), 10).collect()}
    assert {v for v, _ in plain(own, 10)} <= kept and len(kept) < 60
    even = spark.createDataFrame([(f"v{i}",) for i in range(3000)], "payee string").repartition(4)
    assert H.survivors(H.summaries(even, "payee", 10), 5) is None  # nothing is told apart: all are counted
    assert H.summaries(even.limit(0), "payee").agg(F.sum("n")).first()[0] in (0, None)
