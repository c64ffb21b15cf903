"""Cycles routed together against the arithmetic of one cycle."""

from __future__ import annotations

import random
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import allocation
from tallyspark.operators.allocation import Wallet
from tallyspark.operators.cycle_search import Cycles, stacked
from tallyspark.sources.cards import Bucket, Card, Milestone, Predicate, Rule


def random_cards(rng):
    cards = []
    for k in range(rng.randint(1, 4)):
        unit = rng.choice(("cashback", "points"))
        buckets = tuple(Bucket(f"b{j}", rng.randint(1, 40) * 100, unit) for j in range(rng.randint(0, 3)))
        names = [b.id for b in buckets] + ["unknown"]
        rules = tuple(Rule(f"r{j}", Predicate("always"), 0.01, unit, tuple(rng.choices(names, k=rng.randint(0, 3)))) for j in range(rng.randint(0, 3)))
        goals = tuple(Milestone(f"m{j}", rng.randint(1, 40) * 10_000, rng.randint(1, 30) * 1000) for j in range(rng.randint(0, 2)))
        cards.append(Card(f"c{k}", "", "", buckets, rules, milestones=goals, point_value_paise=rng.choice((25, 50, 100, 33))))
    return cards


def random_cycle(rng, cards):
    spends = []
    for _ in range(rng.choice((0, 1, 2, 5, 9, 14))):
        amount = rng.randint(5_000, 120_000)
        spends.append((amount, [[(r, amount // rng.choice((20, 50, 100))) for r in range(len(c.rules)) if rng.random() < 0.7] for c in cards]))
    return spends


def stack(cards, cycles, starts):
    rules = sum(len(c.rules) for c in cards)
    gross, amounts = [], []
    for spends in cycles:
        for amount, options in spends:
            amounts.append(amount)
            gross.append([dict(options[k]).get(r, 0) for k, c in enumerate(cards) for r in range(len(c.rules))])
    first = np.append(0, np.cumsum([len(c) for c in cycles]))
    start = [[s[k].get(b.id, 0) for k, c in enumerate(cards) for b in c.buckets] for s, c in zip(starts, cycles) for _ in c]
    as_matrix = lambda rows, width: np.array(rows, np.int64).reshape(len(rows), width)
    return first, np.array(amounts, np.int64), as_matrix(gross, rules), as_matrix(start, sum(len(c.buckets) for c in cards))


def test_stacked_cycles_equal_single_ones():
    """Greedy cards, rewards, rules, climbed assignments and totals of 400 cycles, from empty and from
    partly used buckets."""
    rng, seen = random.Random(20260815), 0
    for trial in range(20):
        cards = random_cards(rng)
        cycles = [c for c in (random_cycle(rng, cards) for _ in range(26)) if c]
        starts = [[{b.id: rng.choice((0, b.limit_paise // 2, b.limit_paise + 7)) for b in c.buckets} if trial % 2 else {} for c in cards] for _ in cycles]
        first, *columns = stack(cards, cycles, starts)
        for own, rows, many in stacked(cards, first, *columns):
            chosen = many.greedy()
            paid, rules = many.replay(chosen)
            naive, assigned, total = many.allocate()
            for n, k in enumerate(own.tolist()):
                wallet, spends, there = Wallet(cards, starts[k]), cycles[k], rows[n] >= 0
                assert there.sum() == len(spends) and there[: len(spends)].all()
                want, rupees, numbers = wallet.greedy(spends)
                assert (chosen[n, there].tolist(), paid[n, there].tolist(), rules[n, there].tolist()) == (want, rupees, numbers)
                assert naive[n] == sum(r + m for r, _, m in wallet.value(spends, want))
                best, value = wallet.allocate(spends)
                assert (assigned[n, there].tolist(), total[n]) == (best, value)
                seen += 1
    assert seen > 400


def test_no_cards():
    with pytest.raises(ValueError, match="at least one card"):
        Cycles([], np.zeros((1, 1)), np.zeros((1, 1, 0)), np.zeros((1, 0)))


def flat(card, rate, goals=()):
    return Card(card, "", "", rules=(Rule("all", Predicate("always"), rate),), milestones=goals)


def spends_of(spark, rows):
    frame = spark.createDataFrame(rows, "cycle_id long, spend_seq long, amount_paise long")
    return frame.select("*", F.lit("online").alias("channel"), F.lit(None).cast("int").alias("mcc"), F.array().cast("array<string>").alias("tags"), F.lit(date(2026, 1, 1)).alias("date"))


def test_milestone_example_in_spark(spark):
    """Ten spends of 1,000 rupees: greedy 20,000 paise, allocated 60,000, two thirds missed."""
    cards = [flat("two", 0.02), flat("goal", 0.01, (Milestone("m", 1_000_000, 50_000),))]
    spends = spends_of(spark, [(1, k, 100_000) for k in range(10)])
    row = allocation.allocate_cycles(spends, cards).first()
    assert (row["greedy_paise"], row["allocated_paise"], row["spend_paise"], row["n_spends"]) == (20_000, 60_000, 1_000_000, 10)
    assert allocation.leakage_report(allocation.allocate_cycles(spends, cards)).first()["leakage"] == pytest.approx(2 / 3, abs=1e-6)


def test_cycles_do_not_depend_on_batches(spark):
    """Cycles longer than a batch, cycles cut by one, a null cycle, an empty table."""
    rng = random.Random(3)
    rows = [(None if c == 7 else c, k, rng.randint(1, 900) * 100) for c in range(40) for k in range(rng.choice((1, 2, 3, 25)))]
    cards = [flat("two", 0.02), flat("goal", 0.01, (Milestone("m", 300_000, 9_000),)), Card("cap", "", "", (Bucket("b", 3_000),), (Rule("r", Predicate("always"), 0.05, consumes=("b",)),))]
    def found():
        spends = spends_of(spark, rows)
        key = lambda r: tuple((x is None, x or 0) for x in r)
        return sorted(map(tuple, allocation.allocate_cycles(spends, cards).collect()), key=lambda r: (r[0] is None, r[0] or 0)), sorted((tuple(r)[:2] + tuple(r)[3:5] for r in allocation.greedy_allocate(spends, cards).collect()), key=key)

    whole = found()
    assert len(whole[0]) == 40 and len(whole[1]) == len(rows)
    assert sum(r[2] for r in whole[1]) == sum(r[2] for r in rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert found() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert allocation.allocate_cycles(spends_of(spark, []), cards).count() == 0
    assert allocation.greedy_allocate(spends_of(spark, []), cards).count() == 0


def test_stacked_optima_equal_single_searches(monkeypatch):
    """Whole cycles of one to six spends, with milestones and partly used buckets, also a cycle at a time."""
    rng, seen = random.Random(5), 0
    for trial in range(24):
        monkeypatch.setattr("tallyspark.operators.cycle_search.SPLITS", rng.choice((1, 1 << 20)))
        cards, n = random_cards(rng), rng.randint(1, 6)
        cycles = [[s for s in random_cycle(rng, cards) + random_cycle(rng, cards)][:n] for _ in range(12)]
        cycles = [c for c in cycles if len(c) == n]
        if not cycles:
            continue
        starts = [[{b.id: rng.choice((0, b.limit_paise // 2, b.limit_paise + 7)) for b in c.buckets} for c in cards] for _ in cycles]
        for own, rows, many in stacked(cards, *stack(cards, cycles, starts)):
            assert many.optima(n).tolist() == [Wallet(cards, starts[k]).brute_force(cycles[k])[1] for k in own.tolist()]
            seen += len(own)
    assert seen > 100


def test_small_batches_are_routed_together(monkeypatch):
    """No cycle is cut, and tables are as large as they may be, whatever the batches."""
    cycle = np.repeat(np.arange(40), np.arange(40) % 7 + 1)
    batches = [pa.RecordBatch.from_pydict({"cycle_id": cycle[a : a + 5]}) for a in range(0, len(cycle), 5)]
    for size in (1, 64, 10_000):
        monkeypatch.setattr(allocation, "STACKED", size)
        tables = list(allocation._whole_cycles(batches, ("cycle_id",)))
        assert np.concatenate([t["cycle_id"].to_numpy() for t, _ in tables]).tolist() == cycle.tolist()
        assert [n for t, first in tables for n in np.diff(first).tolist()] == np.unique(cycle, return_counts=True)[1].tolist()
        assert len(tables) <= -(-len(cycle) // size) + 1
