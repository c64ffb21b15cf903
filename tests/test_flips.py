"""Flips of the recommendation against plain arithmetic on cards of every kind of rule."""

from __future__ import annotations

import random
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from tallyspark.operators.allocation import Wallet
from tallyspark.operators.flips import Curves, bands, recommendation_flip
from tallyspark.sources.cards import Bucket, Card, Predicate, Rule

MOST = 30_000


def random_cards(rng):
    cards = []
    for k in range(rng.randint(2, 3)):
        unit = rng.choice(("cashback", "points"))
        buckets = tuple(Bucket(f"b{j}", rng.randint(0, 12) * 25, unit) for j in range(2))
        rules = tuple(
            Rule(f"r{j}", rng.choice([Predicate("always"), Predicate("amount_gte", (rng.randint(1, 25) * 1000,)), Predicate("not", (Predicate("amount_gte", (rng.randint(1, 25) * 1000,)),))]), rng.choice((0.01, 0.02, 0.05)), unit, tuple(rng.sample(("b0", "b1"), rng.randint(0, 2))))
            for j in range(rng.randint(1, 3))
        )
        cards.append(Card(f"c{k}", "", "", buckets, rules, point_value_paise=30))
    return cards


def plain_winner(cards, used, amount):
    wallet, best = Wallet(cards), (0, None)
    for k, card in enumerate(cards):
        options = [(j, int(amount * r.rate + 0.5)) for j, r in enumerate(card.rules) if matches(r.when, amount) and int(amount * r.rate + 0.5) > 0]
        paid = wallet.pay(k, options, used[k])[0]
        if paid > best[0]:
            best = (paid, k)
    return best[1]


def matches(p, amount):
    return {"always": lambda: True, "amount_gte": lambda: amount >= p.args[0], "not": lambda: not matches(p.args[0], amount)}[p.op]()


def plain_search(winner, start):
    first = winner(start)
    if first is None:
        return None
    low, high = start, 2 * start + 100
    while high <= MOST and winner(high) == first:
        low, high = high, 2 * high
    if high > MOST:
        return None
    while low + 100 < high:
        middle = low + (high - low) // 2
        low, high = (middle, high) if winner(middle) == first else (low, middle)
    return high


def test_flips_equal_plain_arithmetic(spark):
    rng, flips, changes = random.Random(12), 0, 0
    for trial in range(24):
        cards = random_cards(rng)
        used = [{b.id: rng.randint(0, 6) * 25 for b in c.buckets} for c in cards]
        starts = [rng.randint(1_000, 14_000) for _ in range(4)]
        winner = {a: plain_winner(cards, used, a) for a in range(1_000, MOST + 1)}
        curves = Curves(
            cards, np.array([[[matches(r.when, e) for e in bands(cards)] for c in cards for r in c.rules]] * 4).reshape(4, -1),
            np.array([[min([max(0, c.bucket(b).limit_paise - used[k].get(b, 0)) for b in r.consumes], default=1 << 62) for k, c in enumerate(cards) for r in c.rules]] * 4),
        )
        found, exact = curves.searched(np.array(starts), MOST), curves.first_change(np.array(starts), MOST)
        for start, got, change in zip(starts, found.tolist(), exact.tolist()):
            assert got == (plain_search(winner.get, start) or 0)
            own = winner[start]
            assert change == (next((a for a in range(start + 1, MOST + 1) if winner[a] != own), 0) if own is not None else 0), (trial, start)
            flips, changes = flips + (got > 0), changes + (change > 0)
    assert flips > 15 and changes > 25


def test_flip_column(spark):
    """The worked case: five per cent with little room left against a flat one and a half."""
    five = Card("five", "", "", (Bucket("cap", 20_000),), (Rule("r", Predicate("always"), 0.05, consumes=("cap",)),))
    flat = Card("flat", "", "", (), (Rule("r", Predicate("always"), 0.015),), excluded_tags=("rent",))
    rows = spark.createDataFrame([(1, 100_000, []), (2, 5_000_000, []), (3, 100_000, ["rent"]), (4, 0, []), (5, None, [])], "id int, amount_paise long, tags array<string>")
    rows = rows.select("*", F.lit("online").alias("channel"), F.lit(None).cast("int").alias("mcc"), F.lit(date(2026, 1, 1)).alias("date"))
    found = {r["id"]: r for r in rows.select("id", recommendation_flip([five, flat], {"five": F.create_map(F.lit("cap"), F.lit(0))}).alias("f")).select("id", "f.*").collect()}
    assert found[1]["changes_at_paise"] == 1_333_367 and 0 <= found[1]["flip_paise"] - 1_333_367 < 100  # 1.5 % of it rounds to 20,001
    assert [tuple(found[k])[1:] for k in (2, 3, 4, 5)] == [(None, None)] * 4
    assert rows.limit(0).select(recommendation_flip([five, flat]).alias("f")).count() == 0
