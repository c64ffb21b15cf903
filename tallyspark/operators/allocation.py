"""Billing cycles: ordered replay, greedy routing, milestone-aware search, leakage.

Spark decides per spend and card which rules match and their gross reward; what is left for a fold is
an ordered list of small integers. A cycle is one wallet's month, so it is small, and their number is
what scales: a partition holds whole cycles one behind another, and ``cycle_search`` works on a batch
of them at once. ``Wallet`` is the same arithmetic for one cycle, for streams and exhaustive search. Fixed assignments whose capped rules share one bucket
need no fold: the window path of ``replay_window`` is exact for them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.cycle_search import Cycles, splits, stacked
from tallyspark.operators.rewards import rule_candidates, rule_gross
from tallyspark.sources.cards import Card

Options = list[tuple[int, int]]  # (rule, gross), in rule order


#: Rows of a table of cycles that are routed together.
STACKED = 1 << 16
#: Spends of the longest cycle that is searched whole.
SEARCHED = 12


class Wallet:
    """Reward arithmetic of one cycle over integer paise. ``start``: what each card's buckets hold
    before the first spend, nothing where it is not given."""

    def __init__(self, cards: list[Card], start: list[dict[str, int]] | None = None):
        if not cards:
            raise ValueError("a cycle with spends needs at least one card")
        self.cards = cards
        self.start = [{} for _ in cards] if start is None else start
        self.limits = [{b.id: b.limit_paise for b in c.buckets} for c in cards]
        self.milestones = [[(m.threshold_paise, m.grant_paise) for m in c.milestones] for c in cards]

    def pay(self, card: int, options: Options, used: dict[str, int]) -> tuple[int, dict[str, int], int]:
        """(rupees, what each bucket takes, rule or -1)."""
        limits, spec = self.limits[card], self.cards[card]
        for k, gross in options:
            rule = spec.rules[k]
            known = [b for b in rule.consumes if b in limits]
            granted = min([gross, *(max(0, limits[b] - used.get(b, 0)) for b in known)])
            if granted > 0:
                rupees = granted if rule.unit == "cashback" else (2 * granted * spec.point_value_paise + 100) // 200
                return rupees, dict.fromkeys(known, granted), k
        return 0, {}, -1

    def card_total(self, card: int, spends: Iterable[tuple[int, list[Options]]]) -> tuple[int, int, int]:
        """(rewards, spend, milestone grants) of the spends on one card, in order, from the start."""
        used = dict(self.start[card])
        rewards = spent = 0
        for amount, options in spends:
            rupees, takes, _ = self.pay(card, options[card], used)
            for b, x in takes.items():
                used[b] = used.get(b, 0) + x
            rewards += rupees
            spent += amount
        return rewards, spent, sum(grant for threshold, grant in self.milestones[card] if spent >= threshold)

    def value(self, spends: list, assignment: list[int]) -> list[tuple[int, int, int]]:
        return [self.card_total(c, (s for s, a in zip(spends, assignment) if a == c)) for c in range(len(self.cards))]

    def greedy(self, spends: list, used: list[dict[str, int]] | None = None) -> tuple[list[int], list[int], list[int]]:
        """(card, rupees, rule) of each spend, taking the best marginal reward; ties and all-zero
        spends go to the first card. ``used`` is what each card's buckets hold, updated in place."""
        used = [dict(u) for u in self.start] if used is None else used
        chosen, paid, rules = [], [], []
        for _, options in spends:
            offers = [self.pay(c, options[c], used[c]) for c in range(len(self.cards))]
            best = max(range(len(offers)), key=lambda c: (offers[c][0], -c))
            rupees, takes, rule = offers[best]
            for b, x in takes.items():
                used[best][b] = used[best].get(b, 0) + x
            chosen.append(best)
            paid.append(rupees)
            rules.append(rule)
        return chosen, paid, rules

    def climb(self, spends: list, start: list[int], passes: int = 8) -> tuple[list[int], int]:
        """Single moves that strictly raise the total. A move changes two cards only, so only these
        are replayed. The assignment returned is the one that has the total."""
        own, parts = list(start), self.value(spends, start)
        worth = lambda p: p[0] + p[2]
        total = sum(map(worth, parts))
        for _ in range(passes):
            better = False
            for i in range(len(spends)):
                for c in range(len(self.cards)):
                    was = own[i]
                    if c == was:
                        continue
                    own[i] = c
                    new = {k: self.card_total(k, (s for s, a in zip(spends, own) if a == k)) for k in (was, c)}
                    gained = sum(worth(new[k]) - worth(parts[k]) for k in (was, c))
                    if gained > 0:
                        total, better = total + gained, True
                        parts = [new.get(k, p) for k, p in enumerate(parts)]
                    else:
                        own[i] = was
            if not better:
                break
        return own, total

    def milestone_seed(self, spends: list, card: int, threshold: int, base: list[int]) -> list[int]:
        """``base`` with the spends that lose least, from empty caps, moved to ``card`` until it reaches
        the threshold."""

        def loss(i: int) -> tuple[int, int, int]:
            offers = [self.pay(c, spends[i][1][c], {})[0] for c in range(len(self.cards))]
            elsewhere = max([0, *(x for c, x in enumerate(offers) if c != card)])
            return elsewhere - offers[card], -spends[i][0], i

        own = list(base)
        running = sum(s[0] for s, a in zip(spends, own) if a == card)
        for i in sorted(range(len(spends)), key=loss):
            if running >= threshold:
                break
            if own[i] != card:
                own[i] = card
                running += spends[i][0]
        return own

    def allocate(self, spends: list, passes: int = 8) -> tuple[list[int], int]:
        """The best of hill climbs from the greedy start and from one seed for each milestone."""
        if not spends:
            return [], 0
        base = self.greedy(spends)[0]
        best = self.climb(spends, base, passes)
        for c, goals in enumerate(self.milestones):
            for threshold, _ in goals:
                found = self.climb(spends, self.milestone_seed(spends, c, threshold, base), passes)
                if found[1] > best[1]:
                    best = found
        return best

    def subset_values(self, card: int, spends: list) -> list[int]:
        """Rewards and milestone grants of each set of spends on one card; bit i of a set's index is
        spend i. A set replays as its last spend after the set without it."""
        states: list[tuple[int, int, dict[str, int]]] = [(0, 0, self.start[card])]
        for amount, options in spends:
            for rewards, spent, used in states[:]:
                rupees, takes, _ = self.pay(card, options[card], used)
                if takes:
                    used = used | {b: used.get(b, 0) + x for b, x in takes.items()}
                states.append((rewards + rupees, spent + amount, used))
        goals = self.milestones[card]
        return [rewards + sum(grant for threshold, grant in goals if spent >= threshold) for rewards, spent, _ in states]

    def brute_force(self, spends: list, limit: int = SEARCHED) -> tuple[list[int], int]:
        """The first best of all assignments, in lexicographic order: the best partition of the
        spends into one set a card, card by card. Of equal totals the least assignment read as a
        number in base ``len(cards)`` wins; it is a sum over the cards' sets like the total, so one
        integer, total times the count of assignments less that number, orders both."""
        if len(spends) > limit:
            raise ValueError(f"brute force is for at most {limit} spends")
        n, k = len(spends), len(self.cards)
        place = [0]
        for i in range(n):
            place += [x + k ** (n - 1 - i) for x in place]
        # Python integers, which cannot overflow, where 64 bits might not hold the order
        values = [self.subset_values(c, spends) for c in range(k)]
        dtype = np.int64 if (sum(map(max, values)) + 1) * k**n < 1 << 62 else object
        order = [np.array([v * k**n - c * x for v, x in zip(values[c], place)], dtype) for c in range(k)]
        best, picks = order[0], []
        for c in range(1, k):
            own, others, starts = splits(n)
            total = best[others] + order[c][own]
            best = np.maximum.reduceat(total, starts)
            picks.append((total, best))
        assignment, left = [0] * n, (1 << n) - 1
        for c in range(k - 1, 0, -1):
            own, _, starts = splits(n)
            total, most = picks[c - 1]
            end = starts[left + 1] if left + 1 < len(starts) else len(own)
            taken = int(own[starts[left] + int(np.flatnonzero(total[starts[left] : end] == most[left])[0])])
            for i in range(n):
                if taken >> i & 1:
                    assignment[i] = c
            left ^= taken
        return assignment, -int(-best[-1] // k**n)


def card_options(cards: list[Card]) -> Column:
    """array<bigint>: card, rule and gross of every candidate in turn, flat, as Arrow hands it to
    pandas without a Python object for each."""

    def triples(k: int) -> Column:
        return F.transform(rule_candidates(cards[k]), lambda x: F.array(F.lit(k).cast("bigint"), x["rule"].cast("bigint"), x["gross"]))

    return F.flatten(F.flatten(F.array(*map(triples, range(len(cards))))))


States = dict[str, Column]  # card id -> map<string,bigint>, bucket id -> paise consumed, one map a cycle


def _start_column(cards: list[Card], states: States | None) -> Column:
    """array<bigint>: what every bucket of every card holds before the cycle, empty without states."""
    if not states:
        return F.array().cast("array<bigint>").alias("start")
    held = [F.coalesce(F.try_element_at(states[c.id], F.lit(b.id)), F.lit(0)).cast("bigint") if c.id in states else F.lit(0).cast("bigint") for c in cards for b in c.buckets]
    return F.array(*held).cast("array<bigint>").alias("start")


def spend_options(flat: Iterable[int], n_cards: int) -> list[Options]:
    """What ``card_options`` lists flat, by card."""
    options: list[Options] = [[] for _ in range(n_cards)]
    values = iter(flat)
    for card, rule, gross in zip(values, values, values):
        options[card].append((rule, gross))
    return options


def _stacked_rows(spends: DataFrame, cards: list[Card], states: States | None, keys: tuple[str, ...], extra: tuple[str, ...] = (), tasks: tuple[int, ...] = ()) -> DataFrame:
    """The spends of a cycle one behind another in one partition, in order, as numbers: keys, spend_seq,
    amount_paise, the gross reward of every rule, and the buckets' start."""
    rows = spends.select(*(F.col(k).cast("bigint").alias(k) for k in keys), "spend_seq", "amount_paise", rule_gross(cards).alias("gross"), _start_column(cards, states), *extra)
    return rows.repartition(*tasks, *keys).sortWithinPartitions(*keys, "spend_seq")


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one length as a matrix; empty lists stand for zeros."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width) if width and len(flat) else np.zeros((len(column), width), np.int64)


def _whole_cycles(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cycles, of about ``STACKED`` rows each, and where their cycles begin, with the end."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in itertools.chain((b for b in batches if b.num_rows), [None]):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
            if rows < STACKED:
                continue
        if not held:
            break
        table = pa.Table.from_batches(held)
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            column = table[k].combine_chunks()
            for v in (column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()):
                new[1:] |= v[1:] != v[:-1]
        first = np.append(np.flatnonzero(new), table.num_rows)
        if batch is not None:  # its last cycle may go on
            held, first = table.slice(int(first[-2])).to_batches(), first[:-1]
            table = table.slice(0, int(first[-1]))
            rows = 0
        if len(first) > 1:
            yield table, first


def _cycles_of(table: pa.Table, first: np.ndarray, cards: list[Card]) -> Iterator[tuple[np.ndarray, np.ndarray, Cycles]]:
    rules, buckets = sum(len(c.rules) for c in cards), sum(len(c.buckets) for c in cards)
    return stacked(cards, first, _numbers(table["amount_paise"]), _matrix(table["gross"], rules), _matrix(table["start"], buckets))


def _rule_ids(cards: list[Card], chosen: np.ndarray, rules: np.ndarray) -> list[str | None]:
    return [cards[c].rules[r].id if r >= 0 else None for c, r in zip(chosen.tolist(), rules.tolist())]


def greedy_allocate(spends: DataFrame, cards: list[Card], states: States | None = None) -> DataFrame:
    """cycle_id, spend_seq, card_id, amount_paise, rupees_paise, rule_id. ``states``: what a cycle's
    buckets hold at its start, by card, for a cycle that is imported half way; also below. Where rows of
    one cycle differ in their states, its first spend's count."""
    Wallet(cards)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_cycles(batches, ("cycle_id",)):
            chosen, paid, rules = (np.zeros(table.num_rows, np.int64) for _ in range(3))
            for _, rows, cycles in _cycles_of(table, first, cards):
                own, there = cycles.greedy(), rows >= 0
                for out, found in zip((chosen, paid, rules), (own, *cycles.replay(own))):
                    out[rows[there]] = found[there]
            yield from pa.table({
                "cycle_id": table["cycle_id"], "spend_seq": table["spend_seq"], "card_id": pa.array([cards[c].id for c in chosen.tolist()], pa.string()), "amount_paise": table["amount_paise"],
                "rupees_paise": pa.array(paid), "rule_id": pa.array(_rule_ids(cards, chosen, rules), pa.string()),
            }).to_batches()

    rows = _stacked_rows(spends, cards, states, ("cycle_id",))
    return rows.mapInArrow(fold, "cycle_id long, spend_seq long, card_id string, amount_paise long, rupees_paise long, rule_id string")


def replay(assigned: DataFrame, cards: list[Card], states: States | None = None) -> DataFrame:
    """Rewards of spends with a card_ord each, folded in order: per spend, its amount, reward and rule."""
    Wallet(cards)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_cycles(batches, ("cycle_id",)):
            card = _numbers(table["card_ord"]).astype(np.int64)
            paid, rules = (np.zeros(table.num_rows, np.int64) for _ in range(2))
            for _, rows, cycles in _cycles_of(table, first, cards):
                there = rows >= 0
                for out, found in zip((paid, rules), cycles.replay(card[rows])):
                    out[rows[there]] = found[there]
            yield from pa.table({
                "cycle_id": table["cycle_id"], "card_ord": table["card_ord"], "spend_seq": table["spend_seq"], "amount_paise": table["amount_paise"],
                "rupees_paise": pa.array(paid), "rule_id": pa.array(_rule_ids(cards, card, rules), pa.string()),
            }).to_batches()

    rows = _stacked_rows(assigned.withColumn("card_ord", F.col("card_ord").cast("int")), cards, states, ("cycle_id",), ("card_ord",))
    return rows.mapInArrow(fold, "cycle_id long, card_ord int, spend_seq long, amount_paise long, rupees_paise long, rule_id string")


def evaluate_assignment(assigned: DataFrame, cards: list[Card], states: States | None = None) -> DataFrame:
    """Per cycle and card, cards without a spend too: n_spends, spend_paise, reward_paise,
    milestone_paise, milestones_earned. A spend that earns nothing still counts to spend and milestones."""
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    own = lambda c, x: zero(F.sum(F.when(F.col("card_ord") == c, F.col(x))))
    totals = F.array(*(
        F.struct(F.lit(k).alias("card_ord"), F.lit(c.id).alias("card_id"), F.count_if(F.col("card_ord") == k).alias("n_spends"), own(k, "amount_paise").alias("spend_paise"), own(k, "rupees_paise").alias("reward_paise"))
        for k, c in enumerate(cards)
    ))
    met = F.array().cast("array<struct<card_id:string,id:string,threshold:bigint,grant:bigint>>")
    goals = [F.struct(F.lit(c.id).alias("card_id"), F.lit(m.id).alias("id"), F.lit(m.threshold_paise).cast("bigint").alias("threshold"), F.lit(m.grant_paise).cast("bigint").alias("grant")) for c in cards for m in c.milestones]
    met = F.filter(F.array(*goals) if goals else met, lambda g: (g["card_id"] == F.col("card_id")) & (F.col("spend_paise") >= g["threshold"]))
    per_card = replay(assigned, cards, states).groupBy("cycle_id").agg(totals.alias("t")).select("cycle_id", F.inline("t")).withColumn("met", met)
    return per_card.select(
        "cycle_id", "card_id", "n_spends", "spend_paise", "reward_paise",
        F.aggregate(F.transform("met", lambda g: g["grant"]), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("milestone_paise"), F.transform("met", lambda g: g["id"]).alias("milestones_earned"),
    )


def replay_window(spends: DataFrame, card: Card) -> DataFrame:
    """The replay of one card as a running sum. Exact where all capped rules consume the same single
    bucket and pay cashback: what is consumed before a spend is the running demand of capped first
    matches, cut at the limit, for once the cap is full only uncapped rules pay."""
    capped = [r for r in card.rules if any(card.bucket(b) for b in r.consumes)]
    names = {tuple(b for b in r.consumes if card.bucket(b)) for r in capped}
    if len(names) != 1 or len(next(iter(names))) != 1 or any(r.unit != "cashback" for r in card.rules):
        raise ValueError(f"{card.id} needs the fold")
    limit = card.bucket(next(iter(names))[0]).limit_paise
    is_capped = F.array(*(F.lit(r in capped) for r in card.rules))
    rows = spends.select("cycle_id", "spend_seq", "amount_paise", rule_candidates(card).alias("options"))
    first = F.try_element_at("options", F.lit(1))
    rows = rows.withColumn("demand", F.when(F.coalesce(F.element_at(is_capped, first["rule"] + 1), F.lit(False)), first["gross"]).otherwise(F.lit(0)))
    before = Window.partitionBy("cycle_id").orderBy("spend_seq").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(limit) - F.least(F.lit(limit), F.coalesce(F.sum("demand").over(before), F.lit(0)))
    free = F.try_element_at(F.filter("options", lambda x: ~F.element_at(is_capped, x["rule"] + 1)), F.lit(1))["gross"]
    # a capped rule may come after the first match only when that one is capped too and the cap is full
    paid = F.when((F.col("demand") > 0) & (F.col("room") > 0), F.least("demand", "room")).otherwise(F.coalesce(free, F.lit(0)))
    return rows.withColumn("room", room).select("cycle_id", "spend_seq", "amount_paise", paid.cast("bigint").alias("rupees_paise"))


def milestone_grants(per_card: DataFrame, milestones: DataFrame) -> DataFrame:
    """Adds milestone_paise and earned to rows of (card_id, spend_paise): grants whose threshold is met.
    ``milestones``: card_id, milestone_id, threshold_paise, grant_paise; a card's few rows broadcast."""
    keys = per_card.columns
    met = per_card.join(F.broadcast(milestones), (per_card.card_id == milestones.card_id) & (per_card.spend_paise >= milestones.threshold_paise), "left").select(*(per_card[c] for c in keys), "milestone_id", "grant_paise")
    return met.groupBy(*keys).agg(F.coalesce(F.sum("grant_paise"), F.lit(0)).cast("bigint").alias("milestone_paise"), F.count("milestone_id").alias("milestones_earned"))


def milestone_rows(spark, cards: list[Card]) -> DataFrame:
    rows = [(c.id, m.id, m.threshold_paise, m.grant_paise) for c in cards for m in c.milestones]
    return spark.createDataFrame(rows, "card_id string, milestone_id string, threshold_paise long, grant_paise long")


def allocate_cycles(spends: DataFrame, cards: list[Card], extra_keys: tuple[str, ...] = (), states: States | None = None) -> DataFrame:
    """Per cycle: greedy and allocated totals, spend, and the allocated assignment."""
    Wallet(cards)
    keys = (*extra_keys, "cycle_id")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_cycles(batches, keys):
            naive, total, spent = (np.zeros(len(first) - 1, np.int64) for _ in range(3))
            chosen = np.zeros(table.num_rows, np.int32)
            for own, rows, cycles in _cycles_of(table, first, cards):
                naive[own], assignment, total[own] = cycles.allocate()
                spent[own] = cycles.amounts.sum(axis=1)
                chosen[rows[rows >= 0]] = assignment[rows >= 0]
            yield from pa.table({k: table[k].take(first[:-1]) for k in keys} | {
                "n_spends": pa.array(np.diff(first)), "spend_paise": pa.array(spent), "greedy_paise": pa.array(naive), "allocated_paise": pa.array(total),
                "assignment": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(chosen)),
            }).to_batches()

    schema = ", ".join(f"{k} long" for k in keys) + ", n_spends long, spend_paise long, greedy_paise long, allocated_paise long, assignment array<int>"
    return _stacked_rows(spends, cards, states, keys).mapInArrow(fold, schema)


def brute_force_cycles(spends: DataFrame, cards: list[Card], states: States | None = None) -> DataFrame:
    """Greedy and allocated totals and the best of all assignments, of cycles of few spends."""
    Wallet(cards)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_cycles(batches, ("cycle_id",)):
            naive, total, most = (np.zeros(len(first) - 1, np.int64) for _ in range(3))
            for own, rows, cycles in _cycles_of(table, first, cards):
                naive[own], _, total[own] = cycles.allocate()
                length = (rows >= 0).sum(axis=1)
                if length.max() > SEARCHED:
                    raise ValueError(f"brute force is for at most {SEARCHED} spends")
                for n in np.unique(length).tolist():
                    some = np.flatnonzero(length == n)
                    most[own[some]] = Cycles(cards, cycles.amounts[some], cycles.gross[some], cycles.start[some]).optima(n)
            yield from pa.table({"cycle_id": table["cycle_id"].take(first[:-1]), "greedy_paise": pa.array(naive), "allocated_paise": pa.array(total), "optimum_paise": pa.array(most)}).to_batches()

    # few bytes, much work: a number of partitions of its own, which Spark does not merge by size
    tasks = int(spends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _stacked_rows(spends, cards, states, ("cycle_id",), tasks=(tasks,)).mapInArrow(fold, "cycle_id long, greedy_paise long, allocated_paise long, optimum_paise long")


def leakage(missed: Column, value: Column, floored: bool = True) -> Column:
    """Share of the attainable value that was missed; 0 where there is none."""
    share = F.when(value <= 0, F.lit(0.0)).otherwise(missed / value)
    return F.greatest(share, F.lit(0.0)) if floored else share


def leakage_report(allocated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pooled totals over the cycles of ``allocate_cycles``."""
    missed = F.sum("allocated_paise") - F.sum("greedy_paise")
    return allocated.groupBy(*by).agg(
        F.count("*").alias("cycles"), F.sum("n_spends").cast("bigint").alias("spends"), F.sum("spend_paise").cast("bigint").alias("spend_paise"),
        F.sum("greedy_paise").cast("bigint").alias("greedy_paise"), F.sum("allocated_paise").cast("bigint").alias("allocated_paise"),
        missed.cast("bigint").alias("missed_paise"), F.round(leakage(missed, F.sum("allocated_paise"), floored=False), 6).alias("leakage"),
        F.expr("sum(spend_paise) div count(*)").alias("monthly_spend_paise"),
    )


def volume_sweep(spends: DataFrame, cards: list[Card], scales: tuple[int, ...] = (1, 2, 4, 8, 16, 32)) -> DataFrame:
    """The leakage report with all amounts multiplied by each scale."""
    scaled = spends.withColumn("scale", F.explode(F.array(*(F.lit(s).cast("bigint") for s in scales)))).withColumn("amount_paise", F.col("amount_paise") * F.col("scale"))
    return leakage_report(allocate_cycles(scaled, cards, ("scale",)), ("scale",))
