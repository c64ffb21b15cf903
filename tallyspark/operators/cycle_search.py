"""Routing of many billing cycles at once.

Cycles of like length are stacked: a step works on the n-th spend of all of them in a few numpy
operations, so the cost of Python is that of a batch and not of a spend. Single moves of the hill climb
are valued by difference: what a card earns with and without the spend in question, replayed from the
state that it has just before it, the other cards untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tallyspark.sources.cards import Card

#: Cycles are stacked with others at most this many spends longer; the rest is filled up with spends of nothing.
STEP = 4


@dataclass
class Cycles:
    """``amounts``: cycles by spends; ``gross``: cycles by spends by rules of all cards, 0 where a rule
    does not match; ``start``: cycles by buckets of all cards."""

    cards: list[Card]
    amounts: np.ndarray
    gross: np.ndarray
    start: np.ndarray

    def __post_init__(self) -> None:
        if not self.cards:
            raise ValueError("a cycle with spends needs at least one card")
        slots = {}
        for k, c in enumerate(self.cards):
            for b in c.buckets:
                slots[k, b.id] = len(slots)
        self.limits = np.array([b.limit_paise for c in self.cards for b in c.buckets], np.int64)
        self.rules: list[list[tuple[int, str, list[int]]]] = []  # of each card: place, unit, buckets
        place = 0
        for k, c in enumerate(self.cards):
            self.rules.append([(place + j, r.unit, [slots[k, b] for b in dict.fromkeys(r.consumes) if (k, b) in slots]) for j, r in enumerate(c.rules)])
            place += len(c.rules)
        self.buckets = [[slots[k, b.id] for b in c.buckets] for k, c in enumerate(self.cards)]
        self.goals = [[(m.threshold_paise, m.grant_paise) for m in c.milestones] for c in self.cards]

    @property
    def size(self) -> tuple[int, int]:
        return self.amounts.shape

    def pay(self, card: int, j: int, used: np.ndarray, take: bool | np.ndarray = False) -> tuple[np.ndarray, np.ndarray]:
        """Rupees, and the card's rule or -1, of the j-th spends on a card. ``used`` is what the buckets
        hold, by cycle; where ``take`` holds, it is raised by what the spends take."""
        rupees, chosen = np.zeros(len(used), np.int64), np.full(len(used), -1, np.int64)
        for n, (place, unit, buckets) in enumerate(self.rules[card]):
            granted = self.gross[:, j, place]
            for b in buckets:
                granted = np.minimum(granted, self.limits[b] - used[:, b])
            hit = (chosen < 0) & (granted > 0)
            paid = granted if unit == "cashback" else (2 * granted * self.cards[card].point_value_paise + 100) // 200
            rupees, chosen = np.where(hit, paid, rupees), np.where(hit, n, chosen)
            if buckets and take is not False:
                taken = np.where(hit & take, granted, 0)
                for b in buckets:
                    used[:, b] += taken
        return rupees, chosen

    def grants(self, card: int, spent: np.ndarray) -> np.ndarray:
        return sum((np.where(spent >= threshold, grant, 0) for threshold, grant in self.goals[card]), np.zeros(len(spent), np.int64))

    def spent(self, assignment: np.ndarray, card: int) -> np.ndarray:
        return np.where(assignment == card, self.amounts, 0).sum(axis=1)

    def replay(self, assignment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rupees and rule of every spend, folded in order on its card."""
        used, paid, rules = self.start.copy(), np.zeros(self.size, np.int64), np.full(self.size, -1, np.int64)
        for j in range(self.size[1]):
            for card in range(len(self.cards)):
                own = assignment[:, j] == card
                rupees, rule = self.pay(card, j, used, own)
                paid[:, j], rules[:, j] = np.where(own, rupees, paid[:, j]), np.where(own, rule, rules[:, j])
        return paid, rules

    def totals(self, assignment: np.ndarray) -> np.ndarray:
        """Rewards and milestone grants of whole cycles."""
        return self.replay(assignment)[0].sum(axis=1) + sum(self.grants(c, self.spent(assignment, c)) for c in range(len(self.cards)))

    def greedy(self) -> np.ndarray:
        """Every spend to the card that pays most for it as it comes; ties and spends that earn nothing
        to the first."""
        used, chosen = self.start.copy(), np.zeros(self.size, np.int64)
        for j in range(self.size[1]):
            offers = np.stack([self.pay(c, j, used)[0] for c in range(len(self.cards))])
            chosen[:, j] = offers.argmax(axis=0)
            for card in range(len(self.cards)):
                self.pay(card, j, used, chosen[:, j] == card)
        return chosen

    def _rest(self, card: int, own: np.ndarray, j: int, used: np.ndarray, held: bool) -> np.ndarray:
        """What a card earns with the j-th spend, held by it or not, and its spends after that."""
        used = used.copy()
        earned = self.pay(card, j, used, True)[0] if held else np.zeros(len(used), np.int64)
        if not self.buckets[card]:  # what comes after does not depend on it
            return earned
        for i in range(j + 1, self.size[1]):
            mine = own[:, i] == card
            if mine.any():
                earned = earned + np.where(mine, self.pay(card, i, used, mine)[0], 0)
        return earned

    def climb(self, start: np.ndarray, passes: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Assignments and their totals after moves of one spend that strictly raise the total, spend by
        spend and card by card, until a pass brings nothing. Cycles that are done no longer take part."""
        own, k = start.copy(), len(self.cards)
        total = self.totals(own)
        going = np.arange(len(own))
        for _ in range(passes):
            part = Cycles(self.cards, self.amounts[going], self.gross[going], self.start[going])
            mine, gained = part._climb_once(own[going])
            own[going], total[going] = mine, total[going] + gained
            going = going[gained > 0]
            if k < 2 or not len(going):
                break
        return own, total

    def _climb_once(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One pass over all spends, and what it gained."""
        own, k, gained = own.copy(), len(self.cards), np.zeros(len(own), np.int64)
        used, spent = self.start.copy(), np.stack([self.spent(own, c) for c in range(k)])
        for j in range(self.size[1]):
            amount = self.amounts[:, j]
            # with the spend less without it, on each card; the other spends stay where they are
            worth = np.empty((k, len(own)), np.int64)
            for c in range(k):
                others = spent[c] - np.where(own[:, j] == c, amount, 0)
                worth[c] = self._rest(c, own, j, used, True) - self._rest(c, own, j, used, False) + self.grants(c, others + amount) - self.grants(c, others)
            now = own[:, j]
            best = np.take_along_axis(worth, now[None], 0)[0]
            for c in range(k):  # each card that beats the one before it, in order: the first of the best
                better = worth[c] > best
                gained += np.where(better, worth[c] - best, 0)
                now, best = np.where(better, c, now), np.where(better, worth[c], best)
            for c in range(k):
                spent[c] += np.where(now == c, amount, 0) - np.where(own[:, j] == c, amount, 0)
            own[:, j] = now
            for c in range(k):
                if self.buckets[c]:
                    self.pay(c, j, used, now == c)
        return own, gained

    def milestone_seed(self, card: int, threshold: int, base: np.ndarray) -> np.ndarray:
        """``base`` with the spends that lose least, from empty caps, moved to ``card`` until it reaches
        the threshold."""
        own, empty = base.copy(), np.zeros_like(self.start)
        offers = np.stack([np.stack([self.pay(c, j, empty)[0] for j in range(self.size[1])], axis=1) for c in range(len(self.cards))])
        others = np.delete(offers, card, axis=0)
        loss = (others.max(axis=0) if len(others) else np.zeros(self.size, np.int64)) - offers[card]
        order = np.lexsort((-self.amounts, loss), axis=-1)
        running, line = self.spent(own, card), np.arange(len(own))
        for at in order.T:
            moves = (running < threshold) & (own[line, at] != card)
            own[line[moves], at[moves]] = card
            running = running + np.where(moves, self.amounts[line, at], 0)
        return own

    def allocate(self, passes: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The greedy totals, and the assignments and totals of the best of hill climbs from the greedy
        start and from one seed for each milestone."""
        base = self.greedy()
        naive = self.totals(base)
        own, total = self.climb(base, passes)
        for card, goals in enumerate(self.goals):
            for threshold, _ in goals:
                found, value = self.climb(self.milestone_seed(card, threshold, base), passes)
                better = value > total
                own[better], total[better] = found[better], value[better]
        return naive, own, total


    def subset_values(self, card: int, n: int) -> np.ndarray:
        """Rewards and grants of each set of the first n spends on one card, cycles by sets; bit i of a
        set's number is spend i. A set replays as its last spend after the set without it."""
        size = len(self.amounts)
        slot = {b: i for i, b in enumerate(self.buckets[card])}
        rewards, spent, used = np.zeros((size, 1), np.int64), np.zeros((size, 1), np.int64), self.start[:, None, self.buckets[card]]
        for j in range(n):
            rupees, open_, more = np.zeros_like(rewards), np.ones(rewards.shape, bool), used.copy()
            for place, unit, buckets in self.rules[card]:
                granted = np.broadcast_to(self.gross[:, j, place, None], rewards.shape)
                for b in buckets:
                    granted = np.minimum(granted, self.limits[b] - used[..., slot[b]])
                hit = open_ & (granted > 0)
                paid = granted if unit == "cashback" else (2 * granted * self.cards[card].point_value_paise + 100) // 200
                rupees, open_ = np.where(hit, paid, rupees), open_ & ~hit
                for b in buckets:
                    more[..., slot[b]] += np.where(hit, granted, 0)
            rewards, spent, used = (np.concatenate(v, axis=1) for v in ((rewards, rewards + rupees), (spent, spent + self.amounts[:, j, None]), (used, more)))
        return rewards + sum((np.where(spent >= threshold, grant, 0) for threshold, grant in self.goals[card]), np.zeros_like(rewards))

    def optima(self, n: int) -> np.ndarray:
        """The totals of the best of all assignments of the first n spends: the best partition into one
        set a card, card by card, over every set and its parts; of the last card over the whole alone."""
        out, step = np.empty(len(self.amounts), np.int64), max(1, SPLITS // 3**n)
        own, rest, starts = splits(n)
        for at in range(0, len(out), step):
            part = Cycles(self.cards, *(v[at : at + step] for v in (self.amounts, self.gross, self.start)))
            best = part.subset_values(0, n)
            for card in range(1, len(self.cards) - 1):
                best = np.maximum.reduceat(best[:, rest] + part.subset_values(card, n)[:, own], starts, axis=1)
            if len(self.cards) > 1:
                best = best[:, ::-1] + part.subset_values(len(self.cards) - 1, n)
                out[at : at + step] = best.max(axis=1)
            else:
                out[at : at + step] = best[:, -1]
        return out


#: Parts of sets that the exhaustive search values at once, a cycle at least.
SPLITS = 1 << 20


@lru_cache(maxsize=16)
def splits(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every (subset, rest) of every set of n, set by set, and where each set's begin: 3**n rows."""
    own = rest = np.zeros(1, np.int64)
    for i in range(n):
        own, rest = np.concatenate([own, own, own + (1 << i)]), np.concatenate([rest, rest + (1 << i), rest])
    order = np.argsort(own + rest, kind="stable")
    own, rest = own[order], rest[order]
    return own, rest, np.searchsorted(own + rest, np.arange(1 << n))


def stacked(cards: list[Card], first: np.ndarray, amounts: np.ndarray, gross: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Cycles]]:
    """Cycles that lie one behind another, ``first`` their first spends and the end, stacked with those
    of like length: their numbers, their rows (cycles by spends, -1 where filled up), and they."""
    length = np.diff(first)
    kind = -(-length // STEP)
    for own in (np.flatnonzero(kind == n) for n in np.unique(kind)):
        step = np.arange(length[own].max())
        rows = np.where(step < length[own, None], first[own, None] + step, -1)
        there = rows >= 0
        yield own, rows, Cycles(cards, np.where(there, amounts[rows], 0), np.where(there[..., None], gross[rows], 0), start[first[own]].copy())
