"""At which amount another card becomes the best one.

What a card pays is piecewise linear in the amount: the first matching rule's rate until its buckets
are full, level beyond, and other rules past an ``amount_gte``. Spark evaluates a row's predicates and
headrooms once, per band between those thresholds; a batch of such curves is then valued in numpy,
all rows at once. Between two neighbouring breakpoints (thresholds, and the amounts at which a rising
curve passes a level one) no card overtakes another, so the first change of the winner lies on one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.predicates import compile_predicate
from tallyspark.operators.rewards import exclusion, headroom
from tallyspark.sources.cards import Card, Predicate

_NO_CAP = 1 << 62


def _thresholds(p: Predicate) -> Iterator[int]:
    if p.op == "amount_gte":
        yield p.args[0]
    elif p.op in ("all", "any", "not"):
        for x in p.args:
            yield from _thresholds(x)


def bands(cards: list[Card]) -> list[int]:
    """Where the amounts begin for which the same rules match, from 0."""
    return sorted({0, *(t for c in cards for r in c.rules for t in _thresholds(r.when) if t > 0)})


def _rounded(x: np.ndarray) -> np.ndarray:
    """Half up, of doubles that are not negative."""
    down = np.floor(x)
    return (down + (x - down >= 0.5)).astype(np.int64)


class Curves:
    """The rewards of some spends on all cards as functions of the amount."""

    def __init__(self, cards: list[Card], matches: np.ndarray, rooms: np.ndarray):
        """``matches``: for each spend, every card's rules in every band; ``rooms``: those rules' headroom."""
        self.rules = [(k, c, r) for k, c in enumerate(cards) for r in c.rules]
        self.edges = np.array(bands(cards), np.int64)
        self.matches = matches.reshape(len(matches), len(self.rules), len(self.edges))
        self.rooms = rooms.reshape(len(rooms), len(self.rules))
        self.n_cards = len(cards)

    def _paid(self, at: int, amount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the rule numbered ``at`` grants, and that in rupees."""
        _, card, rule = self.rules[at]
        granted = np.minimum(_rounded(amount * rule.rate), self.rooms[:, at])
        return granted, granted if rule.unit == "cashback" else _rounded(granted * card.point_value_paise / 100.0)

    def winner(self, amount: np.ndarray) -> np.ndarray:
        """The card that pays most for each spend at its amount, the first of equals; -1 where none pays."""
        line, band = np.arange(len(amount)), np.searchsorted(self.edges, amount, "right") - 1
        paid = np.zeros((self.n_cards, len(amount)), np.int64)
        open_ = np.ones_like(paid, bool)
        for at, (card, _, _) in enumerate(self.rules):
            granted, rupees = self._paid(at, amount)
            takes = open_[card] & self.matches[line, at, band] & (granted > 0)
            paid[card] = np.where(takes, rupees, paid[card])
            open_[card] &= ~takes
        return np.where(paid.max(axis=0, initial=0) > 0, paid.argmax(axis=0), -1)

    def searched(self, start: np.ndarray, most: int) -> np.ndarray:
        """The amount reported for a flip, 0 for none: amounts double until the winner is another, then
        halve the step between the last two until it is a rupee. Flips undone between doublings pass."""
        first = self.winner(start)
        low, high = start.copy(), 2 * start + 100
        while (on := (first >= 0) & (high <= most)).any() and (on := on & (self.winner(np.where(on, high, start)) == first)).any():
            low, high = np.where(on, high, low), np.where(on, 2 * high, high)
        found = (first >= 0) & (high <= most)
        while (on := found & (low + 100 < high)).any():
            middle = low + (high - low) // 2
            same = self.winner(middle) == first
            low, high = np.where(on & same, middle, low), np.where(on & ~same, middle, high)
        return np.where(found, high, 0)

    def first_change(self, start: np.ndarray, most: int) -> np.ndarray:
        """The smallest amount above the spend's, up to ``most``, at a breakpoint with another winner; 0
        for none. Two rising curves whose rates are all but equal may change places by rounding in
        between; such changes of a paisa are none."""
        first, best = self.winner(start), np.full(len(start), _NO_CAP)
        points = [np.full(len(start), e) for e in self.edges]
        for at, (card, _, _) in enumerate(self.rules):
            level = self._paid(at, np.full(len(start), most))[1]
            for _, other, rule in self.rules:
                if other.id == self.rules[at][1].id or rule.rate <= 0:
                    continue
                worth = rule.rate if rule.unit == "cashback" else rule.rate * other.point_value_paise / 100.0
                if worth > 0:  # around where the other rule reaches and passes this level, however units round
                    spread = 1 + math.ceil((1.0 + (other.point_value_paise / 100.0 if rule.unit != "cashback" else 0.0)) / worth)
                    points.append((np.floor(level / worth).astype(np.int64), spread))
        for point in points:
            if isinstance(point, tuple):
                point = self._passed(first, *point, most)
            here = (point > start) & (point <= most) & (point < best)
            changed = here & (self.winner(np.where(here, point, start)) != first)
            best = np.where(changed, point, best)
        return np.where((first >= 0) & (best < _NO_CAP), best, 0)

    def _passed(self, first: np.ndarray, near: np.ndarray, spread: int, most: int) -> np.ndarray:
        """The smallest amount within ``spread`` of ``near`` from which on the winner is not ``first``."""
        low, high = np.clip(near - spread, 0, most), np.clip(near + spread, 0, most)
        while (on := low + 1 < high).any():
            middle = (low + high) // 2
            same = self.winner(middle) == first
            low, high = np.where(on & same, middle, low), np.where(on & ~same, middle, high)
        return high


def _curves(cards: list[Card], states: dict[str, Column]) -> tuple[Column, Column]:
    matches, rooms = [], []
    for card in cards:
        open_ = exclusion(card).isNull()
        for rule in card.rules:
            matches += [open_ & compile_predicate(rule.when, F.lit(e)) for e in bands(cards)]
            own = [headroom(card, b, states.get(card.id)) for b in rule.consumes if card.bucket(b)]
            rooms.append((F.least(*own) if len(own) > 1 else own[0] if own else F.lit(_NO_CAP)).cast("bigint"))
    return F.array(*matches).cast("array<boolean>"), F.array(*rooms).cast("array<bigint>")


def recommendation_flip(cards: list[Card], states: dict[str, Column] | None = None, max_paise: int = 50_000_000) -> Column:
    """struct<flip_paise, changes_at_paise> for the row's spend, null where nothing pays or the winner
    stays up to ``max_paise``. flip_paise: where doubling the amount and halving the step to one rupee
    finds another winner; changes_at_paise: the very paisa at which it changes first."""

    @F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("flip_paise", "changes_at_paise")]))
    def flips(amount: pd.Series, matches: pd.Series, rooms: pd.Series) -> pd.DataFrame:
        start = amount.fillna(0).to_numpy(np.int64)
        width = sum(len(c.rules) for c in cards)
        stacked = lambda s, t, n: np.stack(s.to_list()).astype(t) if len(s) and n else np.zeros((len(s), n), t)
        curves = Curves(cards, stacked(matches, bool, width * len(bands(cards))), stacked(rooms, np.int64, width))
        found = {"flip_paise": curves.searched(start, max_paise), "changes_at_paise": curves.first_change(start, max_paise)}
        return pd.DataFrame({k: pd.Series(v, dtype="Int64").mask(v == 0) for k, v in found.items()})

    return flips(F.col("amount_paise").cast("bigint"), *_curves(cards, states or {}))
