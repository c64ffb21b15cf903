"""The gate of the fuzzy stage against the plain comparison of every pair."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyspark.operators import fuzzy, merchants
from tallyspark.sources.merchants import names


def edited(rng, text):
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(text) + 1)
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("ABZ 9é") + text[k:], text[:k] + text[k : k + 2][::-1] + text[k + 2 :]])
    return text


def candidates(rng, n):
    known = [name.upper() for *_, name in names()]
    made = [edited(rng, rng.choice(known)) for _ in range(n)] + ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ ") for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    return made + ["", " ", "A", "é", "日本", "AA" * 200, "swiggy", " Swiggy ", "\U0001f600", *known]


def plain(text):
    best = (-1, merchants.FUZZY)
    for k, (*_, name) in enumerate(names()):
        score = merchants.similarity(text, name)
        if score > best[1]:
            best = (k, score)
    return best


def test_closest_equals_the_plain_comparison(monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK", 100)
    index = fuzzy.NameIndex([name for *_, name in names()], merchants.FUZZY)
    own = candidates(random.Random(8), 400)
    best, score = index.closest(own)
    matched = 0
    for text, k, s in zip(own, best.tolist(), score.tolist()):
        want = plain(text)
        assert (k, s if k >= 0 else merchants.FUZZY) == want, text
        matched += k >= 0
    assert matched > 200 and index.compared < 0.1 * index.pairs == 0.1 * len(own) * len(names())


def test_jaro_of_pairs():
    rng = random.Random(2)
    pairs = [("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("A", "B"), ("A", "A")] + [("".join(rng.choice("AB C") for _ in range(rng.randrange(1, 12))), "".join(rng.choice("AB C") for _ in range(rng.randrange(1, 12)))) for _ in range(2000)]
    found = fuzzy.jaro(*fuzzy._codes([a for a, _ in pairs]), *fuzzy._codes([b for _, b in pairs]))
    assert found.tolist() == [merchants.jaro(a, b) for a, b in pairs]


def test_effort_is_reported(spark):
    own = candidates(random.Random(4), 300)
    row = merchants.fuzzy_effort(spark.createDataFrame([(x,) for x in own * 2] + [(None,)], "candidate string").repartition(3)).first()
    assert row["candidates"] == len(set(own)) and row["pairs"] == row["candidates"] * len(names()) and 0 < row["compared"] < 0.1 * row["pairs"]
    assert tuple(merchants.fuzzy_effort(spark.createDataFrame([], "candidate string")).first()) == (0, 0, 0)


@pytest.mark.parametrize("gate", [0.5, 0.7, 0.88, 0.95])
def test_bounds_never_lose_a_pair(gate):
    rng = random.Random(6)
    known = ["".join(rng.choice("ABC") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    index = fuzzy.NameIndex(known, gate)
    own = ["".join(rng.choice("ABCD") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    best, score = index.closest(own)
    for text, k, s in zip(own, best.tolist(), score.tolist()):
        every = np.array([merchants.similarity(text, x) for x in known])
        assert k == (every.argmax() if every.max() > gate else -1) and (k < 0 or s == every.max())
