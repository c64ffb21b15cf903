"""Near duplicates and repeated windows against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import setsketch_dedup as S
from tallyspark.llm.substring_dedup import repeated_windows

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter()
    for own in holders.values():
        own = sorted(own)
        for k, a in enumerate(own):
            both.update((a, b) for b in own[k + 1 :])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), c in both.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_components_equal_brute_force(docs, corpus, n):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in S.near_duplicates(docs, n, 80).collect()}
    assert found == brute_components(corpus, n, 80)


def test_chains_and_large_groups(spark):
    """Groups of near copies larger than a block, whose members differ a little, and chains of links."""
    base = [f"a{i}" for i in range(60)]
    rows, at = [], 0
    for k in range(300):
        w = list(base)
        for j in range(3):
            w[(7 * k + 13 * j) % 60] = f"x{k}.{j}"
        rows.append((at, " ".join(w)))
        at += 1
    for k in range(120):
        rows.append((at, " ".join(f"c{i}" for i in range(k, k + 40))))
        at += 1
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in S.near_duplicates(frame(spark, rows), 2, 80, small=4, block=32).collect()}
    assert found == brute_components(rows, 2, 80)


def test_empty_null_and_repeated_ids(spark):
    assert S.near_duplicates(frame(spark, [])).count() == 0
    found = S.near_duplicates(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A B c d e f")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [(-1, -1), (3, 3), (3, 3), (9, 3)]


def test_rows_of_one_id_are_one_document(spark):
    """Two texts under one id join the components of both."""
    a, b, c = "a b c d e f", "u v w x y z", "k l m n o p"
    found = S.near_duplicates(frame(spark, [(3, a), (5, a), (5, b), (8, b), (9, c), (2, c), (7, "q r s t u v")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(3, 3), (5, 3), (8, 3), (9, 2), (2, 2), (7, 7)}


def test_components_take_logarithmic_rounds(spark):
    from tallyspark.llm.components import components

    n = 10_000
    mixed = np.random.default_rng(4).permutation(n).tolist()
    edges = list(zip(range(n - 1), range(1, n))) + [(n + x, n + y) for x, y in zip(mixed, mixed[1:])] + [(3 * n, 3 * n), (4 * n, 4 * n + 1), (4 * n + 1, 4 * n), (None, 5)]
    seen: list = []
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), seen).collect()}
    assert found == {i: 0 for i in range(n)} | {n + i: n for i in range(n)} | {4 * n: 4 * n, 4 * n + 1: 4 * n}
    assert len(seen) <= 20
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_patterned_words_do_not_collide(spark):
    """Words that cancel in any polynomial modulo 2**64 (Thue-Morse), in both operators."""
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    short, twin = one[:256], other[:256]
    for x, y in ((one, other), (short, twin)):
        hashes = S.kernels.words([x.encode(), y.encode()]).hashes
        assert hashes[0] != hashes[1]
    rows = [(1, f"{one} k l"), (2, f"{other} k l"), (3, "m n o"), (4, "m n o")]
    found = {r["doc_id"]: r["n_removed"] for r in repeated_windows(frame(spark, rows), 3).collect()}
    assert found == {1: 0, 2: 0, 3: 3, 4: 3}
    assert {r["doc_id"]: r["component_id"] for r in S.near_duplicates(frame(spark, [(1, one), (2, other)]), 2).collect()} == {1: 1, 2: 2}


def test_products_modulo_the_prime():
    import random

    K, rng = S.kernels, random.Random(1)
    a, b = ([rng.randrange(K.P61) for _ in range(500)] + [0, 1, K.P61 - 1] for _ in range(2))
    assert K.times61(np.array(a, np.uint64), np.array(b[::-1], np.uint64)).tolist() == [x * y % K.P61 for x, y in zip(a, b[::-1])]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        both = int(2000 * 2 * share / (1 + share))
        y = np.concatenate([x[:both], rng.integers(0, 1 << 63, 2000 - both, dtype=np.uint64)])
        a, b, u = S.sketch([np.unique(x), np.unique(y), np.unique(np.concatenate([x, y]))])
        assert (np.maximum(a, b) == u).all()
        above, below = int((a > b).sum()), int((a < b).sum())
        got = S.likeliest_similarity(np.array([S.REGISTERS - above - below]), np.array([above]), np.array([below]), np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(got - both / (4000 - both)) < 0.1


def brute_windows(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i if i is not None else -1, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [3, 35])
def test_windows_equal_brute_force(docs, corpus, window):
    found = repeated_windows(docs, window, chunk_bytes=1 << 18).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found) == brute_windows(corpus, window)


def test_windows_edges(spark):
    assert repeated_windows(frame(spark, []), 3).count() == 0
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "x x x x x"), (3, None), (4, "q a b c  r")]
    found = repeated_windows(frame(spark, rows), 3).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found) == brute_windows(rows, 3)
    kept = {r["doc_id"]: r["kept_text"] for r in repeated_windows(frame(spark, rows), 3, keep_spacing=True).filter("doc_id > 2").collect()}
    assert kept == {3: "", 4: "q   r"}
    with pytest.raises(ValueError):
        repeated_windows(frame(spark, rows), 0)
