"""Encoding, packing, fingerprints and language-model scores against plain Python."""

from __future__ import annotations

import base64
import binascii
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import bloom_lm, bottomk, packing
from tallyspark.llm.monoid_bpe import MonoidEncoder, digests, encode_documents, encoder
from tallyspark.llm.queries import op10_lm_scores

from .conftest import frame
from .test_dedup import WORD, shingles

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def plain():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(docs, corpus):
    own = plain()
    want = {}
    for i, t in corpus:
        ids = own.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    found = digests(encode_documents(docs, RANKS, public_tokenizers.PATTERN, leaf=64)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found} == want


def test_tree_on_hostile_text():
    tree, own, rng = MonoidEncoder(encoder(RANKS, public_tokenizers.PATTERN), leaf=8), plain(), random.Random(3)
    pieces = [" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "'s", "'ll", "a", "the", "9", "123", "!!", "é", "日本", "\U0001f600", "A" * 30, "<|endoftext|>"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(120)))
        ids = tree.encode(text)
        assert ids == own.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


def test_encoding_an_empty_table(spark):
    assert digests(encode_documents(frame(spark, []), RANKS, public_tokenizers.PATTERN)).count() == 0


def test_pieces_and_places(docs, corpus):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    top = max(i for i, _ in corpus) + 1
    corpus = corpus + [(top, "<|endoftext|>"), (top + 1, "x<|endoftext|> y" * 900)]
    want, total = {}, 0
    for i, t in corpus:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        head = len(ids) % 2048 or 2048
        edges = [0, *range(head, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k] = (a, b - a, binascii.crc32(np.array(ids[a:b], "<u4").tobytes()))
    found = packing.pack(frame(docs.sparkSession, corpus), VOCABULARY, public_tokenizers.PATTERN).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == math.ceil(total / 2048)


def test_added_tokens_are_single_ids(spark):
    tokenizer, rng = Tokenizer.from_file(VOCABULARY), random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "a", " word", "'s", "12", "é", "日本", "\u00a0"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]
    want = {}
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want[i] = (len(ids), binascii.crc32(np.array(ids, "<u4").tobytes()))
    assert want[0] == (5, binascii.crc32(np.array([64, 220, 50256, 275, 0], "<u4").tobytes()))
    found = packing.encode_pieces(frame(spark, list(enumerate(texts))), VOCABULARY, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in found} == want


def test_configurations_hold_every_histogram():
    rng = random.Random(8)
    for _ in range(30):
        histogram = {rng.randint(1, 100): rng.randint(1, 400) for _ in range(rng.randint(1, 25))}
        used = packing.solve_configurations(histogram, 100).used
        held = Counter()
        for config, n in used.items():
            assert sum(s * k for s, k in config) <= 100
            for s, k in config:
                held[s] += k * n
        assert held == Counter(histogram)


def test_program_reaches_the_lower_bound_where_best_fit_does():
    """Lengths drawn as texts have them, and two hard kinds, against best fit decreasing."""
    import bisect

    rng = np.random.default_rng(3)
    for lengths in (rng.lognormal(6, 1, 3000).astype(int) % 2048 + 1, rng.integers(300, 1000, 2000), rng.integers(600, 760, 900)):
        bins: list[int] = []
        for s in sorted(lengths.tolist(), reverse=True):
            i = bisect.bisect_left(bins, s)
            bisect.insort(bins, (bins.pop(i) if i < len(bins) else 2048) - s)
        assert packing.solve_configurations(Counter(lengths.tolist())).sequences <= len(bins) * 1.01 + 1


def price_of(config, prices):
    return sum(prices[s] * k for s, k in config)


def test_the_dual_prices_bound_every_cover():
    """No filling of a sequence costs more than 1, by plain enumeration, so no cover is smaller."""
    rng = random.Random(11)
    for _ in range(20):
        histogram = {rng.randint(8, 40): rng.randint(1, 30) for _ in range(rng.randint(1, 6))}
        program = packing.solve_configurations(histogram, 60)
        fillings = [()]
        for s, n in histogram.items():
            fillings = [(*f, (s, k)) for f in fillings for k in range(n + 1) if sum(a * b for a, b in f) + s * k <= 60]
        assert all(price_of(f, program.prices) <= 1 + 1e-9 for f in fillings)
        assert program.bound == pytest.approx(sum(program.prices[s] * n for s, n in histogram.items())) and program.bound <= program.sequences * (1 + 1e-9)


def test_weights_close_the_gap_that_fixed_prices_leave():
    """The cover is within one per cent of the dual bound; prices that stay do not come
    within one and a half."""
    histogram = Counter(np.random.default_rng(3).integers(300, 1000, 2000).tolist())
    program, fixed = packing.solve_configurations(histogram), packing.solve_configurations(histogram, rate=0.0)
    assert program.gap < 1.01 < 1.015 < fixed.gap and program.sequences < fixed.sequences
    held = Counter()
    for config, n in program.used.items():
        for s, k in config:
            held[s] += k * n
    assert held == histogram  # every length is covered once, none more


def test_a_large_histogram_is_solved_as_well():
    histogram = Counter((np.random.default_rng(4).lognormal(6, 1, 3000).astype(int) % 2048 + 1).tolist())
    assert packing.solve_configurations({s: 1000 * n for s, n in histogram.items()}).gap < 1.001


def test_packing_repeated_rows(spark):
    found = packing.pack(frame(spark, [(4, "a b c")] * 5 + [(None, None)] * 2), VOCABULARY, public_tokenizers.PATTERN).collect()
    assert len(found) == 7 and len({(r["sequence_id"], r["offset"]) for r in found}) == 7 and len({r["sequence_id"] for r in found}) == 1


def test_packing_an_empty_table(spark):
    assert packing.pack(frame(spark, []), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_fingerprints(docs, corpus):
    rows = sorted(corpus)
    found = {r["doc_id"]: r for r in bottomk.fingerprints(docs).collect()}
    assert len(found) == len(rows)
    by_text, off = {}, []
    jaccard = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    plain_sets = {t: {tuple(x) for x in cased(t)} for t in {t or "" for _, t in rows}}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after, r = t or "", after or "", found[i]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for text, mark in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert by_text.setdefault(text, mark) == mark
        off += [abs(r["near_edited"] - jaccard(plain_sets[t], cased(edited))), abs(r["near_next"] - jaccard(plain_sets[t], plain_sets[after]))]
    assert np.mean(off) < 0.03 and max(off) < 0.25


def test_fingerprint_order_and_edges(spark):
    """Null, repeated and outlying ids, a single row and an empty table; ranges far smaller than the rows."""
    assert bottomk.fingerprints(frame(spark, [])).count() == 0
    one = bottomk.fingerprints(frame(spark, [(3, "a b c d")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b c a").hexdigest()
    for rows in (
        [(9 * 10**18, "out of the way")] + [(i, f"t{i} " * 20) for i in range(300)],
        [(7, f"t{i} " * 20) for i in range(200)] + [(i, f"u{i} " * 20) for i in range(100)] + [(None, f"n{i} " * 20) for i in range(150)],
        [(5, "same text")] * 40 + [(6, None)],
    ):
        got = bottomk.with_next(frame(spark, rows), range_bytes=200).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t or "") for i, t in rows)
        texts: dict = {}
        for i, t in rows:
            texts.setdefault(i, Counter())[t or ""] += 1
        order = sorted(texts, key=lambda i: (i is None, i or 0))
        for here, after in zip(order, order[1:] + order[:1]):
            ahead = Counter(r["next_text"] for r in got if r["doc_id"] == here) - texts[here]
            # all but one text of an id are followed by another of it, one by a text of the next id
            assert sum(ahead.values()) <= 1 and set(ahead) <= set(texts[after])


def test_sketches_merge_over_parts(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i * i % 1009}" for i in range(3000))
    row = spark.createDataFrame([(text,)], "t string").select(*(bottomk.sketch(F.col("t"), part=p).alias(f"p{p}") for p in (7, 500, 10_000))).first()
    assert row["p7"] == row["p500"] == row["p10000"]


def cased(text, n=5):
    w = WORD.findall(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    rng.shuffle(words)
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(bottomk.sketch(F.col("a")).alias("x"), bottomk.sketch(F.col("b")).alias("y"))
    row = row.select(bottomk.resemblance(F.col("x"), F.col("y")).alias("r"), bottomk.containment(F.col("x"), F.col("y")).alias("c"), bottomk.distinct_count(F.col("x")).alias("n"), bottomk.distinct_count(bottomk.merge(F.col("x"), F.col("y"))).alias("u")).first()
    assert abs(row["r"] - 1 / 3) < 0.15 and abs(row["c"] - 1 / 2) < 0.2 and abs(row["n"] / 1996 - 1) < 0.3 and abs(row["u"] / 2996 - 1) < 0.3


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*WORD.findall(low), None]


def brute_scores(rows, held, base=1.5, mu=50.0):
    counts, pairs = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            own = tokens(t)
            counts.update(own)
            pairs.update(zip([None, *own], own))
    n, v = sum(counts.values()), len(counts)

    def q(c):
        level = 1 + math.floor(math.log(c) / math.log(base) + 1e-9) if c else 0
        return float(math.ceil(base ** (level - 1) - 1e-6)) if level else 0.0

    out = {}
    for i, t in rows:
        own = tokens(t)
        exact = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        model = 0.0
        for h, w in zip([None, *own], own):
            u = (q(counts[w]) + 1) / (n + v + 1)
            model += math.log10((q(pairs[h, w]) + mu * u) / (counts[h] + mu))
        out[i] = (held[i], len(own), sum(counts[w] > 0 for w in own), n, exact, model)
    return out


def test_scores(docs, corpus):
    from pyspark.sql import functions as F

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in corpus}
    marked = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    found = bloom_lm.score_texts(marked, chunk_bytes=1 << 18).collect()
    want = brute_scores(corpus, held)
    assert len(found) == len(want)
    near = []
    for r in found:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9, abs_tol=1e-6)
        near.append(abs(r["score"] - w[5]) / w[1])
        assert r["score"] <= 0
    assert max(near) < 1e-6
    assert sum(r["score"] for r in found if not r["held_out"]) > sum(r["base_score"] for r in found if not r["held_out"])


def test_score_query_and_empty_table(spark, sf):
    from pyspark.sql import functions as F

    assert op10_lm_scores(spark, sf).filter("score is null or score > 0").count() == 0
    assert bloom_lm.score_texts(frame(spark, []).withColumn("held_out", F.lit(False))).count() == 0
    only = bloom_lm.score_texts(frame(spark, [(1, "a b"), (2, None)]).withColumn("held_out", F.lit(True))).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in only) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    counts = rng.geometric(0.05, len(keys))
    for level_bits, probes in ((48, 16), (8, 3)):
        read = bloom_lm.LogFrequencyBloom(keys, counts, level_bits, 1.5, probes).levels(keys)
        true = bloom_lm.LogFrequencyBloom.level(counts, 1.5)
        assert (read >= true).all() and (bloom_lm.LogFrequencyBloom.least(true, 1.5) <= counts).all()
        assert (read == true).all() or probes == 3


def test_filter_grows_with_its_keys():
    rng = np.random.default_rng(1)
    for n in (1_000, 64_000, 1_000_000):
        keys = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        seen = rng.random(len(keys)) < 0.5
        bloom = bloom_lm.LogFrequencyBloom(keys[seen], rng.geometric(0.7, int(seen.sum())), 24, 1.5, 4)
        assert (bloom.levels(keys[seen]) > 0).all()
        read = float((bloom.levels(keys[~seen]) > 0).mean())
        assert read < 0.002 and bloom.false_count(24, 1.5, 4) < 0.002 and bloom.filled < 0.16
    assert bloom_lm.LogFrequencyBloom(keys[seen], np.ones(int(seen.sum()), np.int64), 48, 1.5, 16).levels(keys[~seen]).sum() == 0


def test_model_mass_is_at_most_one(corpus):
    """Over the whole vocabulary and one unknown word, after frequent, rare and unseen histories."""
    counts, pairs = Counter(), Counter()
    for _, t in corpus:
        own = tokens(t)
        counts.update(own)
        pairs.update(zip([None, *own], own))
    vocabulary = list(counts)
    hashes = dict(zip(vocabulary, np.random.default_rng(5).integers(0, 1 << 63, (len(vocabulary), 1), dtype=np.uint64)))
    joint = lambda h, w: bloom_lm.kernels.mix64(hashes[h] * bloom_lm._HISTORY + w)
    keys = np.concatenate([joint(h, hashes[w]) for h, w in pairs])
    bloom = bloom_lm.LogFrequencyBloom(keys, np.array(list(pairs.values())), 48, 1.5, 16)
    n, v, every = sum(counts.values()), len(counts), np.concatenate([hashes[w] for w in vocabulary])
    exact = np.array([counts[w] for w in vocabulary], float)
    unigram = (bloom_lm.LogFrequencyBloom.least(bloom_lm.LogFrequencyBloom.level(exact, 1.5), 1.5) + 1) / (n + v + 1)
    ranked = [w for w, _ in counts.most_common()]
    for h in ranked[:20] + ranked[-20:]:
        q = np.minimum(bloom_lm.LogFrequencyBloom.least(bloom.levels(joint(h, every)), 1.5), np.minimum(exact, counts[h]))
        mass = bloom_lm.conditional(q, counts[h], unigram, 50.0, v * bloom_lm.LogFrequencyBloom.false_count(48, 1.5, 16)).sum() + 50 / (n + v + 1) / (counts[h] + 50)
        assert 0 < mass <= 1 + 1e-9


def test_scores_do_not_depend_on_the_deal(spark, corpus):
    """The same to the last bit for chunks of any size, one that misses most parts included."""
    rows = [(i, t) for i, t in corpus if len(t or "") < 3_000][:60] + [(10**6, "one"), (10**6 + 1, None)]
    docs = frame(spark, rows).withColumn("held_out", F.col("doc_id") % 7 == 2)
    scores = [{r["doc_id"]: (r["score"], r["base_score"]) for r in bloom_lm.score_texts(docs, chunk_bytes=n).collect()} for n in (2048, 64 << 10, 8 << 20)]
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == len(rows)


def test_no_block_sets_more_bits_than_the_bound():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 40, 300, 5000):
        bloom = bloom_lm.LogFrequencyBloom(rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.zipf(1.6, n).astype(np.int64) % 10_000 + 1, 48, 1.5, 16)
        assert bloom.filled <= bloom.most_filled(48, 16)
        unseen = bloom.levels(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
        assert bloom_lm.LogFrequencyBloom.least(unseen, 1.5).mean() <= 1e-3
    loose = bloom_lm.LogFrequencyBloom(rng.integers(0, 1 << 63, 3000, dtype=np.uint64), np.ones(3000, np.int64), 4, 1.5, 2)
    seen = bloom_lm.LogFrequencyBloom.least(loose.levels(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)), 1.5).mean()
    assert seen <= loose.false_count(4, 1.5, 2) * 1.02


def test_empty_training_texts_score_below_one(spark):
    from pyspark.sql import functions as F

    found = bloom_lm.score_texts(frame(spark, [(i, None) for i in range(1000)]).withColumn("held_out", F.lit(None).cast("boolean"))).collect()
    assert len(found) == 1000 and all(r["score"] <= 0 and r["train_tokens"] == 1000 and r["held_out"] is False for r in found)


def test_scores_fix_no_size_and_keep_nothing_in_the_driver(docs, monkeypatch):
    """No part of the model may have a bound of its own or be broadcast or brought to the driver."""
    import inspect

    from pyspark import SparkContext
    from pyspark.sql import functions as F

    def refuse(*_):
        raise AssertionError("the model meets in the driver")

    assert "filter_bytes" not in inspect.signature(bloom_lm.score_texts).parameters
    monkeypatch.setattr(SparkContext, "broadcast", refuse)
    monkeypatch.setattr(type(docs), "toLocalIterator", refuse)
    assert bloom_lm.score_texts(docs.withColumn("held_out", F.lit(False)), chunk_bytes=1 << 20).count() == docs.count()


def test_shingles_helper_is_lower_case():
    assert shingles("A b", 2) == {("a", "b")}
