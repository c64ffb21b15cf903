"""Bigram scores from a log-frequency Bloom filter.

Documents are dealt into chunks and hashes into ranges (parts). A chunk sends each part its distinct
words and bigrams with their training counts; a part adds them up over the corpus, turns the sums
into levels ``1 + floor(log_base(count))`` and sets, for each n-gram and each level up to its own,
``probes`` bits in its block of the filter. It answers every chunk with the exact counts of its
words and with the levels that the block shows for its words and bigrams. So neither a frequent
n-gram nor the vocabulary nor the filter ever meets in one place, and no size is fixed beforehand.

A level is read back by probing one after another until one fails or the block's greatest level is
reached, so it is never too low, and too high only by false positives. A block has ``level_bits``
bits for each level it holds and a few more, and grows until its share of set bits is at most what
these numbers let expect, 1 - exp(-probes / level_bits). That share holds for every block of every
corpus: with 16 probes and 48 bits 28 %, and 2e-9 of unseen n-grams read as seen once, at 30 GB as at
100 TB.

Model: ``p(w | h) = (q(h, w) + mu * u(w)) / (c(h) + mu + V * f)`` with ``u(w) = (q(w) + 1) / (N + V
+ 1)``, ``q`` the least count of the level that the filter shows, never above the count itself but
by false positives (nor above those of h and w), ``c`` exact, and ``f`` the count that a block shows
for an unseen bigram on average, from the share of set bits that no block exceeds: one number for the
whole corpus, so a score does not depend on how documents were dealt. The quantised counts of a history
sum to at most c(h), so the probabilities of all words after it sum to at most 1 and a score is never
above 0. The history of a text's first token is the end token.

Edge cases: a null or empty text has one token, the end; a null held_out counts as false; an empty
table gives an empty result; where nothing is held in, N = V = 0 and every probability is 1; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid, kernels

_U = np.uint64
_END = kernels.mix64(np.array([0xE5D], _U))[0]
_HISTORY = _U(0xA24BAED4963EE407)
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each ending in the end token, and where each text begins."""
    found = kernels.words(texts, lower=True)
    tokens = np.insert(found.hashes, found.first[1:], _END)
    return tokens, found.first + np.arange(len(found.first))


def _bigrams(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _END
    return kernels.mix64(before * _HISTORY + tokens)


def _distinct(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each key went, and how often (or with what weight) it came."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    where = np.empty(len(ranked), np.int64)
    where[order] = np.cumsum(new) - 1
    return ranked[new], where, np.bincount(where, weights, minlength=int(new.sum())).astype(np.int64)


class LogFrequencyBloom:
    """One block of a filter: the bits, the greatest level set, and the share of bits set."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, level_bits: int, base: float, probes: int):
        levels = self.level(counts, base)
        self.base, self.probes = base, probes
        self.n_bits = max(512, int(1.01 * level_bits * int(levels.sum())) // 8 * 8)
        self.top = int(levels.max(initial=0))
        while (flags := self._flags(keys, levels)).mean() > self.most_filled(level_bits, probes):
            self.n_bits += max(64, self.n_bits // 100 // 8 * 8)
        self.bits, self.filled = np.packbits(flags), float(flags.mean())

    def _flags(self, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
        flags, left = np.zeros(self.n_bits, bool), np.arange(len(keys))
        for level in range(1, self.top + 1):
            left = left[levels[left] >= level]
            for probe in range(self.probes):
                flags[self.position(keys[left], level, probe)] = True
        return flags

    @staticmethod
    def most_filled(level_bits: int, probes: int) -> float:
        """The share of its bits that a block sets at most."""
        return 1 - math.exp(-probes / level_bits)

    def position(self, keys: np.ndarray, level: int, probe: int) -> np.ndarray:
        spot = kernels.mix64(keys + _U((level * 64 + probe) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return ((spot >> _U(32)) * _U(self.n_bits) >> _U(32)).astype(np.int64)

    @staticmethod
    def level(counts: np.ndarray, base: float) -> np.ndarray:
        return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)

    @staticmethod
    def least(levels: np.ndarray, base: float) -> np.ndarray:
        """The least count of each level."""
        return np.where(levels == 0, 0.0, np.ceil(base ** (levels - 1.0) - 1e-6))

    @classmethod
    def false_count(cls, level_bits: int, base: float, probes: int) -> float:
        """What any block shows for an n-gram that was never seen, on average at most: all levels of a
        geometric series, as a block's greatest level may be any."""
        passed = cls.most_filled(level_bits, probes) ** probes
        if passed * base >= 1:
            raise ValueError("too few probes for such steep levels")
        return passed / (1 - passed * base)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level of each key before one fails."""
        levels = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level in range(1, self.top + 1):
            for probe in range(self.probes):
                at = self.position(keys[left], level, probe)
                left = left[(self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            levels[left] = level
            if not len(left):
                break
        return levels


def conditional(joint: np.ndarray, history: np.ndarray, unigram: np.ndarray, mu: float, false_mass: float | np.ndarray) -> np.ndarray:
    """p(w | h) of quantised counts of pairs, exact ones of histories, and unigram probabilities."""
    return (joint + mu * unigram) / (history + mu + false_mass)


def _id_bytes(table: pa.Table) -> tuple[list, list, list[bytes]]:
    ids, held = table["doc_id"].to_pylist(), table["held_out"].to_pylist()
    texts = kernels.binary_list(table["text"])
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [bool(held[i]) for i in order], [texts[i] for i in order]


def totals(rows: DataFrame, parts: int, chunk_bytes: int = grid.CHUNK_BYTES) -> tuple[int, int]:
    """Training tokens and distinct ones, of rows (text, held_out), by ranges of the hash space."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []

        def counted() -> pa.RecordBatch:
            tokens, _ = _tokens(texts)
            distinct = np.unique(tokens)
            full, edges = kernels.part_runs(distinct, parts)
            blobs = [kernels.to_planes(distinct[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            n = pa.array([len(tokens)] + [0] * (len(full) - 1), pa.int64())
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), n, pa.array(blobs, pa.binary())], names=["part", "tokens", "hashes"])

        size = 0
        for batch in batches:
            for text in kernels.binary_list(batch.column(0)):
                texts.append(text)
                size += len(text)
                if size >= chunk_bytes:
                    yield counted()
                    size = 0
        if texts:
            yield counted()

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        distinct = np.unique(np.concatenate([kernels.from_planes(x, _U) for x in table["hashes"].to_pylist()]))
        return pa.table({"tokens": pa.array([sum(table["tokens"].to_pylist())], pa.int64()), "words": pa.array([len(distinct)], pa.int64())})

    sent = rows.filter(~F.col("held_out")).select("text").mapInArrow(send, "part int, tokens long, hashes binary")
    found = sent.groupBy("part").applyInArrow(kernels.grouped(count), "tokens long, words long").agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    return found["n"] or 0, found["v"] or 0


def score_texts(docs: DataFrame, level_bits: int = 48, base: float = 1.5, probes: int = 16, mu: float = 50.0, chunk_bytes: int = grid.CHUNK_BYTES) -> DataFrame:
    """Scores of every text. ``docs``: doc_id, text, and held_out, which marks the rows nothing is
    learnt from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("held_out"), F.lit(False)).alias("held_out"))
    chunks = parts = grid.chunk_count(grid.text_bytes(rows), chunk_bytes)
    train_tokens, vocabulary = totals(rows, parts, chunk_bytes)
    chunked = grid.dealt(rows, chunks)
    false_mass = vocabulary * LogFrequencyBloom.false_count(level_bits, base, probes)

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, held, texts = _id_bytes(table)
        tokens, first = _tokens(texts)
        weights = np.repeat(~np.array(held, bool), np.diff(first))
        own = {kind: _distinct(keys, weights) for kind, keys in (("word", tokens), ("pair", _bigrams(tokens, first)))}
        runs = {kind: kernels.part_runs(distinct, parts) for kind, (distinct, *_) in own.items()}
        full = np.union1d(runs["word"][0], runs["pair"][0])
        sent = {"part": pa.array(full, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(full), pa.int32())}
        for kind, (distinct, _, counts) in own.items():
            counts, (named, edges) = counts.astype(np.uint32), runs[kind]
            run = dict(zip(named.tolist(), map(slice, edges[:-1], edges[1:])))
            cut = [run.get(p, slice(0, 0)) for p in full.tolist()]
            sent[f"{kind}_hashes"] = pa.array([kernels.to_planes(distinct[c]) for c in cut], pa.binary())
            sent[f"{kind}_counts"] = pa.array([kernels.to_planes(counts[c]) for c in cut], pa.binary())
        return pa.table(sent)

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = {}
        for kind in ("word", "pair"):
            hashes = [kernels.from_planes(x, _U) for x in table[f"{kind}_hashes"].to_pylist()]
            counts = [kernels.from_planes(x, np.uint32) for x in table[f"{kind}_counts"].to_pylist()]
            edges = np.cumsum([0] + [len(x) for x in hashes])
            found[kind] = (*_distinct(np.concatenate(hashes), np.concatenate(counts)), [slice(a, b) for a, b in zip(edges[:-1], edges[1:])])
        learnt = [(distinct[sums > 0], sums[sums > 0]) for distinct, _, sums, _ in found.values()]
        bloom = LogFrequencyBloom(np.concatenate([k for k, _ in learnt]), np.concatenate([n for _, n in learnt]), level_bits, base, probes)
        n = table.num_rows
        back = {
            "chunk": table["chunk"],
            "part": pa.array([key[0].as_py()] * n, pa.int32()),
        }
        for kind, (distinct, where, sums, cut) in found.items():
            if kind == "word":
                exact = sums[where]
                back["word_counts"] = pa.array([kernels.to_planes(exact[c]) for c in cut], pa.binary())
            levels = bloom.levels(distinct).astype(np.uint16)[where]
            back[f"{kind}_levels"] = pa.array([kernels.to_planes(levels[c]) for c in cut], pa.binary())
        return pa.table(back)

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held, texts = _id_bytes(left)
        tokens, first = _tokens(texts)
        distinct, where, _ = _distinct(tokens)
        pairs, pair_at, _ = _distinct(_bigrams(tokens, first))
        right = right.sort_by("part")

        def joined(column: str, dtype) -> np.ndarray:
            return np.concatenate([kernels.from_planes(x, dtype) for x in right[column].to_pylist()])

        exact, single, joint = joined("word_counts", np.int64), joined("word_levels", np.uint16), joined("pair_levels", np.uint16)
        assert len(exact) == len(single) == len(distinct) and len(joint) == len(pairs), "a chunk changed between its two readings"
        word_log, known = np.log10(exact + 1.0)[where], (exact > 0)[where]
        single = np.minimum(LogFrequencyBloom.least(single.astype(np.int64), base), exact)
        unigram = (single + 1.0) / (train_tokens + vocabulary + 1.0)
        joint = LogFrequencyBloom.least(joint.astype(np.int64), base)[pair_at]
        history = np.empty(len(tokens))
        history[1:] = exact[where[:-1]]
        history[first[:-1]] = exact[np.searchsorted(distinct, _END)]  # every text ends in the end token
        joint = np.minimum(joint, np.minimum(history, exact[where]))
        token_log = np.log10(np.minimum(conditional(joint, history, unigram[where], mu, false_mass), 1.0))
        at, n_tokens = first[:-1], np.diff(first)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()),
            "held_out": pa.array(held, pa.bool_()),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(np.add.reduceat(known.astype(np.int64), at), pa.int64()),
            "train_tokens": pa.array([train_tokens] * len(ids), pa.int64()),
            "base_score": pa.array(np.add.reduceat(word_log, at) - n_tokens * math.log10(train_tokens + vocabulary + 1), pa.float64()),
            "score": pa.array(np.add.reduceat(token_log, at), pa.float64()),
        })

    sent = chunked.groupBy("chunk").applyInArrow(kernels.grouped(send), "part int, chunk int, word_hashes binary, word_counts binary, pair_hashes binary, pair_counts binary")
    back = sent.groupBy("part").applyInArrow(kernels.grouped(answer), "chunk int, part int, word_counts binary, word_levels binary, pair_levels binary")
    return chunked.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(kernels.cogrouped(score), _OUT)
