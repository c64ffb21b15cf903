"""The closest name of a catalogue, for a batch of candidates at once.

A score is the greater of Jaro and trigram similarity, and only one above a gate counts. Trigram
similarity comes from an inverted index: the trigrams of a candidate name the few entries that share
any. Jaro is computed only where it can pass: its matches are at most the letters that both have, so
lengths alone, and then counts of letters, prove of nearly all pairs that they stay below the gate.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np

#: Candidates looked at together.
BLOCK = 2048
_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def grams(text: str) -> set[str]:
    padded = f"  {text.strip()} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in rows, and lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(size.max(initial=0))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(texts), width), np.uint32)
    out[np.arange(width) < size[:, None]] = flat
    return out, size


def jaro(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaro similarity of pairs of texts of at least one code point, half transpositions kept as halves."""
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    place = np.arange(b.shape[1])
    free, taken = place < m[:, None], np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        near = free & (np.abs(place - i) <= reach[:, None]) & (b == a[:, i : i + 1]) & (i < n)[:, None]
        hit, at = near.any(axis=1), near.argmax(axis=1)
        taken[:, i] = hit
        free[hit, at[hit]] = False
    used = ~free & (place < m[:, None])
    count = taken.sum(axis=1)
    # the matched letters of both sides, in order, at the front
    left, right = (np.take_along_axis(np.where(held, x, 0), np.argsort(~held, axis=1, kind="stable"), axis=1) for held, x in ((taken, a), (used, b)))
    width = min(left.shape[1], right.shape[1])
    off = (left[:, :width] != right[:, :width]).sum(axis=1)
    some = np.maximum(count, 1)
    found = (count / n + count / m + (count - off / 2) / some) / 3
    return np.where(count > 0, found, 0.0)


class NameIndex:
    """Names in order; of equal scores the first counts."""

    def __init__(self, names: Sequence[str], gate: float):
        self.gate, self.names = gate, [x.upper().strip() for x in names]
        self.codes, self.size = _codes(self.names)
        self.letters = {c: k for k, c in enumerate(sorted({c for x in self.names for c in x}))}
        self.bags = self._bag(self.names)
        own = [grams(x) for x in self.names]
        self.gram_count = np.array([len(g) for g in own], np.int64)
        holders: defaultdict[str, list[int]] = defaultdict(list)
        for k, g in enumerate(own):
            for x in g:
                holders[x].append(k)
        self.holders = {x: np.array(v, np.int64) for x, v in holders.items()}
        self.pairs = self.compared = 0

    def _bag(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.letters)), np.int16)
        at = [(k, self.letters[c]) for k, x in enumerate(texts) for c in x if c in self.letters]
        if at:
            np.add.at(out, tuple(np.array(at).T), 1)
        return out

    def _trigram(self, texts: Sequence[str]) -> np.ndarray:
        """Trigram similarities, candidates by names."""
        score, n = np.zeros((len(texts), len(self.names))), len(self.names)
        own = [grams(x) for x in texts]
        found = [(k, self.holders[g]) for k, gs in enumerate(own) for g in gs if g in self.holders]
        if found:
            flat = np.concatenate([k * n + h for k, h in found])
            both = np.bincount(flat, minlength=len(texts) * n).reshape(len(texts), n)
            size = np.array([len(g) for g in own])[:, None] + self.gram_count
            score = both / (size - both)
        return score

    def _passing(self, texts: Sequence[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose Jaro similarity may lie above the gate."""
        short, long = np.minimum(size[:, None], self.size), np.maximum(size[:, None], self.size)
        limit = self.gate - 1e-9
        own, name = np.nonzero((short > 0) & ((short / np.maximum(long, 1) + 2) / 3 > limit))
        if not len(own):
            return _NOTHING
        shared = np.minimum(self._bag(texts)[own], self.bags[name]).sum(axis=1)
        stay = (shared / size[own] + shared / self.size[name] + 1) / 3 > limit
        return own[stay], name[stay]

    def closest(self, candidates: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each candidate's best name, -1 where none passes the gate, and its score."""
        best, score = np.full(len(candidates), -1, np.int64), np.zeros(len(candidates))
        for k in range(0, len(candidates), BLOCK):
            texts = [x.upper().strip() for x in candidates[k : k + BLOCK]]
            codes, size = _codes(texts)
            value = self._trigram(texts)
            own, name = self._passing(texts, size)
            if len(own):
                value[own, name] = np.maximum(value[own, name], jaro(codes[own], size[own], self.codes[name], self.size[name]))
            top = value.argmax(axis=1)
            value = value[np.arange(len(texts)), top]
            best[k : k + BLOCK], score[k : k + BLOCK] = np.where(value > self.gate, top, -1), value
            self.pairs += len(texts) * len(self.names)
            self.compared += len(own)
        return best, score
