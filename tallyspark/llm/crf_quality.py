"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is good or bad. Its features are byte-class shares, lengths and repetition,
each for the line itself, the one before and the one after; two states and a transition matrix make
the chain. Forward-backward gives each line's marginal, and their average, weighted by line length,
is the document's score. Lines inherit their document's label for training, which is done on the
driver from the features of at most ``per_label`` documents a label (drawn by a hash of the id) and
at most ``per_document`` lines running of each, from a place that the hash draws; features are those
of the whole text. So what is collected has a bound, 62 MB of float32 with the defaults, whatever the
corpus and its texts. Labels, language, source and id never enter a score, nor does what a text is
batched with.

Edge cases: a null or empty text, or one of blank lines only (white space is 0x20 and 0x09-0x0D),
scores ``prior`` (0.5: no evidence); with labels of one kind only, or none, every score is that
kind's (1 or 0) or the prior; repeated rows score alike; of rows that share a sampled id the smallest
text is learnt from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels

#: Bounds of what training collects: documents a label, and lines of each.
PER_LABEL, PER_DOCUMENT = 2000, 64


def _classes() -> np.ndarray:
    marks = np.zeros((256, 13), bool)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:", b"!?", b"#$%&*@^~", b"|", b"/\\_<>={}[]()", b"\"'-`+")):
        marks[list(chars), k] = True
    marks[0x80:0xC0, 10] = True
    marks[0xC0:, 11] = True
    marks[:32, 12] = True
    return marks


_CLASSES = _classes()
_OWN = _CLASSES.shape[1] + 7
WIDTH = 3 * _OWN + 1


@dataclass
class Lines:
    features: np.ndarray  # one row a non-blank line
    weight: np.ndarray  # bytes
    first: np.ndarray  # each document's first line, and the total


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > kernels.PASS_BYTES:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def line_features(texts: list[bytes]) -> Lines:
    parts = [_line_features(b) for b in _blocks(texts)] or [Lines(np.zeros((0, WIDTH), np.float32), np.zeros(0), np.zeros(1, np.int64))]
    shift = np.cumsum([0] + [p.first[-1] for p in parts])
    return Lines(np.concatenate([p.features for p in parts]), np.concatenate([p.weight for p in parts]), np.concatenate([p.first[:-1] + s for p, s in zip(parts, shift)] + [shift[-1:]]))


def _line_features(texts: list[bytes]) -> Lines:
    buffer = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(buffer, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    counts = np.empty((len(starts), _CLASSES.shape[1]))
    for k in range(_CLASSES.shape[1]):
        counts[:, k] = np.add.reduceat(_CLASSES[:, k][raw].astype(np.int32), starts)
    counts[:, 12] -= 1  # the line feed itself
    length = ends - starts
    # a line is kept where a word (kernels' own white space) lies in it
    kept = np.flatnonzero(np.add.reduceat((~kernels.SPACE[raw]).astype(np.int32), starts))
    first = np.searchsorted(starts[kept], offsets)
    found = kernels.words([buffer])
    word_line = np.searchsorted(starts[kept], found.start, side="right") - 1
    n = len(kept)
    n_words = np.bincount(word_line, minlength=n)[:n] if n else np.zeros(0)
    document = np.repeat(np.arange(len(texts)), np.diff(first))
    seen = _distinct_before(found.hashes, document[word_line]) if n else np.zeros(0)
    repeats = np.bincount(word_line, seen, minlength=n)[:n] if n else np.zeros(0)
    line_hash = np.zeros(n, np.uint64)
    np.add.at(line_hash, word_line, found.hashes)
    again = _distinct_before(line_hash, document)
    size = np.maximum(length[kept], 1)
    last = raw[np.maximum(ends[kept] - 1, 0)]
    head = raw[starts[kept]]
    own = np.empty((n, _OWN), np.float32)
    own[:, : _CLASSES.shape[1]] = counts[kept] / size[:, None]
    own[:, -7] = np.log1p(size)
    own[:, -6] = np.log1p(n_words)
    own[:, -5] = size / np.maximum(n_words, 1) / 10
    own[:, -4] = repeats / np.maximum(n_words, 1)
    own[:, -3] = again
    own[:, -2] = (last == 46) | (last == 33) | (last == 63)
    own[:, -1] = ((head >= 65) & (head <= 90)) | (head >= 0xC0)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1][first[:-1] < n]] = 0
    edge = first[1:][first[1:] > 0] - 1
    after[edge] = 0
    return Lines(np.concatenate([own, before, after, np.ones((n, 1), np.float32)], axis=1), size.astype(np.float64), first)


def _distinct_before(keys: np.ndarray, document: np.ndarray) -> np.ndarray:
    """1 where the same key came earlier in the same document."""
    order = np.lexsort((np.arange(len(keys)), keys, document))
    k, d = keys[order], document[order]
    again = np.zeros(len(keys))
    again[order[1:]] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return again


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray  # log potentials, from row to column; state 1 is good
    prior: float = 0.5

    def potentials(self, features: np.ndarray) -> np.ndarray:
        # summed row by row, so that a line's potential does not depend on what it is computed with
        return (np.clip((features - self.mean) / self.scale, -8, 8) * self.weights).sum(axis=1)


def _times(rows: np.ndarray, step: np.ndarray) -> np.ndarray:
    """``rows @ step`` for two states, by sums that are the same for a row in any company."""
    return rows[:, :1] * step[0] + rows[:, 1:] * step[1]


def forward_backward(unary: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line good) for every line, and the expected transition counts. ``unary`` is the log
    potential of good against bad; all chains advance together, one line a step."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, size = first[:-1][order], counts[order]
    alive = np.searchsorted(-size, -np.arange(size.max() if len(size) else 0), side="left")
    step = np.exp(transitions)
    good = 1 / (1 + np.exp(-np.clip(unary, -60, 60)))
    local = np.stack([1 - good, good], axis=1) + 1e-30
    forward = np.empty_like(local)
    for t, n in enumerate(alive):
        at = begin[:n] + t
        a = local[at] if t == 0 else _times(forward[at - 1], step) * local[at]
        forward[at] = a / a.sum(1, keepdims=True)
    marginal = np.empty(len(unary))
    expected = np.zeros((2, 2))
    back = np.ones((len(begin), 2))
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        post = forward[at] * back[:n]
        post /= post.sum(1, keepdims=True)
        marginal[at] = post[:, 1]
        if t:
            into = local[at] * back[:n]
            joint = forward[at - 1][:, :, None] * step * into[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            new = _times(into, step.T)
            back[:n] = new / new.sum(1, keepdims=True)
    return marginal, expected


def document_scores(model: Model, texts: list[bytes]) -> np.ndarray:
    lines = line_features(texts)
    scores = np.full(len(texts), model.prior)
    if len(lines.features):
        marginal, _ = forward_backward(model.potentials(lines.features), lines.first, model.transitions)
        owner = np.repeat(np.arange(len(texts)), np.diff(lines.first))
        total = np.bincount(owner, lines.weight, minlength=len(texts))
        full = total > 0
        scores[full] = (np.bincount(owner, lines.weight * marginal, minlength=len(texts))[full]) / total[full]
    return np.clip(scores, 0.0, 1.0)


def fit(blobs: list[bytes], labels: list[int], steps: int = 250, penalty: float = 1e-4) -> Model:
    """Penalised conditional likelihood by Adam; ``blobs`` are the line features of one document each."""
    kinds = set(labels)
    features = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in blobs]
    if len(kinds) < 2 or not sum(map(len, features)):
        zero = np.zeros(WIDTH)
        only = kinds.pop() if len(kinds) == 1 else None
        zero[-1] = 0 if only is None else 60 * (2 * only - 1)
        return Model(np.zeros(WIDTH), np.ones(WIDTH), zero, np.zeros((2, 2)), 0.5 if only is None else float(only))
    x = np.concatenate(features).astype(np.float64)
    sizes = [len(f) for f in features]
    first = np.concatenate([[0], np.cumsum(sizes)])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = np.clip((x - mean) / scale, -8, 8)
    y = np.repeat(np.array(labels, float), sizes)
    follows = np.ones(len(y), bool)
    follows[first[:-1][first[:-1] < len(y)]] = False
    observed = np.zeros((2, 2))
    later = np.flatnonzero(follows)
    np.add.at(observed, (y[later - 1].astype(int), y[later].astype(int)), 1)
    theta, n = np.zeros(WIDTH + 4), len(y)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        marginal, expected = forward_backward(x @ theta[:WIDTH], first, theta[WIDTH:].reshape(2, 2))
        gradient = np.concatenate([x.T @ (y - marginal), (observed - expected).ravel()]) / n - penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0: nothing is learnt from these rows."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, per_document: int = PER_DOCUMENT) -> Model:
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    drawn = [usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = []
            for doc_id, text in zip(batch.column(0).to_pylist(), kernels.binary_list(batch.column(1))):
                lines = line_features([text]).features
                begin = zlib.crc32(str(doc_id).encode()) % max(1, len(lines) - per_document + 1)
                drawn.append(lines[begin : begin + per_document].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(drawn, pa.binary())], names=["doc_id", "quality", "features"])

    # at most 2 * per_label ids, so the sample may be broadcast; an id gives one text
    chosen = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")
    found = chosen.mapInArrow(work, "doc_id long, quality int, features binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["features"]))
    return fit([r["features"] for r in found], [r["quality"] for r in found])


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns to carry along, of every whole text."""
    kept = [c for c in carry if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.binary_list(batch.column(1))
            scores = [document_scores(model, b) for b in _blocks(texts)]
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "score"])
            del texts, batch
            kernels.give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)
    scored = rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", *carry, "score")
