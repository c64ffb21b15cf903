"""Byte-level BPE by a monoid tree.

An element is a stretch of text with its token ids. Encoding halves a text until a stretch is at
most ``leaf`` code points, encodes those directly, and joins neighbours upwards. Where two stretches
meet, a window around the seam is encoded again and replaces the tokens it covers. The window grows
(16, 32, 64 ... code points each way) until each edge is the end of the stretch or a *settled* spot:
a white-space character after one that is not. There no token can change, for whatever follows or
precedes: every alternative of the pattern matches white space only at its front or alone, so a
match with the character before the spot ends there in any text, and the matches from the spot on
depend only on what comes after it. Merges never cross a match. So joining is associative and gives
the ids of the whole text. Decoding concatenates the bytes of the ids up the same tree.

Edge cases: a null or empty text has no ids and decodes to the empty string; a text without white
space (one match of any length) makes the window grow to the whole stretch, which stays exact;
rows may repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF, WINDOW = 64, 16
#: Code points on which the pattern's \s and Python's agree, so that a spot found is truly settled.
_SETTLED = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \t\n\r]")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """A tiktoken encoding from a rank file, or from the vocabulary of a tokenizers JSON file, whose
    added tokens are then its special tokens. ``encode_ordinary`` reads these as plain text."""
    import tiktoken

    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            tokenizer = json.load(file)
        added = tokenizer["added_tokens"]
        if any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("an added token that takes in its surroundings")
        special = {x["content"]: x["id"] for x in added}
        shown = _shown_bytes()
        ranks = {bytes(shown[c] for c in word): i for word, i in tokenizer["model"]["vocab"].items() if word not in special}
    else:
        special = {}
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def _shown_bytes() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MonoidEncoder:
    def __init__(self, encoding, leaf: int = LEAF):
        self.encoding, self.leaf = encoding, leaf
        self.lengths = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)])

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, begin: int, end: int) -> list[int]:
        if end - begin <= self.leaf:
            return self.encoding.encode_ordinary(text[begin:end])
        middle = (begin + end) // 2
        return self._join(text, begin, middle, end, self._encode(text, begin, middle), self._encode(text, middle, end))

    def _join(self, text: str, begin: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        a = b = middle
        reach = WINDOW
        while True:
            a, b = max(begin, middle - reach), min(end, middle + reach)
            spots = [m.start() for m in _SETTLED.finditer(text, max(begin, a - 1), middle) if m.start() > a or a == begin]
            start = begin if a == begin else (spots[0] if spots else None)
            stop = end if b == end else next((m.start() for m in _SETTLED.finditer(text, middle + 1, b)), None)
            if start is not None and stop is not None:
                break
            reach *= 2
        seam = self.encoding.encode_ordinary(text[start:stop])
        return left[: self._cut(left, len(text[start:middle].encode()), from_end=True)] + seam + right[self._cut(right, len(text[middle:stop].encode()), from_end=False) :]

    def _cut(self, ids: list[int], size: int, from_end: bool) -> int:
        """Index where the tokens of ``size`` bytes at one end begin or stop."""
        lengths, at, step = self.lengths, len(ids) if from_end else 0, -1 if from_end else 1
        while size > 0:
            size -= lengths[ids[at - 1 if from_end else at]]
            at += step
        if size:
            raise AssertionError("a token crosses a settled spot")
        return at

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary) of every text, row by row without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = MonoidEncoder(encoder(ranks_path, pattern), leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [tree.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0),
                    "ids": pa.array(ids, pa.list_(pa.int32())),
                    "decoded": pa.array([tree.decode(x) for x in ids], pa.binary()),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what ``encode_documents`` returned."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy(zero_copy_only=False).astype("<u4")
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in batch.column(2).to_pylist()]),
            })

    return encoded.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
