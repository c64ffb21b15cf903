"""Byte spans that documents of smaller ids have, against plain Python, and the merge below them."""

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import suffix_dedup as S
from tallyspark.llm.queries import op11_suffix_dedup

from .conftest import frame


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    ids = [1 << 63 if i is None else i for i, _ in rows]
    least = {}
    for i, t in zip(ids, texts):
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for (i, _), own, t in zip(rows, ids, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < own:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((-1 if i is None else i, len(t), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t))), kept))
    return sorted(out)


def told(found):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in found.collect())


def hostile(rng, n):
    """Texts over few letters, with shared passages, periods, and characters of several bytes."""
    passages = ["".join(rng.choice("ab é日\n") for _ in range(rng.randrange(5, 120))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            kind = rng.randrange(4)
            if kind == 0:
                parts.append(rng.choice(passages))
            elif kind == 1:
                p, a, b = rng.choice(passages), rng.randrange(60), rng.randrange(60)
                parts.append(p[min(a, b) : max(a, b)])
            elif kind == 2:
                parts.append(rng.choice(["a", "ab", "abc", "é"]) * rng.randrange(60))
            else:
                parts.append("".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40))))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("length", "chunk", "sort"), [(50, 1 << 10, 1 << 10), (50, 1 << 20, 1 << 9), (7, 600, 3000), (2, 1 << 12, 1 << 12), (64, 2000, 700), (19, 1500, 1500)])
def test_spans_equal_brute_force(spark, length, chunk, sort):
    rng = random.Random(length)
    rows = list(enumerate(hostile(rng, 120)))
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (None, rows[0][1]), (None, None), (500, ""), (3, rows[5][1]), (3, rows[5][1]), (-4, rows[9][1]), (900, "no" * 300), (901, "no" * 300), (902, "on" * 200)]
    assert told(S.duplicated_spans(frame(spark, rows), length, chunk, sort)) == brute(rows, length)


def test_spans_of_the_corpus(spark, corpus):
    rows = [(i, t) for i, t in corpus if len(t or "") < 90_000] + [(10**6 + k, "one line that very many documents have, and then some: end") for k in range(300)]
    assert told(S.duplicated_spans(frame(spark, rows), 50, 1 << 17, 1 << 16)) == brute(rows, 50)


def test_empty_tables_and_lengths(spark):
    assert S.duplicated_spans(frame(spark, [])).count() == 0
    assert told(S.duplicated_spans(frame(spark, [(1, None), (2, ""), (3, "short")]))) == [(1, 0, 0, 0, b""), (2, 0, 0, 0, b""), (3, 5, 0, 0, b"short")]
    for bad in (1, 201):
        with pytest.raises(ValueError):
            S.duplicated_spans(frame(spark, []), bad)


def common(a, b):
    return len(os.path.commonprefix([a, b]))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 16, 33])
def test_merge_orders_and_counts_without_reading_known_bytes(k):
    """Keys that count the bytes read from them: none lies below what both sides are known to share."""
    rng = random.Random(k)
    runs = [sorted({bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(1, 60))}) for _ in range(k)]
    counted = [[0] + [common(x, y) for x, y in zip(r, r[1:])] for r in runs]
    read = [0]

    class Key(bytes):
        def __getitem__(self, part):
            rest = bytes.__getitem__(self, part)
            read[0] += len(rest)
            return rest

    at, out = [0] * k, []
    for run, shared in S.merge([([Key(x) for x in r], c) for r, c in zip(runs, counted)]):
        out.append((bytes(runs[run][at[run]]), shared))
        at[run] += 1
    keys = [x for x, _ in out]
    assert keys == sorted(x for r in runs for x in r)
    assert [c for _, c in out] == [0] + [common(x, y) for x, y in zip(keys, keys[1:])]
    total = len(keys)
    assert read[0] <= 2 * 12 * total * max(1, (k - 1).bit_length()) * 0.62  # rests only


def test_front_coding_is_reversible():
    rng = np.random.default_rng(2)
    for n in (1, 2, 300):
        rows = rng.integers(0, 3, (n, 9), np.uint8)
        rows = rows[np.lexsort(S._words(rows)[::-1])]
        shared, rest = S.front_code(rows)
        assert (S.front_decode(shared, rest, 9) == rows).all()


def test_equal_stretches_have_equal_anchors():
    """Every stretch of a text has one anchor, at the same place as in any other text."""
    rng, length, reach = random.Random(5), 20, 7
    texts = [t.encode() for t in hostile(rng, 60)]
    chunk = S.read_chunk(pa.table({"doc_id": list(range(60)), "text": [t.decode() for t in texts]}), length, reach)
    seen, count = {}, 0
    for at, doc, low, high in zip(chunk.at, chunk.doc, chunk.low, chunk.high):
        for distance in range(low, high + 1):
            start = int(at) - distance
            assert chunk.edges[doc] <= start and start + length <= chunk.edges[doc + 1]
            assert seen.setdefault(chunk.raw[start : start + length].tobytes(), distance) == distance
            count += 1
    assert count == sum(max(0, len(t) - length + 1) for t in texts)


def test_the_query_reads_every_text(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = op11_suffix_dedup(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found) == [x[:4] for x in brute(docs, 50)]
