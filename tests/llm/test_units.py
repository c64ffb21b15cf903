"""Fill-in-the-middle forms and periodic runs against plain Python."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest
import regex
from pyspark.sql import functions as F

from tallyspark.llm import fill_middle as M
from tallyspark.llm import periodic_runs as P
from tallyspark.llm.queries import op12_fill_in_middle, op13_periodic_runs

from .conftest import frame

PIECES = ["a", "Zz", "é", "é", "日本", "\U0001f600", "\U0001f469‍\U0001f4bb", " ", "  ", "\n", "\r\n", "\t", "\x0b", " ", "12", "٣", ".", "--", "<P>", "<", "P>", "\x00", "$", "\\"]


def texts(n, seed):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "\n\n", "\U0001f600", "x<P>y", "<S", "M>"] + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize(("grammar", "unit"), [
    (M.CODE_POINTS, r"(?s)."), (M.LINES, r"[^\n]*\n|[^\n]+"), (M.WORDS, r"[ \t-\r]+|[^ \t-\r]+"), (M.TOKENS, r" ?[\p{L}\p{M}]+|\p{N}+|(?s:.)"), (M.UnitGrammar({"any": "."}, frozenset({("any", "any")})), r"(?s).+"),
])
def test_units_are_those_matched_left_to_right(spark, grammar, unit):
    own = [t for t in texts(300, 1) if t is not None]
    found = spark.createDataFrame(list(enumerate(own)), "k int, text string").select("k", M.units(F.col("text"), grammar).alias("u")).collect()
    for r in found:
        assert r["u"] == regex.findall(unit, own[r["k"]])


def plain_form(doc_id, text, units, plain=10, spm=20):
    text = text or ""
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    head, middle, tail = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", head, middle, f"<S>{tail}<P>{head}<M>{middle}"
    return n, "psm", head, middle, f"<P>{head}<S>{tail}<M>{middle}"


@pytest.mark.parametrize(("grammar", "unit"), [(M.CODE_POINTS, r"(?s)."), (M.WORDS, r"[ \t-\r]+|[^ \t-\r]+")])
def test_forms_equal_plain_python_and_read_back(spark, corpus, grammar, unit):
    rows = corpus + [(10**6 + k, t) for k, t in enumerate(texts(300, 2))] + [(None, "no id"), (None, None), (1, "again"), (1, "again")]
    found = M.fill_in_middle(frame(spark, rows), grammar).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = [(i, t or "", *plain_form(i, t, regex.findall(unit, t or ""))) for i, t in rows]
    assert sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix"], r["middle"], r["output"]) for r in found), key=key) == sorted(want, key=key)
    assert all(r["back"] == r["text"] for r in found)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_shares_sentinels_and_empty_tables(spark):
    rows = [(k, "some words here") for k in range(400)]
    forms = lambda **kw: {r["form"] for r in M.fill_in_middle(frame(spark, rows), **kw).collect()}
    assert forms(plain_percent=100) == {"plain"} and forms(plain_percent=0, spm_percent=100) == {"spm"} and forms(plain_percent=0, spm_percent=0) == {"psm"}
    other = M.Sentinels("␂p|", "␂s|", "␂m|")
    made = M.fill_in_middle(frame(spark, [(k, t) for k, t in enumerate(texts(100, 3))]), sentinels=other, plain_percent=0).withColumn("back", M.restored(F.col("output"), F.col("form"), other)).collect()
    assert all(r["back"] == r["text"] for r in made)
    assert M.fill_in_middle(frame(spark, [])).count() == 0
    for bad in (("aa", "b", "c"), ("ab", "bc", "x"), ("x", "x", "y"), ("", "b", "c")):
        with pytest.raises(ValueError):
            M.Sentinels(*bad)


def test_the_query_reads_every_text(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op12_fill_in_middle(spark, sf).collect()
    assert len(found) == len(docs) and all(r["restored_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest() for r in found)


def brute_runs(w, least=6, power=4):
    """Maximal stretches of equal words q apart, for every q, under the smallest q of each."""
    found, n = {}, len(w)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(w, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def hostile_words(rng):
    """Words over few letters with powers, Fibonacci words and powers inside powers."""
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(120))]
    if kind == 1:
        w = []
        while len(w) < 150:
            w += [rng.choice("abc") for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 9)
        return w
    if kind == 2:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randrange(1, 9)):
            a, b = b, b + a
        return b * rng.randrange(1, 5)
    if kind == 3:
        inner = ["x"] * rng.randrange(1, 9) + ["y"] * rng.randrange(0, 3)
        return (["p"] + inner * rng.randrange(1, 5)) * rng.randrange(1, 7) + ["q"] * rng.randrange(0, 9)
    return [rng.choice("abcdefgh") for _ in range(rng.randrange(60))] + ["w"] * rng.randrange(40) + [rng.choice("ab") for _ in range(30)]


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for least, power in [(6, 4)] * 60 + [(2, 4), (3, 5), (20, 4)] * 8:
        batch = [hostile_words(rng) for _ in range(rng.randrange(1, 8))]
        ids, first = P.intern([[x.encode() for x in w] for w in batch])
        found = P.find_runs(ids, least, power)
        want = [(start + int(f), length, q) for f, w in zip(first, batch) for start, length, q in brute_runs(w, least, power)]
        assert found == sorted(want)
    with pytest.raises(ValueError):
        P.find_runs(ids, 6, 3)


def test_runs_of_an_endless_word_take_no_square():
    """Half a million equal words, and the same with another word now and then."""
    began = time.process_time()
    ids, _ = P.intern([[b"no"] * 500_000])
    assert P.find_runs(ids) == [(0, 500_000, 1)]
    ids, _ = P.intern([([b"no"] * 4_999 + [b"yes"]) * 60])
    assert [r for r in P.find_runs(ids) if r[2] > 1] == [(0, 300_000, 5_000)]
    assert time.process_time() - began < 60


def test_run_texts_equal_plain_python(spark, corpus):
    rng = random.Random(9)
    rows = corpus + [(10**6 + k, rng.choice([" ", "\n\t", "  "]).join(hostile_words(rng))) for k in range(200)] + [(None, "a " * 9), (None, None), (5, "b b b b b b"), (5, "b b b b b b")]
    short = [(i, t) for i, t in rows if len(t or "") < 20_000]
    found = P.periodic_runs(frame(spark, short)).collect()
    want = []
    for i, t in short:
        w = regex.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(w)
        want.append((i, len(w), runs, collapsed(w, runs)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert P.periodic_runs(frame(spark, [])).count() == 0
    assert P.periodic_runs(frame(spark, rows)).count() == len(rows)


def test_the_query_plants_and_reports_as_told(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefghij") + rng.choice("xy") for _ in range(rng.randrange(80)))) for k in range(300)] + [(400, None), (401, " \n"), (402, "k k k k k k k m"), (403, "a b a b a b a b c c c c c c c c")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    planted = 0
    for i, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        r = found[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 10
