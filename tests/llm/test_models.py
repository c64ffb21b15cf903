"""Quality, search, pages and chat against brute force, held-out rows and round trips."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import ads_search, chat_format, crf_quality, page_extract
from tallyspark.llm.chat_template import DEFAULT_TEMPLATE, Const, Emit, TemplateError, compile_template, escape, fold, parse, unescape
from tallyspark.llm.queries import op1_line_crf_quality, op2_adaptive_scan, op8_chat_format

from .conftest import frame


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out(spark, sf):
    found = op1_line_crf_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    score, label = np.array([r["score"] for r in held]), np.array([r["quality"] for r in held])
    print("held-out AUC", auc(score, label), "accuracy at 0.3", np.mean((score >= 0.3) == label), len(held))
    assert auc(score, label) > 0.85
    assert np.mean((score >= 0.3)[label == 1]) > 0.9
    assert found.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


def test_scores_do_not_depend_on_the_batch():
    """Texts of any bytes score to the same double alone and inside random batches."""
    import random

    rng = random.Random(2)
    pieces = [bytes([b]) for b in range(256)] + [b"\t", b"\t\t", b"\n", b"\n", b"\r\n", b" ", b"word ", b"A sentence of words. "]
    texts = [b"a\t", b"k\tv\tw\t", b"1\t2\t3\t", b"\t\t", b"", b" \n\t\n", b"\x0b\x0c"] + [b"".join(rng.choice(pieces) for _ in range(rng.randrange(200))) for _ in range(400)]
    lines = crf_quality.line_features(texts)
    weights = np.random.default_rng(1).normal(size=crf_quality.WIDTH)
    model = crf_quality.Model(lines.features.mean(0), lines.features.std(0) + 1e-6, weights, np.array([[0.5, -0.2], [0.1, 0.7]]))
    alone = [crf_quality.document_scores(model, [t])[0] for t in texts]
    assert all(alone[k] == 0.5 for k in (3, 4, 5, 6)) and alone[0] != 0.5
    for _ in range(20):
        own = rng.sample(range(len(texts)), rng.randrange(1, len(texts)))
        assert crf_quality.document_scores(model, [texts[k] for k in own]).tolist() == [alone[k] for k in own]


def test_training_sample_is_bounded(spark):
    rows = [(i, "\n".join(f"line {j} of a text." for j in range(500))) for i in range(1, 4)] + [(1, "twice")] * 3
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = crf_quality.train(frame(spark, rows), labels, per_document=10)
    assert np.isfinite(model.weights).all()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    sizes, step = [3, 1, 5, 2], rng.normal(size=(2, 2))
    first = np.concatenate([[0], np.cumsum(sizes)])
    unary = rng.normal(size=first[-1])
    got, expected = crf_quality.forward_backward(unary, first, step)
    pairs = np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        total, mass, own_pairs = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(unary[a + k] * s for k, s in enumerate(path)) + sum(step[p, q] for p, q in zip(path, path[1:])))
            total, mass = total + w, mass + w * np.array(path)
            for p, q in zip(path, path[1:]):
                own_pairs[p, q] += w
        assert np.allclose(got[a:b], mass / total)
        pairs += own_pairs / total
    assert np.allclose(expected, pairs)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = crf_quality.train(frame(spark, [(1, "a b c.")]), labels)
    rows = {r["doc_id"]: r["score"] for r in crf_quality.score(frame(spark, [(1, None), (2, ""), (3, " \n "), (4, "x"), (None, "y")]), model).collect()}
    assert set(rows) == {1, 2, 3, 4, None} and all(0 <= s <= 1 for s in rows.values()) and rows[1] == rows[2] == rows[3]
    assert crf_quality.score(frame(spark, []), model).count() == 0
    assert crf_quality.score(docs, crf_quality.train(docs, labels.limit(0))).filter("score is null").count() == 0


def brute_nearest(ids, vectors, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != q][:k]
        out[ids[q]] = [(ids[j], d[j]) for j in order]
    return out


def test_search_recall(spark):
    sf = "/root/testdata/sf0.1"
    found = {}
    for r in op2_adaptive_scan(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [(r["vec_id"], r["embedding"]) for r in rows if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, vectors = np.array([i for i, _ in good]), np.array([v for _, v in good], float)
    want = brute_nearest(ids, vectors, [k for k, i in enumerate(ids) if i % 100 == 0])
    assert set(found) == set(want)
    hit = np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    print("recall", hit)
    assert hit >= 0.9
    exact = {q: dict(zip(ids, np.sqrt(((vectors - vectors[np.flatnonzero(ids == q)[0]]) ** 2).sum(1)))) for q in want}
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0])) and all(abs(exact[q][i] - s) < 1e-12 for i, s in near)


def test_search_edges(spark):
    rows = [(0, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [3.0, 1.0]), (7, []), (8, [0.0, 1.0])]
    frame_ = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, list int, block int")
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ads_search.search(frame_, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert found == [(0, 1, 1, 0.0), (0, 2, 8, 0.0), (0, 3, 6, 3.0)]
    assert ads_search.search(frame_.limit(0), F.lit(True)).count() == 0


def test_search_takes_one_vector_of_an_id(spark):
    """Of rows that share an id the least vector counts, as a query and as a candidate."""
    rows = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (0, [1.0, 0.0]), (4, [9.0, 0.0]), (4, [3.0, 0.0]), (5, [1.5, 0.0]), (6, None), (6, [1.0, 1.0]), (None, [1.0, 0.0])]
    found = ads_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 5, 0.5), (0, 2, 6, 1.0), (0, 3, 4, 2.0)]


def test_pages_held_out():
    net = page_extract.trained()
    pages = list(page_extract.training_pages(150, seed=91))
    found = page_extract.label_pages(net, [h for h, _ in pages])
    right = total = 0
    for (_, main), labelled in zip(pages, found):
        at = 0
        for text, kept in labelled:
            here = main.startswith(text, at)
            at += (len(text) + 1) * here
            right += kept == here
            total += 1
    print("held-out block accuracy", right / total)
    assert right / total > 0.95


def test_pages_in_foreign_layouts():
    from .foreign_pages import PAGES

    net, right, total = page_extract.trained(), 0, 0
    for page in PAGES:
        found = page_extract.label_pages(net, ["".join(markup.replace("{}", text) for markup, text, _ in page)])[0]
        assert [text for text, _ in found] == [text for _, text, _ in page]
        right += sum(kept == own for (_, kept), (_, _, own) in zip(found, page))
        total += len(page)
    print("blocks of foreign layouts", right, total)
    assert right / total >= 0.95


def test_pages_without_telling_names():
    """Written before the labeller was run on them; a share of their blocks is got wrong, and said so."""
    import re

    from .plain_pages import PLAIN

    net, right, total, kept = page_extract.trained(), 0, 0, 0
    for page in PLAIN:
        want = [(text, mark == "+") for mark, text in re.findall(r"\[([+-])(.*?)[+-]\]", page)]
        found = page_extract.label_pages(net, [re.sub(r"\[[+-](.*?)[+-]\]", r"\1", page)])[0]
        assert [t for t, _ in found] == [t for t, _ in want]
        right += sum(a == b for (_, a), (_, b) in zip(found, want))
        total += len(want)
        kept += any(k for _, k in found)
    print("blocks of nameless pages", right, total, "pages with text", kept, len(PLAIN))
    assert right / total >= 0.85 and kept >= len(PLAIN) - 2


def test_the_weights_are_those_that_training_makes():
    """A short training gives the same network twice, of the shapes that are shipped."""
    one, two = page_extract.train(30, 1), page_extract.train(30, 1)
    assert all((one.p[k] == two.p[k]).all() and one.p[k].shape == v.shape for k, v in page_extract.trained().p.items())


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    sizes = [10, 3 << 20, None, 5, 1 << 20, 1 << 20, 7]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(7)), "url": ["u"] * 7, "html": [None if n is None else "x" * n for n in sizes]})
    own = [s.column(0).to_pylist() for s in page_extract._slices(batch)]
    assert own == [[0], [1], [2, 3, 4], [5, 6]]


def test_long_and_deeply_nested_pages():
    net = page_extract.trained()
    deep = "<div>" * 20_000 + "<p>some words in the middle of it</p>" + "</div>" * 20_000
    long = "<article>" + "<p>A paragraph that says something of its own, and ends.</p>" * 20_000 + "</article>"
    found = page_extract.label_pages(net, [deep, long, "<p>short</p>"])
    assert [len(page) for page in found] == [1, 20_000, 1]


def test_every_word_of_a_block_counts():
    one, other = ([[(("p",), "the same beginning of twelve words that both of these blocks share " + end, 0.0)]] for end in ("reply", "glacier"))
    assert (page_extract.vectors(one)[0] != page_extract.vectors(other)[0]).any()


def test_page_edges(spark):
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three of a long sentence that says something.<p>And another paragraph, which is as long as the first.</article><script>var x = '<p>no</p>'</script><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<p", "t"), (5, "u", page, "t"), (None, "u", "<!-- never closed", "t")]
    frame_ = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {r["page_id"]: r["text"] for r in page_extract.extract(frame_).collect()}
    assert len(found) == 6 and found[2] == found[3] == found[None] == "" and found[1] == found[5]
    assert "A & B One two three of" in found[1] and "Home" not in found[1] and "var" not in found[1] and "©" not in found[1]
    assert page_extract.extract(frame_.limit(0)).count() == 0


def test_search_with_one_huge_list_and_few_vectors(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([np.ones((3000, 8)) + rng.normal(size=(3000, 8)) * 1e-3, rng.normal(size=(300, 8))])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for kept in (rows, rows.filter("vec_id < 30")):
        ids = np.arange(kept.count())
        want, found = brute_nearest(ids, v[: len(ids)], [i for i in ids if i % 100 == 0]), {}
        for r in ads_search.search(kept, F.col("vec_id") % 100 == 0, block=256, deal=10).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        hit = np.mean([len(set(found[q]) & {i for i, _ in want[q]}) / len(want[q]) for q in want])
        assert set(found) == set(want) and hit >= 0.9


def test_chat_round_trip(spark, sf):
    found = {r["conv_id"]: r for r in op8_chat_format(spark, sf).collect()}
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    assert set(found) == set(turns)
    for c, own in turns.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in own)
        r = found[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_edges(spark):
    rows = [(1, 0, None, None, "x"), (1, 1, "assistant", "", "x"), (None, 0, "a\nb\\n", "### </turn>\n\\n", "x"), (2, 0, "assistant", "same", "x"), (2, 0, "assistant", "same", "x")]
    frame_ = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    found = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(frame_)).collect()}
    assert {c: (r["n_turns"], r["loss_chars"]) for c, r in found.items()} == {1: (2, 0), None: (1, 0), 2: (2, 8)}
    assert found[None]["turns_sha256"] == hashlib.sha256(b"a\nb\\n\n### </turn>\n\\n\n").hexdigest()
    parts = chat_format.format_conversations(spark.createDataFrame([(5, k, "assistant" if k % 2 else "user", "z" * 50, "x") for k in range(40)], frame_.schema), part_chars=200)
    assert parts.count() > 1
    whole = chat_format.digests(parts).first()
    assert whole["n_turns"] == 40 and whole["loss_chars"] == 1000 and whole["loss_sha256"] == hashlib.sha256(b"z" * 1000).hexdigest()
    assert chat_format.format_conversations(frame_.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\###", "</turn>", "###\\n", "\\n", "a</turn>\\###b", "\n"])
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text and "</turn>" not in escape(text).replace("\\</turn>", "")


def render(source, **names):
    return "".join(t for t, _ in compile_template(source)(names))


def test_templates():
    assert fold(parse("{{ 'a' ~ 1 }}b{% if true %}c{% else %}{{ x }}{% endif %}")) == (Emit(Const("a1bc")),)
    assert render("{% for m in ms %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[1, 2, 3]) == "1,2,3"
    assert render("{%- set x = a.b | upper -%} {{ x if x == 'Q' else 'no' }}", a={"b": "q"}) == "Q"
    assert render("{{ a.__class__ }}{{ missing }}", a="x") == ""
    assert render("{{ 'a}}b' }}{% if x == '%}' %}c{% endif %}{# it's {{ no }} tag #}d", x="%}") == "a}}bcd"
    for bad in ("{{ f(1) }}", "{{ 1", "{% if x %}", "{% endif %}", "{{ x | nope }}", "{% import os %}", "{{ }}", "{{ x %}", "{% if x }}y{% endif %}", "{{ 'a }}", "{# open", "{{ x %} and {{ y }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    assert [m for _, m in compile_template(DEFAULT_TEMPLATE)({"messages": [{"role": "assistant", "text": "x"}]})].count(True) == 1
