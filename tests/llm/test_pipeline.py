"""Every stage on its own input against the operator's contract."""

from __future__ import annotations

import corpus_pipeline as P

from .test_dedup import WORD, brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {name: None for name, _ in P.STAGES}
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf).cache()
        after = docs.collect()
        seen[name] = (len(before), len(after))
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
        if name == "near_dedup":
            want = {i for i, (_, root, _) in brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80).items() if i == root}
            assert {r["doc_id"] for r in after} == want
        if name == "substring_dedup":
            texts = {r["doc_id"]: r["text"] for r in before}
            assert set(texts) == {r["doc_id"] for r in after}
            windows: dict = {}
            for i, t in texts.items():
                w = WORD.findall(t or "")
                for k in range(len(w) - 34):
                    windows.setdefault(tuple(w[k : k + 35]), []).append((i, k))
            gone: dict = {}
            for places in windows.values():
                if len(places) > 1:
                    for i, k in places:
                        gone.setdefault(i, set()).update(range(k, k + 35))
            for r in after:
                w = WORD.findall(texts[r["doc_id"]] or "")
                assert WORD.findall(r["text"]) == [x for k, x in enumerate(w) if k not in gone.get(r["doc_id"], ())]
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    print(seen)
    assert seen["quality_classifier"][1] < seen["quality_classifier"][0] and P.run(spark, sf).count() == seen["best_fit_packing"][1]


def test_repeated_rows_are_one_document(spark, sf):
    """A document stored more than once goes through all stages once and whole."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.quality(spark, docs, sf).filter("size(split(trim(text), ' ')) > 60").orderBy("doc_id").limit(4).collect()
    first, other, third, null_id = (r.asDict() for r in kept)
    rows = [first] * 3 + [other] + [third, third | {"text": other["text"][::-1]}] + [null_id | {"doc_id": None}] * 2 + [first | {"doc_id": -5, "text": None}] * 2
    # as the quality stage passes them on: it scores each row by itself
    out = P.near_duplicates(spark, spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], docs.select(*COLUMNS).schema), sf).cache()
    want = {(r["doc_id"], r["text"]) for r in rows}
    found = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(found) == len(want) and set(found) == want
    whole = P.repeated_passages(spark, out, sf).cache()
    assert {(r["doc_id"], r["text"]) for r in whole.collect()} == {(i, t or "") for i, t in want}
    packed = P.best_fit(spark, whole, sf).filter("piece = 0").collect()
    assert len(packed) == len(want) and all(r["length"] > 35 for r in packed if r["doc_id"] != -5)


def test_empty_and_null_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for rows in (docs.limit(0), docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", "s", 1)], docs.schema))):
        for _, stage in P.STAGES:
            rows = stage(spark, rows, sf)
            rows.collect()
