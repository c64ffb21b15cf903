"""Imports and what they tell of themselves, and reports from the page passes."""

from __future__ import annotations

import random

import pytest

from tallyspark.operators import geometry, importing, quality

from .test_pages import FOUR, SCHEMA, SIX, printed, statement


def frame(spark, glyphs):
    return spark.createDataFrame(glyphs, SCHEMA)


def two(rng):
    return statement(rng, "one", SIX) + statement(rng, "two", SIX, n=5) + printed(rng, "none", 0, [(50.0, [(10.0, "01-02-24 one")]), (70.0, [(10.0, "no table")])])


def test_an_import_tells_its_stages_and_figures(spark, tmp_path):
    told = []
    done = importing.run_import(spark, lambda: frame(spark, two(random.Random(1))), listen=told.append, folder=f"file://{tmp_path}")
    assert told == done.events and [e.seq for e in told] == list(range(1, 9))
    assert [e.stage for e in told[:7]] == list(importing.STAGES) and [e.label for e in told[:7]] == list(importing.STAGES.values())
    rows = frame(spark, two(random.Random(1)))
    lines = geometry.read_rows(rows).count()
    assert [e.detail for e in told] == [None, None, None, f"{lines} rows", "2 tables", "17 transactions", None, None]
    figures = told[-1].figures
    assert told[-1].kind == "succeeded" and (figures["transactions"], figures["tables"], figures["rows"], figures["glyphs"]) == (17, 2, lines, rows.count())
    assert (figures["checked"], figures["mismatches"], figures["consistency"]) == (15, 0, 1.0)
    assert done.transactions.count() == 17 and {"merchant_id", "stage", "confidence", "description"} <= set(done.transactions.columns)
    assert figures["unresolved"] == done.transactions.filter("stage = 'unresolved'").count()
    assert {r["doc_id"]: r["transactions"] for r in done.report.collect()} == {"one": 12, "two": 5, "none": 0}


def test_one_table_is_told_as_one(spark):
    done = importing.run_import(spark, lambda: frame(spark, statement(random.Random(2), "one", SIX)))
    assert done.events[4].detail == "1 table"


@pytest.mark.parametrize(("message", "asks"), [("the Password is wrong", True), ("not a statement", False)])
def test_failures_are_told_and_a_password_is_asked_for(spark, message, asks):
    def locked():
        raise OSError(message)

    done = importing.run_import(spark, locked)
    assert [e.kind for e in done.events] == ["progress", "failed"] and done.transactions is None and done.report is None
    assert done.events[-1].needs_password is asks
    assert done.events[-1].detail == (importing.NEEDS_PASSWORD if asks else importing.UNREADABLE + message)
    assert importing.event_rows(spark, done.events).count() == 2


def test_a_failure_within_a_step_ends_the_import(spark):
    broken = frame(spark, two(random.Random(1))).drop("glyph_ord")
    done = importing.run_import(spark, lambda: broken)
    assert [e.stage for e in done.events] == ["reading", "extractingGlyphs", None] and done.events[-1].kind == "failed" and not done.events[-1].needs_password


def test_an_import_without_glyphs_succeeds_with_nothing(spark):
    done = importing.run_import(spark, lambda: frame(spark, []))
    assert done.events[-1].kind == "succeeded" and [done.events[k].detail for k in (3, 4, 5)] == ["0 rows", "0 tables", "0 transactions"]
    assert done.events[-1].figures["consistency"] == 1.0


def test_the_report_counts_pages_without_tables(spark):
    """Counts of the page passes against the glyphs, lines and transactions themselves."""
    rng = random.Random(5)
    glyphs = two(rng) + [(d, o, t, 1, x, y, w, h) for d, o, t, _, x, y, w, h in statement(rng, "two", SIX, n=4)] + [(d, o, t, 2, x, y, w, h) for d, o, t, _, x, y, w, h in printed(rng, "two", 0, [(30.0, [(10.0, "the end")])])]
    glyphs = [g[:1] + (k,) + g[2:] for k, g in enumerate(glyphs)]
    lines = geometry.read_rows(frame(spark, glyphs))
    report = {r["doc_id"]: r for r in quality.extraction_report(geometry.typed_rows(geometry.lay_out(geometry.counted_tables(lines)))).collect()}
    table = geometry.locate_tables(lines)
    found = geometry.extract_transactions(geometry.lay_out(table)).collect()
    for doc, r in report.items():
        own = sorted(((t["page"], t["txn_ord"], t["amount_paise"], t["balance_paise"]) for t in found if t["doc_id"] == doc))
        steps = [(a, b) for a, b in zip(own, own[1:]) if a[3] is not None and b[3] is not None]
        assert (r["glyphs"], r["rows"], r["transactions"]) == (sum(g[0] == doc for g in glyphs), lines.filter(f"doc_id = '{doc}'").count(), len(own))
        assert r["tables"] == len({t["page"] for t in found if t["doc_id"] == doc})
        assert (r["checked"], r["mismatches"]) == (len(steps), sum(a[3] + b[2] != b[3] for a, b in steps))
    assert report["two"]["mismatches"] == 1 and report["two"]["tables"] == 2  # the second page begins a balance of its own


def test_cells_mode_finds_columns_over_what_is_shown(spark):
    lines = geometry.read_rows(frame(spark, statement(random.Random(3), "four", FOUR)))
    cells = geometry.inspect_cells(lines, page=0, from_y=85.0, to_y=115.0, masked=False).collect()
    assert {c["column"] for c in cells} == {0, 1, 2, 3}
    first = {c["column"]: c["text"] for c in cells if c["row_id"] == cells[0]["row_id"]}
    assert first == {0: "01-03-24", 1: "UPI/DR/0000/SHOP", 2: "100.00 Dr", 3: "99900.50"}
    wrapped = {c["column"]: c["text"] for c in cells if c["row_id"] != cells[0]["row_id"]}
    assert wrapped == {0: None, 1: "continued, below", 2: None, 3: None}
    masked = geometry.inspect_cells(lines, page=0, from_y=85.0, to_y=115.0).collect()
    assert [c["text"] for c in masked][:2] == ["99-99-99", "AAA/AA/9999/AAAA"]
    assert geometry.inspect_cells(lines, page=0, limit=2).select("row_id").distinct().count() == 2
