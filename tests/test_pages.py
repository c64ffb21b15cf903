"""The two page passes against the column expressions they stand for, on pages that are not neat."""

from __future__ import annotations

import random

from tallyspark.operators import geometry

SCHEMA = "doc_id string, glyph_ord long, text string, page int, x double, y double, w double, h double"


def printed(rng, doc, page, lines):
    """Glyphs of (y, [(x, text)]) lines, with jitter, kerning and low punctuation."""
    out = []
    for y, cells in lines:
        for x, text in cells:
            for i, ch in enumerate(text):
                if ch != " ":
                    low = 2.0 if ch in ",.;" else 0.0
                    out.append((doc, len(out), ch, page, x + 5.0 * i + rng.choice((0.0, 0.0, 0.3)), y + rng.uniform(-0.6, 0.6) + low, 4.0, 8.0 - low))
    return out


def statement(rng, doc, columns, n=12, skip=None):
    """Dated lines under a heading, every third with a wrapped description, and a footer far below."""
    lines, y, total = [(40.0, [(20.0, "Statement of account, page one.")])], 90.0, 100_000
    for k in range(n):
        amount = 100 + 37 * k
        total -= amount
        cells = {"date": f"{k % 28 + 1:02d}-03-24", "description": f"UPI/DR/{k:04d}/SHOP", "reference": "-", "credit": "0", "debit": f"{amount}.00", "amount": f"{amount}.00 Dr", "balance": f"{total}.50"}
        lines.append((y, [(x, cells[c]) for c, x in columns.items() if not (c == skip and k % 2)]))
        y += 18
        if k % 3 == 0:
            lines.append((y, [(columns["description"], "continued, below")]))
            y += 18
    lines.append((y + 200, [(20.0, "This is computer generated.")]))
    return printed(rng, doc, 0, lines)


SIX = {"date": 20.0, "description": 120.0, "reference": 380.0, "credit": 430.0, "debit": 510.0, "balance": 600.0}
FOUR = {"date": 20.0, "description": 110.0, "amount": 330.0, "balance": 430.0}


def pages(spark):
    rng = random.Random(4)
    glyphs = statement(rng, "six", SIX) + statement(rng, "four", FOUR) + statement(rng, "gap", SIX, skip="reference") + printed(rng, "few", 0, [(50.0, [(10.0, "01-02-24 one")]), (70.0, [(10.0, "no table")])])
    return spark.createDataFrame(glyphs, SCHEMA)


def test_passes_equal_column_expressions(spark):
    glyphs = pages(spark)
    rows = geometry.rows_of(geometry.cluster_rows(glyphs))
    read = geometry.read_rows(glyphs)
    assert read.count() == rows.count() and rows.select(read.columns).exceptAll(read).count() == 0
    table = geometry.locate_tables(rows)
    split = geometry.split_cells(table, geometry.detect_columns(table.filter("is_anchor"))).select("doc_id", "row_id", "boundaries", "cells")
    laid = geometry.lay_out(geometry.locate_tables(read)).select("doc_id", "row_id", "boundaries", "cells")
    assert laid.count() == split.count() > 0 and split.exceptAll(laid).count() == 0


def test_one_pass_equals_its_steps(spark):
    """Tables read in one pass against lines, location and layout one after another."""
    rng = random.Random(8)
    lines = [(40.0 + 17.0 * k, [(20.0, rng.choice(["01-02-24 PAY", "1 Sept 2024", "05/08/26UPI", "31-02-24", "note", "12AUG26 x"])), (200.0, rng.choice(["12.00", "900.50 Dr", "-"])), (300.0, "77.00")]) for k in range(30)]
    glyphs = pages(spark).unionByName(spark.createDataFrame(printed(rng, "mixed", 3, lines) + printed(rng, "same", 0, [(50.0, [(10.0, "01-02-24 a")])] * 4), SCHEMA))
    steps = geometry.lay_out(geometry.locate_tables(geometry.read_rows(glyphs)))
    once = geometry.read_tables(glyphs).select(steps.columns)
    assert once.count() == steps.count() > 60 and steps.exceptAll(once).count() == 0 and steps.select("doc_id").distinct().count() >= 4


def test_plain_dates_equal_the_column_expression(spark):
    from pyspark.sql import functions as F

    from tallyspark.functions import plain, text

    rng = random.Random(3)
    made = ["".join(rng.choice(["0", "1", "2", "3", "9", "12", "31", "-", "/", ".", " ", "\u00a0", "Aug", "sept", "FEB", "x", "2024", "26", "\n", "\u0085", "\u2028"]) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    made += [f"{d:02d}{s}{m:02d}{s}{y}" for d in (0, 1, 29, 30, 31, 32) for m in (0, 1, 2, 4, 12, 13) for y in ("0000", "1900", "2000", "69", "70", "24", "024") for s in "-/."]
    made += ["", " ", None, "\u0967-02-24", "29-02-0000 x", "5 Sept26pay", "05-08-26UPI/DR/1"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(made)], "k int, x string").select("k", text.starts_with_date(F.col("x")).alias("starts"), text.statement_date(F.col("x")).isNotNull().alias("whole")).collect()
    for r in rows:
        assert r["starts"] == plain.starts_with_date(made[r["k"]]), repr(made[r["k"]])
        assert r["whole"] == (made[r["k"]] is not None and plain.is_statement_date(made[r["k"]])), repr(made[r["k"]])


def test_wrapped_lines_and_four_columns(spark):
    glyphs = pages(spark)
    six = geometry.extract_statements(glyphs.filter("doc_id in ('six', 'gap')")).orderBy("doc_id", "txn_ord").collect()
    four = geometry.extract_statements(glyphs.filter("doc_id = 'four'"), ("date", "description", "amount", "balance")).orderBy("txn_ord").collect()
    for doc in (four, [r for r in six if r["doc_id"] == "six"], [r for r in six if r["doc_id"] == "gap"]):
        assert len(doc) == 12 and all(r["column_count_ok"] for r in doc)
        for k, r in enumerate(doc):
            assert r["amount_paise"] == -100 * (100 + 37 * k)
            assert r["description"] == f"UPI/DR/{k:04d}/SHOP" + (" continued, below" if k % 3 == 0 else "")
    assert geometry.extract_statements(glyphs.filter("doc_id = 'few'")).count() == 0


def test_flip_and_fixed_factor(spark):
    from pyspark.sql import functions as F

    flipped = geometry.flip_coordinates(spark.createDataFrame([(10.0, 90.0, 14.0, 82.0, 100.0)], "left double, top double, right double, bottom double, page_height double")).first()
    assert (flipped["x"], flipped["y"], flipped["w"], flipped["h"]) == (10.0, 10.0, 4.0, 8.0)
    rows = geometry.rows_of(geometry.cluster_rows(spark.createDataFrame([("d", i, c, 0, x, 0.0, 4.0, 8.0) for i, (c, x) in enumerate(zip("abcd", (0.0, 5.0, 10.0, 17.0)))], SCHEMA)))
    found = rows.select(geometry.glyph_text(F.col("glyphs"), 1.3).alias("near"), geometry.glyph_text(F.col("glyphs"), 1.5).alias("far")).first()
    assert (found["near"], found["far"]) == ("abc d", "abcd")
