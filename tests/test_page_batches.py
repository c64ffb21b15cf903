"""Pages many at a time against glyph rows a page at a time, and plain loops."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import geometry, pages
from tallyspark.plans import domain

from .test_pages import FOUR, SCHEMA, SIX, printed, statement


def plain_rows(y, h, tolerance):
    """The fold, glyph by glyph, of bottoms that ascend."""
    middle = sorted(h)[len(h) // 2]
    allowed, out, total, n = (middle if middle > 0 else 1.0) * tolerance, [], 0.0, 0
    for own in (a + b for a, b in zip(y, h)):
        if not out or abs(own - total / n) > allowed:
            out.append(out[-1] + 1 if out else 0)
            total, n = 0.0, 0
        else:
            out.append(out[-1])
        total, n = total + own, n + 1
    return out


@pytest.mark.parametrize("step", [0.0, 0.4, 2.0, 4.8, 4.800000000000001, 9.0])
def test_rows_of_many_pages_are_those_of_each(step):
    """Also where bottoms drift, so that only the running mean tells."""
    rng, made = random.Random(int(step * 10)), []
    for _ in range(40):
        y = np.cumsum([rng.choice([0.0, step, step / 2, rng.random() * 6]) for _ in range(rng.randrange(1, 40))])
        made.append((y.tolist(), [rng.choice([8.0, 8.0, 0.0])] * len(y)))
    flat = lambda k: np.array([v for page in made for v in page[k]])
    number = np.repeat(np.arange(len(made)), [len(y) for y, _ in made])
    n = len(number)
    g = pages.Glyphs(number, np.zeros(n), flat(0), np.ones(n), flat(1), np.arange(n), pa.array(["a"] * n))
    assert pages.number_rows(g, 0.6).tolist() == [r for y, h in made for r in plain_rows(y, h, 0.6)]


def glyphs():
    rng = random.Random(11)
    rows = [g for k in range(9) for g in statement(rng, f"doc{k}", SIX if k % 2 else FOUR, n=3 + 2 * k)]
    rows += [g[:3] + (1, *g[4:]) for g in statement(rng, "doc3", SIX, n=4)] + printed(rng, "none", 0, [(50.0, [(10.0, "01-02-24 one")]), (70.0, [(10.0, "no table")])])
    return rows + [("odd", 0, None, 0, 1.0, 1.0, 0.0, 0.0), ("odd", 1, "", 0, 9.0, 1.0, 4.0, 8.0), ("odd", 2, "₹₹", 0, 99.0, 1.0, 4.0, 8.0), ("odd", 3, "x", 0, 5.0, 40.0, 4.0, 8.0)]


def whole(spark):
    rows = spark.createDataFrame(glyphs(), SCHEMA)
    lists = rows.groupBy("doc_id", "page").agg(F.collect_list(F.struct("glyph_ord", "text", "x", "y", "w", "h")).alias("glyphs")).coalesce(1)
    return rows, geometry.page_rows(lists)


def rows_of(frame, columns):
    return sorted(map(str, frame.select(*columns).collect()))


def test_whole_pages_give_what_glyph_rows_give(spark, monkeypatch):
    rows, made = whole(spark)
    lines = geometry.rows_of(geometry.cluster_rows(rows))  # in column expressions
    columns = ["doc_id", "page", "row_id", "left", "right", "top", "bottom", "center_y", "text"]
    assert rows_of(geometry.read_rows(made), [*columns, "glyphs"]) == rows_of(lines, [*columns, "glyphs"])
    assert rows_of(geometry.read_texts(made), [*columns, "n_glyphs"]) == rows_of(lines.withColumn("n_glyphs", F.size("glyphs")), [*columns, "n_glyphs"])
    assert rows_of(geometry.count_rows(made), ["doc_id", "page", "n_rows"]) == rows_of(lines.groupBy("doc_id", "page").agg(F.count("*").alias("n_rows")), ["doc_id", "page", "n_rows"])
    table = geometry.locate_tables(lines)
    layouts = geometry.detect_columns(table.filter("is_anchor"))
    cells = ["doc_id", "page", "row_id", "row_ord", "center_y", "text", "is_anchor", "boundaries", "cells"]
    assert rows_of(geometry.read_tables(made), cells) == rows_of(geometry.split_cells(table, layouts), cells)
    assert rows_of(geometry.read_columns(made), layouts.columns) == rows_of(layouts, layouts.columns)
    counted = geometry.read_counted(made)
    assert rows_of(counted, sorted(counted.columns)) == rows_of(geometry.lay_out(geometry.counted_tables(lines)), sorted(counted.columns))
    band = {"page": 0, "from_y": 85.0, "to_y": 115.0}
    assert sorted(map(str, geometry.inspect_cells(made, **band).collect())) == sorted(map(str, geometry.inspect_cells(lines, **band).collect()))


def test_a_batch_is_taken_in_steps_and_no_page_is_cut():
    batch = pa.RecordBatch.from_pydict({"page": list(range(5)), "glyphs": [[0] * n for n in (1500, 400, 5000, 0, 10)]})
    assert [s.column("page").to_pylist() for s in geometry._steps(batch, "glyphs")] == [[0, 1], [2], [3, 4]]


def test_boundaries_do_not_depend_on_how_many_pages_meet(monkeypatch):
    g = sorted(glyphs(), key=lambda r: (r[0], r[3]))
    number = np.unique([f"{r[0]}/{r[3]}" for r in g], return_inverse=True)[1]
    arrays = [np.array([r[k] for r in g], float) for k in (4, 5, 6, 7)]
    lines = pages.read_lines(pages.Glyphs(number, *arrays, np.array([r[1] for r in g]), pa.array([r[2] for r in g])), 0.6)
    dated = pages.find_tables(lines, 3).dated
    together = pages.find_boundaries(lines, dated, 1.5, 0.9, 5.0, 2.0)
    monkeypatch.setattr(pages, "MATRIX", 1)
    apart = pages.find_boundaries(lines, dated, 1.5, 0.9, 5.0, 2.0)
    assert len(together[0]) and all(np.array_equal(a, b) for a, b in zip(together, apart))


def test_printed_pages_hold_the_glyphs_of_the_rows(spark, sf):
    """The same characters at the same places, and one shuffle, of lines, where glyphs were shuffled too."""
    for made, rows in [(domain.pages(spark, sf), domain.glyphs(spark, sf)), *zip(domain.uneven_pages(spark, sf), domain.uneven_glyphs(spark, sf))]:
        found = geometry.cluster_rows(made)
        columns = ["doc_id", "page", "glyph_ord", "text", "x", "y", "w", "h"]
        assert found.select(*columns).exceptAll(rows.select(*columns)).isEmpty() and found.count() == rows.count()
    plan = geometry.read_tables(domain.pages(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
