"""From positioned glyphs to typed table rows.

Glyphs: doc_id, glyph_ord, text, page, x, y, w, h (origin top left, y down), a row each or whole pages
(``Pages``). A page is small and its glyphs belong together, so Arrow calls do the numeric work on whole
pages (``pages``): of rows a page at a time, of pages many at a time and without a shuffle. Between and
after them lie column expressions and windows over lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import amount, mask_structure, signed_amount, split_amount, starts_with_date, statement_date, trim
from tallyspark.operators import pages as kernels
from tallyspark.operators.pages import Glyphs, Lines, Tables

PAGE = ("doc_id", "page")
ROLES = ("date", "reference", "description", "debit", "credit", "amount", "balance", "ignore")
BANK_PASSBOOK = ("date", "description", "reference", "credit", "debit", "balance")


def flip_coordinates(df: DataFrame, page_height: str = "page_height") -> DataFrame:
    """Bottom-origin rectangles (left, top, right, bottom) to x, y, w, h with y down."""
    return df.withColumns({"x": F.col("left"), "y": F.col(page_height) - F.col("top"), "w": F.col("right") - F.col("left"), "h": F.col("top") - F.col("bottom")})


#: Entries of ``Pages.size`` that one step of numpy takes at once, a page at least; of glyphs where they lie in lists.
STEP, STEP_GLYPHS = 2_000, 100_000


@dataclass(frozen=True)
class Pages:
    """Glyphs as whole pages: a row of ``rows`` is a page (doc_id, page and what ``decode`` reads), and
    ``decode`` makes the rows of a batch flat glyphs, numbered by row. ``size`` names the list column that
    tells how much a row holds, and ``step`` how many of its entries, a page at least, one step of numpy
    takes. Where rows aren't pages yet, ``opened`` makes batches of pages of a batch of rows. Such glyphs
    are never shuffled, and become no rows of their own."""

    rows: DataFrame
    decode: Callable[[pa.RecordBatch], Glyphs]
    size: str
    step: int = STEP
    opened: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None

    @property
    def sparkSession(self):
        return self.rows.sparkSession

    def steps(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Batches of ``rows`` as runs of whole pages, for use in a task."""
        opened, size, step = self.opened, self.size, self.step
        return lambda batches: (part for batch in batches for made in (opened(batch) if opened else (batch,)) for part in _steps(made, size, step))


def page_rows(glyphs: DataFrame, opened: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None) -> Pages:
    """Rows of doc_id, page and a list of glyphs (glyph_ord, text, x, y, w, h) as pages, or rows of which
    ``opened`` makes such."""
    return Pages(glyphs, _decode_lists, "glyphs", STEP_GLYPHS, opened)


def glyph_lists(pages: Pages) -> DataFrame:
    """What ``page_rows`` takes, of any pages: doc_id, page, glyphs."""

    def listed(doc: pa.Array, page: pa.Array, g: Glyphs) -> dict:
        held = np.unique(g.page)
        starts = np.append(np.searchsorted(g.page, held), len(g.page))
        own = pa.StructArray.from_arrays([pa.array(g.ids), g.text, *(pa.array(getattr(g, c)) for c in "xywh")], ["glyph_ord", "text", *"xywh"])
        return _named(doc, page, held) | {"glyphs": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), own)}

    return _over_pages(pages, listed, "doc_id string, page int, glyphs array<struct<glyph_ord:bigint,text:string,x:double,y:double,w:double,h:double>>")


def _decode_lists(batch: pa.RecordBatch) -> Glyphs:
    lists = batch.column("glyphs")
    values = lists.flatten()
    page = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    x, y, w, h, ids = (values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "w", "h", "glyph_ord"))
    return Glyphs(page, x, y, w, h, ids, values.field("text"))


def _steps(batch: pa.RecordBatch, size: str, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batch by runs of whole rows."""
    held = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(size)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        room = step + (held[start - 1] if start else 0)
        stop = max(int(np.searchsorted(held, room, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _over_pages(glyphs: DataFrame | Pages, work: Callable[[pa.Array, pa.Array, Glyphs], dict], schema: str) -> DataFrame:
    """``work`` on the names and numbers of pages and their glyphs."""
    if isinstance(glyphs, Pages):
        decode, steps, names = glyphs.decode, glyphs.steps(), [c.split()[0] for c in schema.split(", ")]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in steps(batches):
                found = work(part.column("doc_id"), part.column("page"), decode(part))
                yield pa.RecordBatch.from_pydict({c: found[c] for c in names})

        return glyphs.rows.mapInArrow(each, schema)

    def one(key: tuple[pa.Scalar, ...], page: pa.Table) -> pa.Table:
        x, y, w, h, ids = (page[c].to_numpy() for c in ("x", "y", "w", "h", "glyph_ord"))
        text = pa.concat_arrays([pa.array([], pa.string()), *page["text"].chunks])
        found = work(pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), Glyphs(np.zeros(len(x), np.int64), x, y, w, h, ids, text))
        return pa.table(found)

    return _glyph_columns(glyphs).groupBy(*PAGE).applyInArrow(one, schema)


def _named(doc: pa.Array, page: pa.Array, of: np.ndarray) -> dict[str, pa.Array]:
    of = pa.array(of)
    return {"doc_id": doc.take(of), "page": page.take(of)}


def cluster_rows(glyphs: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """Adds row_id (from 0, top down, per page): a glyph joins the open row if its bottom lies within
    ``tolerance`` upper-median glyph heights of the mean bottom of the row so far."""

    def number(doc: pa.Array, page: pa.Array, g: Glyphs) -> dict:
        own = _named(doc, page, g.page) | {"glyph_ord": pa.array(g.ids), "text": g.text, "row_id": pa.array(kernels.number_rows(g, tolerance))}
        return own | {c: pa.array(getattr(g, c)) for c in "xywh"}

    return _over_pages(glyphs, number, "doc_id string, glyph_ord long, text string, page int, x double, y double, w double, h double, row_id long")


def count_rows(glyphs: DataFrame | Pages, tolerance: float = 0.6) -> DataFrame:
    """doc_id, page, n_rows: the rows that ``cluster_rows`` numbers on each page."""

    def count(doc: pa.Array, page: pa.Array, g: Glyphs) -> dict:
        last = np.flatnonzero(np.append(g.page[1:] != g.page[:-1], True)) if len(g.page) else np.zeros(0, np.int64)
        row, begins = kernels.number_rows(g, tolerance), np.append(0, last[:-1] + 1) if len(last) else last
        most = np.maximum.reduceat(row, begins) if len(last) else np.zeros(0, np.int64)
        return _named(doc, page, g.page[last]) | {"n_rows": pa.array(most + 1)}

    return _over_pages(glyphs, count, "doc_id string, page int, n_rows long")


_GLYPHS = "array<struct<x:double,glyph_ord:bigint,w:double,text:string>>"
_PLACED = "doc_id string, page int, row_id long, left double, right double, top double, bottom double"
_LINE = f"{_PLACED}, glyphs {_GLYPHS}, center_y double, text string"


def _placed(doc: pa.Array, page: pa.Array, p: Lines) -> dict:
    return _named(doc, page, p.page) | {"row_id": pa.array(p.row), **{c: pa.array(getattr(p, c)) for c in ("left", "right", "top", "bottom")}}


def _glyph_columns(glyphs: DataFrame) -> DataFrame:
    return glyphs.select("doc_id", "page", *(F.col(c).cast("double").alias(c) for c in "xywh"), "glyph_ord", "text")


def read_rows(glyphs: DataFrame | Pages, tolerance: float = 0.6) -> DataFrame:
    """``rows_of(cluster_rows(glyphs))`` in one pass over the pages."""

    def read(doc: pa.Array, page: pa.Array, g: Glyphs) -> dict:
        p = kernels.read_lines(g, tolerance)
        own = pa.StructArray.from_arrays([pa.array(p.x, pa.float64()), pa.array(p.ids, pa.int64()), pa.array(p.w, pa.float64()), p.texts], ["x", "glyph_ord", "w", "text"])
        return _placed(doc, page, p) | {"glyphs": pa.ListArray.from_arrays(pa.array(p.starts, pa.int32()), own), "center_y": pa.array(p.center_y), "text": p.text}

    return _over_pages(glyphs, read, _LINE)


def read_texts(glyphs: DataFrame | Pages, tolerance: float = 0.6) -> DataFrame:
    """``read_rows`` with the number of a line's glyphs, n_glyphs, in the place of their list."""

    def read(doc: pa.Array, page: pa.Array, g: Glyphs) -> dict:
        p = kernels.read_lines(g, tolerance)
        return _placed(doc, page, p) | {"n_glyphs": pa.array(np.diff(p.starts), pa.int32()), "center_y": pa.array(p.center_y), "text": p.text}

    return _over_pages(glyphs, read, f"{_PLACED}, n_glyphs int, center_y double, text string")


def glyph_array() -> Column:
    """The row's glyphs left to right: array<struct<x, glyph_ord, w, text>>."""
    return F.array_sort(F.collect_list(F.struct("x", "glyph_ord", "w", "text")))


def pitches(glyphs: Column) -> Column:
    n = F.size(glyphs)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.element_at(glyphs, i)["x"] - F.element_at(glyphs, i - 1)["x"])
    )


def typical_pitch(glyphs: Column) -> Column:
    """Lower median of the advances, 0 if there are none."""
    p = F.sort_array(pitches(glyphs))
    return F.coalesce(F.try_element_at(p, F.floor((F.size(p) - 1) / 2).cast("int") + 1), F.lit(0.0))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def space_threshold(advances: Column) -> Column:
    """The middle of the first jump by more than half, from the lower median up; else infinity."""

    def scan(p: Column) -> Column:
        start = F.floor((F.size(p) - 1) / 2).cast("int") + 1
        jumps = F.filter(F.sequence(start, F.size(p) - 1), lambda i: (F.element_at(p, i) > 0) & (F.element_at(p, i + 1) / F.element_at(p, i) > 1.5))
        first = F.try_element_at(jumps, F.lit(1))
        return F.when(F.size(p) < 2, F.lit(float("inf"))).otherwise(F.coalesce((F.try_element_at(p, first) + F.try_element_at(p, first + 1)) / 2, F.lit(float("inf"))))

    return _let(F.sort_array(advances), lambda p: F.when(F.size(p) < 2, F.lit(float("inf"))).otherwise(scan(p)))


def glyph_text(glyphs: Column, fixed_factor: float | None = None) -> Column:
    """The glyphs' text with a space wherever an advance exceeds the row's own threshold (or, with
    ``fixed_factor``, that many typical pitches). Null without glyphs."""

    def joined(g: Column) -> Column:
        typical = typical_pitch(g)
        limit = space_threshold(pitches(g)) if fixed_factor is None else F.when(typical <= 0, F.lit(float("inf"))).otherwise(typical * fixed_factor)
        return _let(limit, lambda t: F.array_join(F.transform(g, lambda x, i: F.concat(
            F.when((i > 0) & (x["x"] - F.element_at(g, F.greatest(i, F.lit(1)))["x"] > t), F.lit(" ")).otherwise(F.lit("")), x["text"])), ""))

    return _let(glyphs, lambda g: F.when(F.size(g) > 0, joined(g)))


def rows_of(clustered: DataFrame) -> DataFrame:
    """One row a printed line: its box, its glyphs left to right, and its text."""
    rows = clustered.groupBy(*PAGE, "row_id").agg(
        F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"), glyph_array().alias("glyphs"),
    )
    return rows.withColumn("center_y", (F.col("top") + F.col("bottom")) / 2).withColumn("text", glyph_text(F.col("glyphs")))


def mark_tables(rows: DataFrame, min_anchors: int = 3) -> DataFrame:
    """Adds is_anchor (starts with a date) and in_table: from the page's first anchor to its last, and
    one upper-median anchor gap below. A page with few anchors has no table."""
    page = Window.partitionBy(*PAGE)
    down = page.orderBy("center_y", "row_id")
    marked = rows.withColumn("is_anchor", starts_with_date(F.col("text")))
    centre = F.when(F.col("is_anchor"), F.col("center_y"))
    marked = marked.withColumn("_gap", F.when(F.col("is_anchor"), F.col("center_y") - F.last(centre, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))))
    gaps = F.sort_array(F.collect_list("_gap").over(page))
    marked = marked.withColumns({"_from": F.min(centre).over(page), "_to": F.max(centre).over(page), "_n": F.count_if("is_anchor").over(page), "_slack": F.coalesce(F.try_element_at(gaps, F.floor(F.size(gaps) / 2).cast("int") + 1), F.lit(0.0))})
    inside = (F.col("_n") >= min_anchors) & (F.col("center_y") >= F.col("_from")) & (F.col("center_y") <= F.col("_to") + F.col("_slack"))
    return marked.withColumn("in_table", F.coalesce(inside, F.lit(False))).drop("_gap", "_from", "_to", "_n", "_slack")


def locate_tables(rows: DataFrame, min_anchors: int = 3) -> DataFrame:
    """The marked rows of each page's table, with row_ord from 0."""
    down = Window.partitionBy(*PAGE).orderBy("center_y", "row_id")
    return mark_tables(rows, min_anchors).filter("in_table").drop("in_table").withColumn("row_ord", F.row_number().over(down) - 1)


def counted_tables(rows: DataFrame, min_anchors: int = 3) -> DataFrame:
    """``locate_tables`` with every page's counts: the page's first row, which stays even where it is
    in no table, has page_glyphs, page_rows and page_tables; in_table tells the rows apart."""
    page = Window.partitionBy(*PAGE)
    down = page.orderBy("center_y", "row_id")
    marked = mark_tables(rows, min_anchors).withColumn("_top", F.row_number().over(down) == 1)
    marked = marked.withColumns({
        "row_ord": F.sum(F.col("in_table").cast("int")).over(down) - 1,
        "page_glyphs": F.when(F.col("_top"), F.sum(F.size("glyphs")).over(page)),
        "page_rows": F.when(F.col("_top"), F.count("*").over(page)),
        "page_tables": F.when(F.col("_top"), F.max(F.col("in_table").cast("bigint")).over(page)),
    })
    kept = marked.filter(F.col("in_table") | F.col("_top")).drop("_top")
    return kept.withColumn("glyphs", F.when(F.col("in_table"), F.col("glyphs")).otherwise(F.array().cast(_GLYPHS)))


def _lines(table: pa.Table) -> Lines:
    """Lines that lie in rows, as those of one page."""
    lists = table["glyphs"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values, n = lists.flatten(), table.num_rows
    starts = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
    x, w, ids = (values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "w", "glyph_ord"))
    left, right = table["left"].to_numpy(), table["right"].to_numpy()
    text, pitch = kernels.read_texts(x, values.field("text"), starts)
    none = np.zeros(n, np.int64)
    return Lines(none, none, starts, x, w, ids, values.field("text"), left, right, left, right, pitch, text)


def detect_columns(anchors: DataFrame, bin_width: float = 1.5, clear: float = 0.9, min_gap: float = 5.0, min_pitches: float = 2.0) -> DataFrame:
    """doc_id, page, left, right, boundaries: runs of x-bins that most anchor rows leave empty, where
    the gap is wide against the text's own pitch."""

    def detect(key: tuple[pa.Scalar, ...], page: pa.Table) -> pa.Table:
        lines = _lines(page)
        _, found = kernels.find_boundaries(lines, np.arange(len(lines.left)), bin_width, clear, min_gap, min_pitches)
        return pa.table({
            "doc_id": pa.array([key[0].as_py()], pa.string()), "page": pa.array([key[1].as_py()], pa.int32()),
            "left": pa.array([lines.left.min()]), "right": pa.array([lines.right.max()]), "boundaries": pa.array([found], pa.list_(pa.float64())),
        })

    return anchors.select(*PAGE, "left", "right", "glyphs").groupBy(*PAGE).applyInArrow(detect, "doc_id string, page int, left double, right double, boundaries array<double>")


_COUNTS = ("in_table", "page_glyphs", "page_rows", "page_tables")


def lay_out(table: DataFrame, bin_width: float = 1.5, clear: float = 0.9, min_gap: float = 5.0, min_pitches: float = 2.0, by: Sequence[str] = PAGE) -> DataFrame:
    """``split_cells(table, detect_columns(table.filter("is_anchor")))`` in one pass over each page's
    table: doc_id, page, row_id, row_ord, center_y, text, is_anchor, boundaries, cells.

    Of ``counted_tables`` the counts stay, and a row that is in no table has no cells. ``by``: what has
    columns in common, a page or a document.
    """
    counts = [c for c in _COUNTS if c in table.columns]

    def lay(key: tuple[pa.Scalar, ...], page: pa.Table) -> pa.Table:
        lines = _lines(page)
        inside = page["in_table"].to_numpy() if counts else np.ones(page.num_rows, bool)
        found = kernels.find_boundaries(lines, np.flatnonzero(page["is_anchor"].to_numpy() & inside), bin_width, clear, min_gap, min_pitches)
        cells = kernels.split_cells(lines, found, np.arange(len(inside)), inside)
        kept = {c: page[c] for c in ("doc_id", "page", "row_id", "row_ord", "center_y", "text", "is_anchor", *counts)}
        return pa.table(kept | {"boundaries": kernels.boundary_lists(lines.page, found), "cells": cells})

    own = table.select(*PAGE, "row_id", F.col("row_ord").cast("int").alias("row_ord"), "center_y", "text", "is_anchor", "left", "right", "glyphs", *counts)
    told = "".join(f", {c} {'boolean' if c == 'in_table' else 'long'}" for c in counts)
    return own.groupBy(*by).applyInArrow(lay, f"doc_id string, page int, row_id long, row_ord int, center_y double, text string, is_anchor boolean{told}, boundaries array<double>, cells array<string>")


def column_of(boundaries: Column, x: Column) -> Column:
    """The index of the column that holds x."""
    return F.size(F.filter(boundaries, lambda b: b <= x))


def split_cells(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """Adds cells: each column's text, null where a row leaves it empty."""
    placed = rows.join(layouts.select(*PAGE, "boundaries"), list(PAGE))
    cells = F.transform(F.sequence(F.lit(0), F.size("boundaries")), lambda c: glyph_text(F.filter("glyphs", lambda g: column_of(F.col("boundaries"), g["x"] + g["w"] / 2) == c)))
    return placed.withColumn("cells", cells)


def typed_rows(cells: DataFrame, schema: Sequence[str] = BANK_PASSBOOK, unsigned_is_debit: bool = True) -> DataFrame:
    """The rows' date, description, amount_paise and balance_paise by the schema's roles, whether the
    columns are as many as the roles, and starts: a row with a date and an amount."""

    def cell(role: str) -> Column:
        k = schema.index(role) if role in schema else None
        return F.lit(None).cast("string") if k is None else trim(F.try_element_at("cells", F.lit(k + 1)))

    if "amount" in schema:
        value = signed_amount(cell("amount"), unsigned_is_debit)
    else:
        value = split_amount(cell("debit"), cell("credit"))
    typed = cells.select(
        *PAGE, "row_ord", statement_date(cell("date")).alias("date"), F.coalesce(cell("description"), F.lit("")).alias("description"),
        value.alias("amount_paise"), amount(cell("balance"))["paise"].alias("balance_paise"), (F.size("cells") == len(schema)).alias("column_count_ok"),
        *(c for c in _COUNTS if c in cells.columns),
    )
    return typed.withColumn("starts", F.col("date").isNotNull() & F.col("amount_paise").isNotNull())


def extract_transactions(cells: DataFrame, schema: Sequence[str] = BANK_PASSBOOK, unsigned_is_debit: bool = True) -> DataFrame:
    """doc_id, page, txn_ord, date, description, amount_paise, balance_paise, column_count_ok.

    A row with a date and an amount starts a transaction; one with neither amount nor emptiness in
    its description continues the one above it on the page; any other row is dropped.
    """
    down = Window.partitionBy(*PAGE).orderBy("row_ord")
    typed = typed_rows(cells, schema, unsigned_is_debit).withColumn("txn_ord", F.sum(F.col("starts").cast("int")).over(down))
    kept = typed.filter((F.col("txn_ord") > 0) & (F.col("starts") | (F.col("amount_paise").isNull() & (F.col("description") != ""))))
    first = lambda c: F.max(F.when(F.col("starts"), F.col(c)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "description"))), lambda s: s["description"])
    return kept.groupBy(*PAGE, "txn_ord").agg(first("date").alias("date"), trim(F.array_join(lines, " ")).alias("description"), first("amount_paise").alias("amount_paise"), first("balance_paise").alias("balance_paise"), first("column_count_ok").alias("column_count_ok"))


_LAID = "doc_id string, page int, row_id long, row_ord int, center_y double, text string, is_anchor boolean, boundaries array<double>, cells array<string>"


def read_tables(glyphs: DataFrame | Pages, tolerance: float = 0.6, min_anchors: int = 3, bin_width: float = 1.5, clear: float = 0.9, min_gap: float = 5.0, min_pitches: float = 2.0) -> DataFrame:
    """``lay_out(locate_tables(read_rows(glyphs)))`` in one pass over the pages."""

    def lay(doc: pa.Array, page: pa.Array, g: Glyphs) -> dict:
        p = kernels.read_lines(g, tolerance)
        t = kernels.find_tables(p, min_anchors)
        found, own = kernels.find_boundaries(p, t.dated, bin_width, clear, min_gap, min_pitches), t.down[t.inside]
        return _laid(doc, page, p, t, own, kernels.counted_up(p.page[own]), found, kernels.split_cells(p, found, own))

    return _over_pages(glyphs, lay, _LAID)


def _laid(doc: pa.Array, page: pa.Array, p: Lines, t: Tables, own: np.ndarray, row_ord: np.ndarray, found: tuple, cells: pa.Array) -> dict:
    at = pa.array(own)
    return _named(doc, page, p.page[own]) | {
        "row_id": pa.array(p.row[own]), "row_ord": pa.array(row_ord, pa.int32()), "center_y": pa.array(p.center_y[own]), "text": p.text.take(at), "is_anchor": pa.array(t.anchor[own]),
        "boundaries": kernels.boundary_lists(p.page[own], found), "cells": cells,
    }


def read_counted(glyphs: DataFrame | Pages, tolerance: float = 0.6, min_anchors: int = 3, bin_width: float = 1.5, clear: float = 0.9, min_gap: float = 5.0, min_pitches: float = 2.0) -> DataFrame:
    """``lay_out(counted_tables(read_rows(glyphs)))`` in one pass over the pages."""

    def lay(doc: pa.Array, page: pa.Array, g: Glyphs) -> dict:
        p = kernels.read_lines(g, tolerance)
        t = kernels.find_tables(p, min_anchors)
        found, of = kernels.find_boundaries(p, t.dated, bin_width, clear, min_gap, min_pitches), p.page[t.down]
        top = np.append(True, of[1:] != of[:-1])[: len(of)]
        number = len(doc)
        table = np.bincount(of, weights=t.inside, minlength=number)
        before = np.cumsum(t.inside)
        row_ord = before - np.append(0, np.cumsum(table)[:-1]).astype(np.int64)[of] - 1
        counts = {
            "page_glyphs": np.bincount(p.page, weights=np.diff(p.starts), minlength=number).astype(np.int64), "page_rows": np.bincount(of, minlength=number), "page_tables": (table > 0).astype(np.int64),
        }
        kept = t.inside | top
        own, inside = t.down[kept], t.inside[kept]
        laid = _laid(doc, page, p, t, own, row_ord[kept], found, kernels.split_cells(p, found, own, inside))
        return laid | {"in_table": pa.array(inside), **{c: pa.array(n[of[kept]], pa.int64(), mask=~top[kept]) for c, n in counts.items()}}

    return _over_pages(glyphs, lay, f"{_LAID}, in_table boolean, page_glyphs long, page_rows long, page_tables long")


def read_columns(glyphs: DataFrame | Pages, tolerance: float = 0.6, min_anchors: int = 3, bin_width: float = 1.5, clear: float = 0.9, min_gap: float = 5.0, min_pitches: float = 2.0) -> DataFrame:
    """``detect_columns(locate_tables(read_rows(glyphs)).filter("is_anchor"))`` in one pass over the pages."""

    def detect(doc: pa.Array, page: pa.Array, g: Glyphs) -> dict:
        p = kernels.read_lines(g, tolerance)
        t = kernels.find_tables(p, min_anchors)
        found = kernels.find_boundaries(p, t.dated, bin_width, clear, min_gap, min_pitches)
        own, begins = np.unique(p.page[t.dated], return_index=True)
        edge = lambda f, v: pa.array(f.reduceat(v[t.dated], begins) if len(own) else np.zeros(0))
        return _named(doc, page, own) | {"left": edge(np.minimum, p.left), "right": edge(np.maximum, p.right), "boundaries": kernels.boundary_lists(own, found)}

    return _over_pages(glyphs, detect, "doc_id string, page int, left double, right double, boundaries array<double>")


def extract_statements(glyphs: DataFrame | Pages, schema: Sequence[str] = BANK_PASSBOOK) -> DataFrame:
    """Glyphs to transactions."""
    return extract_transactions(read_tables(glyphs), schema)


def _within(rows: DataFrame, page: int | None, from_y: float | None, to_y: float | None) -> DataFrame:
    for test in (F.col("page") == page if page is not None else None, F.col("center_y") >= from_y if from_y is not None else None, F.col("center_y") <= to_y if to_y is not None else None):
        rows = rows if test is None else rows.filter(test)
    return rows


def inspect_rows(rows: DataFrame, page: int | None = None, from_y: float | None = None, to_y: float | None = None, limit: int = 60) -> DataFrame:
    """Masked text of the rows of a page and band, top down; ``limit`` is the report's length."""
    shown = _within(rows, page, from_y, to_y).select(*PAGE, "row_id", "center_y", mask_structure(F.col("text")).alias("masked"))
    return shown.orderBy(*PAGE, "center_y", "row_id").limit(limit)


def inspect_cells(rows: DataFrame | Pages, page: int | None = None, from_y: float | None = None, to_y: float | None = None, limit: int = 60, masked: bool = True) -> DataFrame:
    """The report's cells mode: columns are found over all rows of a document's pages and band, not the
    dated ones alone; one row a cell, doc_id, page, row_id, center_y, column (from 0) and its text, by default
    masked, null where the row leaves the column empty. ``limit`` counts lines. ``rows``: as ``read_rows``
    reads them, or pages, where ``page`` is given."""
    if isinstance(rows, Pages):
        laid = _band_cells(rows, page, from_y, to_y)
    else:
        laid = lay_out(_within(rows, page, from_y, to_y).withColumns({"is_anchor": F.lit(True), "row_ord": F.lit(0)}), by=("doc_id",))
    laid = laid.orderBy(*PAGE, "center_y", "row_id").limit(limit)
    cells = laid.select(*PAGE, "row_id", "center_y", F.posexplode("cells").alias("column", "text"))
    return cells.withColumn("text", mask_structure(F.col("text"))) if masked else cells


def _band_cells(pages: Pages, page: int | None, from_y: float | None, to_y: float | None) -> DataFrame:
    if page is None:
        raise ValueError("columns of several pages are found over their rows")

    def lay(doc: pa.Array, number: pa.Array, g: Glyphs) -> dict:
        p = kernels.read_lines(g, 0.6)
        y = p.center_y
        own = np.flatnonzero((y >= (-np.inf if from_y is None else from_y)) & (y <= (np.inf if to_y is None else to_y)))
        found = kernels.find_boundaries(p, own, 1.5, 0.9, 5.0, 2.0)
        return _named(doc, number, p.page[own]) | {"row_id": pa.array(p.row[own]), "center_y": pa.array(y[own]), "cells": kernels.split_cells(p, found, own)}

    if opened := pages.opened:
        chosen = replace(pages, opened=lambda batch: (made.filter(pc.field("page") == page) for made in opened(batch)))
    else:
        chosen = replace(pages, rows=pages.rows.filter(F.col("page") == page))
    return _over_pages(chosen, lay, "doc_id string, page int, row_id long, center_y double, cells array<string>")
