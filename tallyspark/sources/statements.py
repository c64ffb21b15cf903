"""Readers and writers of glyph dumps and labelled statements, over the data sources of
``document_files``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import format_money, money
from tallyspark.operators.geometry import Pages, glyph_lists, page_rows
from tallyspark.sources import glyph_json
from tallyspark.sources.document_files import PACKED, DocumentTexts, GlyphDumps, LabelledStatements, glyph_rows

GLYPHS, TEXTS, LABELLED = GlyphDumps.name(), DocumentTexts.name(), LabelledStatements.name()


def register(spark: SparkSession) -> None:
    """Makes the formats ``glyph_dump``, ``document_text`` and ``labelled_statement`` known to a session."""
    spark.dataSource.register(GlyphDumps)
    spark.dataSource.register(DocumentTexts)
    spark.dataSource.register(LabelledStatements)


def read_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """Glyph dumps: each file is one JSON array, its name the doc_id, its order the glyph_ord."""
    register(spark)
    return spark.read.format(GLYPHS).load(path)


def stream_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """The dumps that are written to a folder, a document never cut between two micro-batches."""
    register(spark)
    return spark.readStream.format(GLYPHS).load(path)


def _by_document(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, order)


def _glyph_rows(glyphs: DataFrame) -> DataFrame:
    whole = ("doc_id", "string"), ("glyph_ord", "long"), ("text", "string"), ("page", "int"), *((c, "double") for c in "xywh")
    return _by_document(glyphs.select(*(F.col(c).cast(t).alias(c) for c, t in whole)), "doc_id", "glyph_ord")


def write_glyphs(glyphs: DataFrame, path: str, mode: str = "append") -> None:
    """One file a document: its JSON array, in glyph order."""
    register(glyphs.sparkSession)
    _glyph_rows(glyphs).write.format(GLYPHS).mode(mode).save(path)


def write_pages(pages: DataFrame | Pages, path: str, mode: str = "append", compression: str = "gzip") -> None:
    """``write_glyphs`` of pages (or of rows of doc_id, page, glyphs), each document's behind one another
    in one partition, as they are where a shuffle by doc_id made them; elsewhere the write is refused."""
    register(pages.sparkSession)
    pages = pages if isinstance(pages, Pages) else page_rows(pages)
    steps, decode, pack = pages.steps(), pages.decode, compression.lower() == "gzip"

    def dumped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_documents(steps(batches)):
            doc, g = part.column("doc_id"), decode(part)
            begins = np.append(0, _changes(doc))
            document = np.searchsorted(begins, g.page, side="right") - 1
            texts = list(glyph_json.dumps(g, part.column("page").to_numpy(zero_copy_only=False)[g.page], document, len(begins)))
            content = pa.array(map(glyph_json.packed, texts) if pack else texts, pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": doc.take(pa.array(begins)), "path": pa.nulls(len(texts), pa.string()), "size": pa.array(map(len, texts), pa.int64()), "content": content})

    pages.rows.mapInArrow(dumped, DocumentTexts.codec.schema).write.format(TEXTS).option("compression", compression).mode(mode).save(path)


def _changes(names: pa.Array) -> np.ndarray:
    """Where another name begins."""
    return np.flatnonzero(pc.fill_null(pc.not_equal(names.slice(1), names.slice(0, max(len(names) - 1, 0))), True).to_numpy(zero_copy_only=False)) + 1


def _whole_documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, so cut that the rows of a document that follow one another stay together."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        doc = part.column("doc_id")
        if held and held[-1].column("doc_id")[-1].as_py() != doc[0].as_py():
            yield pa.concat_batches(held)
            held = []
        begins = _changes(doc)
        if len(begins):
            yield pa.concat_batches([*held, part.slice(0, begins[-1])])
            held, part = [], part.slice(begins[-1])
        held.append(part)
    if held:
        yield pa.concat_batches(held)


def open_pages(spark: SparkSession, path: str) -> Pages:
    """``read_glyphs`` as whole pages; dumps are read where their pages are, many at a time."""
    register(spark)
    return page_rows(spark.read.format(TEXTS).load(path), _opened)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``read_glyphs`` with a row a page."""
    return glyph_lists(open_pages(spark, path))


def _opened(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    names, paths, contents = (batch.column(c) for c in ("doc_id", "path", "content"))
    held: list[tuple[str, str, bytes]] = []
    size = 0
    for name, path, content in zip(names.to_pylist(), paths.to_pylist(), contents):
        data = content.as_py()
        held.append((name, path, glyph_json.unpacked(data) if path.endswith(PACKED) else data))
        size += len(held[-1][2])
        if size >= glyph_json.STEP_BYTES:
            yield _pages(held)
            held, size = [], 0
    if held:
        yield _pages(held)


def _pages(held: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    names, paths, texts = zip(*held)
    return glyph_json.pages(names, list(texts), lambda k: glyph_rows(paths[k], texts[k]))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled statements, one row a transaction, in order; amounts are strict money strings. A
    statement without transactions is one row whose ord is null."""
    register(spark)
    rows = spark.read.format(LABELLED).load(path)
    return rows.select("statement_id", "issuer", "glyph_fixture", "ord", F.to_date("date").alias("date"), "description", money(F.col("amount")).alias("amount_paise"))


def write_labelled(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One file a statement, as ``read_labelled`` reads it."""
    register(rows.sparkSession)
    told = rows.select(
        *(F.col(c).cast("string").alias(c) for c in ("statement_id", "issuer", "glyph_fixture")), F.col("ord").cast("int").alias("ord"), F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("description").cast("string").alias("description"), format_money(F.col("amount_paise")).alias("amount"),
    )
    _by_document(told, "statement_id", "ord").write.format(LABELLED).mode(mode).save(path)
