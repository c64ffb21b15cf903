"""An import as one run over glyphs, and the events that tell of it.

The glyphs are read once. Each of the three steps (lines laid out, transactions, merchants) writes a
table, so a lost executor costs a re-read of files; the counts that the events name are observed
while a step runs. Spark may count rows of a recomputed stage twice in such observations, so the
result's figures are aggregated from the tables.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import geometry, merchants, quality
from tallyspark.sources.storage import fresh_path, written

# An import's stages in order, as they are shown, and what a failure says.
STAGES = {
    "reading": "Reading the PDF", "extractingGlyphs": "Extracting glyphs", "clusteringRows": "Finding rows", "detectingColumns": "Detecting columns",
    "extractingTransactions": "Reading transactions", "resolvingMerchants": "Identifying merchants", "done": "Done",
}
NEEDS_PASSWORD, UNREADABLE = "This statement needs a password.", "Could not read this statement: "


@dataclass(frozen=True)
class ImportEvent:
    """kind: progress (with a stage), succeeded (with the result's figures) or failed (with a message)."""

    seq: int
    kind: str
    stage: str | None = None
    detail: str | None = None
    needs_password: bool = False
    figures: dict | None = None
    elapsed_ms: int = 0

    @property
    def label(self) -> str | None:
        return STAGES.get(self.stage or "")


@dataclass(frozen=True)
class ImportResult:
    """Null frames where the import failed."""

    events: list[ImportEvent]
    transactions: DataFrame | None = None
    report: DataFrame | None = None


class _Told:
    """Events in order, each handed to the listener as it happens."""

    def __init__(self, listen: Callable[[ImportEvent], None] | None):
        self.events: list[ImportEvent] = []
        self.listen, self.began = listen, time.monotonic()

    def __call__(self, kind: str, stage: str | None = None, detail: str | None = None, needs_password: bool = False, figures: dict | None = None) -> None:
        event = ImportEvent(len(self.events) + 1, kind, stage, detail, needs_password, figures, int(1000 * (time.monotonic() - self.began)))
        self.events.append(event)
        if self.listen:
            self.listen(event)


def run_import(spark: SparkSession, source: Callable[[], DataFrame | geometry.Pages], schema: Sequence[str] = geometry.BANK_PASSBOOK, aliases: DataFrame | None = None, listen: Callable[[ImportEvent], None] | None = None, folder: str | None = None) -> ImportResult:
    """Imports the glyphs that ``source`` opens and tells of it: seven stages and then the success, or a
    failure in their place from the step that fails. A failure is told, not raised; one that names a
    password asks for one. ``folder``: where the tables go, spark.checkpoint.dir by default."""
    tell = _Told(listen)
    try:
        tell("progress", "reading")
        glyphs = source()
        tell("progress", "extractingGlyphs")
        counted = geometry.read_counted(glyphs)
        tell("progress", "clusteringRows")
        seen = Observation("lines")
        laid = written(counted.observe(seen, F.sum("page_rows").alias("rows"), F.sum("page_tables").alias("tables")), fresh_path(spark, "lines", folder))
        rows, tables = (seen.get.get(c) or 0 for c in ("rows", "tables"))
        tell("progress", "detectingColumns", f"{rows} rows")
        tell("progress", "extractingTransactions", f"{tables} {'table' if tables == 1 else 'tables'}")
        seen = Observation("transactions")
        found = geometry.extract_transactions(laid, schema).withColumn("txn_id", F.concat_ws(":", "doc_id", "page", "txn_ord")).observe(seen, F.count(F.lit(1)).alias("n"))
        found = written(found, fresh_path(spark, "transactions", folder))
        tell("progress", "resolvingMerchants", f"{seen.get['n']} transactions")
        settled = merchants.resolve(found, "txn_id", "description", aliases)
        named = found.join(settled.drop("raw"), "txn_id").drop("txn_id")
        named = written(named, fresh_path(spark, "imported", folder))
        report = quality.extraction_report(geometry.typed_rows(laid, schema))
        figures = quality.import_metrics(report, named.withColumn("raw", F.col("description"))).first().asDict()
        tell("progress", "done")
        tell("succeeded", figures=figures)
        return ImportResult(tell.events, named, report)
    except Exception as error:  # whatever it is, the one who waits for events is told
        message = str(error)
        asks = "password" in message.lower()
        tell("failed", detail=NEEDS_PASSWORD if asks else UNREADABLE + message, needs_password=asks)
        return ImportResult(tell.events)


_FIGURES = ("glyphs", "rows", "tables", "transactions", "checked", "mismatches", "unresolved", "unknown_payees")


def event_rows(spark: SparkSession, events: list[ImportEvent]) -> DataFrame:
    """Events as a table, the figures of a success as columns."""
    rows = [(e.seq, e.kind, e.stage, e.label, e.detail, e.needs_password, *((e.figures or {}).get(c) for c in (*_FIGURES, "consistency"))) for e in events]
    return spark.createDataFrame(rows, "seq int, kind string, stage string, label string, detail string, needs_password boolean, " + ", ".join(f"{c} long" for c in _FIGURES) + ", consistency double")


def follow_imports(stream: DataFrame, imported: Callable[[ImportResult, int], None], checkpoint: str, schema: Sequence[str] = geometry.BANK_PASSBOOK, listen: Callable[[int, ImportEvent], None] | None = None):
    """Imports each micro-batch of a stream of glyphs (whole documents, as the glyph dump source hands
    them out) and passes on its result; ``listen`` is told the batch and the event. The started query."""

    def one(batch: DataFrame, number: int) -> None:
        held = written(batch, fresh_path(batch.sparkSession, "arrived"), keep=False)
        imported(run_import(batch.sparkSession, lambda: held, schema, listen=listen and (lambda e: listen(number, e))), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
