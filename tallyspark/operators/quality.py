"""Checks of an extraction: running balances, multiset scores, import metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import normalise_description


def reconcile(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adjacent rows whose balances are both known: expected, actual and drift."""
    step = Window.partitionBy(key).orderBy(*order)
    before = F.lag("balance_paise").over(step)
    checked = rows.withColumn("expected_paise", before + F.col("amount_paise")).withColumn("position", F.row_number().over(step) - 1)
    checked = checked.filter("expected_paise is not null and balance_paise is not null")
    return checked.select(key, "position", "expected_paise", F.col("balance_paise").alias("actual_paise"), (F.col("balance_paise") - F.col("expected_paise")).alias("drift_paise"))


def consistency(reconciled: DataFrame, key: str, all_keys: DataFrame) -> DataFrame:
    """Checked pairs, mismatches and their share for every key; 1 where nothing was checked."""
    found = reconciled.groupBy(key).agg(F.count("*").alias("checked"), F.count_if(F.col("drift_paise") != 0).alias("mismatches"))
    rows = all_keys.select(key).distinct().join(found, key, "left").na.fill(0, ["checked", "mismatches"])
    share = F.when(F.col("checked") == 0, 1.0).otherwise((F.col("checked") - F.col("mismatches")) / F.col("checked"))
    return rows.withColumn("consistency", F.round(share, 6))


def match_key(strict: bool) -> list[Column]:
    key = [F.col("date"), F.col("amount_paise")]
    return [*key, normalise_description(F.col("description")).alias("norm")] if strict else key


def _numbered(df: DataFrame, group: str, strict: bool, newest_first: bool = False) -> DataFrame:
    keys = match_key(strict)
    order = F.col("ord").desc() if newest_first else F.col("ord")
    return df.withColumn("n", F.row_number().over(Window.partitionBy(group, *keys).orderBy(order))).withColumn("k", F.struct(*keys))


def extraction_score(truth: DataFrame, predicted: DataFrame, group: str, strict: bool = False) -> DataFrame:
    """Multiset matches, precision, recall and F1 per group. Most keys are met once, so a count before the
    shuffle would hold a whole split of the input and save nothing: rows travel, and are counted where
    their key lies."""
    keys = match_key(strict)
    side = lambda df, t: df.select(group, *keys, F.lit(int(t)).cast("bigint").alias("t"), F.lit(int(not t)).cast("bigint").alias("p"))
    rows = side(truth, True).unionByName(side(predicted, False))
    own = rows.columns[:-2]
    both = rows.repartition(*own).groupBy(*own).agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    total = both.groupBy(group).agg(F.sum("t").alias("truth"), F.sum("p").alias("predicted"), F.sum(F.least("t", "p")).alias("matched"))
    p = F.when(F.col("predicted") > 0, F.col("matched") / F.col("predicted")).otherwise(F.when(F.col("truth") == 0, 1.0).otherwise(0.0))
    r = F.when(F.col("truth") > 0, F.col("matched") / F.col("truth")).otherwise(1.0)
    scored = total.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return scored.select(group, "truth", "predicted", "matched", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def missed(truth: DataFrame, predicted: DataFrame, group: str, strict: bool = False) -> DataFrame:
    """Truth rows beyond the predicted count of their key; the earliest rows are the missed ones."""
    extra = predicted.groupBy(group, F.struct(*match_key(strict)).alias("k")).agg(F.count("*").alias("have"))
    rows = _numbered(truth, group, strict, newest_first=True).join(extra, [group, "k"], "left")
    return rows.filter(F.col("n") > F.coalesce("have", F.lit(0))).select(*truth.columns)


def spurious(truth: DataFrame, predicted: DataFrame, group: str, strict: bool = False) -> DataFrame:
    """Predicted rows beyond the truth's count of their key; the latest rows are the spurious ones."""
    extra = truth.groupBy(group, F.struct(*match_key(strict)).alias("k")).agg(F.count("*").alias("have"))
    rows = _numbered(predicted, group, strict).join(extra, [group, "k"], "left")
    return rows.filter(F.col("n") > F.coalesce("have", F.lit(0))).select(*predicted.columns)


def pooled_totals(report: DataFrame) -> DataFrame:
    """The totals of an ``extraction_report`` over all its statements, one row; consistency is that of
    all checked pairs together, 1 where nothing was checked."""
    counts = ("glyphs", "rows", "tables", "transactions", "checked", "mismatches")
    total = report.agg(F.count("*").alias("statements"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts))
    share = F.when(F.col("checked") == 0, 1.0).otherwise((F.col("checked") - F.col("mismatches")) / F.col("checked"))
    return total.withColumn("consistency", F.round(share, 6))


def import_metrics(report: DataFrame, resolved: DataFrame) -> DataFrame:
    """What an import tells of itself, one row: the pooled totals, unresolved transactions, and distinct
    payees among those (the best candidate, else the description)."""
    payee = F.coalesce(F.try_element_at("candidates", F.lit(1)), F.col("raw"))
    unknown = F.col("stage") == "unresolved"
    settled = resolved.agg(F.count_if(unknown).alias("unresolved"), F.count_distinct(F.when(unknown, payee)).alias("unknown_payees"))
    return pooled_totals(report).drop("statements").join(F.broadcast(settled))  # one row each


def import_summary(rows: DataFrame) -> DataFrame:
    """Number and total of debits."""
    return rows.agg(F.count_if(F.col("amount_paise") < 0).alias("spends"), F.coalesce(F.sum(F.when(F.col("amount_paise") < 0, -F.col("amount_paise"))), F.lit(0)).cast("bigint").alias("spend_paise"))


def extraction_report(rows: DataFrame) -> DataFrame:
    """Per document: glyphs, rows, tables, transactions, checked pairs, mismatches, consistency.

    ``rows``: the typed rows of ``geometry.counted_tables``, laid out. Their counts come from the page
    passes, so one aggregate a document follows the rows it is about. A document without a table has
    zeros and a consistency of 1.
    """
    starts = F.coalesce("starts", F.lit(False))
    # rows that start no transaction go before all others, where they are no row's predecessor's balance
    step = Window.partitionBy("doc_id").orderBy(starts, "page", "row_ord")
    before = F.lag(F.when(starts, F.col("balance_paise"))).over(step)
    rows = rows.filter(starts | F.col("page_rows").isNotNull()).withColumn("expected_paise", F.when(starts, before + F.col("amount_paise")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    every = rows.groupBy("doc_id").agg(
        total("page_glyphs").alias("glyphs"), total("page_rows").alias("rows"), total("page_tables").alias("tables"), F.count_if(starts).alias("transactions"),
        F.count(F.col("expected_paise") + F.col("balance_paise")).alias("checked"), F.count_if(F.col("expected_paise") != F.col("balance_paise")).alias("mismatches"),
    )
    share = F.when(F.col("checked") == 0, 1.0).otherwise((F.col("checked") - F.col("mismatches")) / F.col("checked"))
    return every.withColumn("consistency", F.round(share, 6))


def first_mismatches(reconciled: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The report's first ``k`` mismatches of each key, by position."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("position"))
    return reconciled.filter("drift_paise <> 0").withColumn("nth", nth).filter(F.col("nth") <= k)


def spend_projection(rows: DataFrame) -> DataFrame:
    """Debits of extracted and resolved rows as spends: absolute amounts, always online."""
    debit = rows.filter("amount_paise < 0")
    return debit.withColumns({"amount_paise": -F.col("amount_paise"), "channel": F.lit("online")})
