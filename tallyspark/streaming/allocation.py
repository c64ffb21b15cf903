"""Greedy routing of spends as they arrive.

A wallet's state is one row of integers (spends so far, and what each bucket holds), so it stays
small however long the cycle; ``keep`` with a watermark lets the state of finished cycles go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.operators.allocation import Wallet, card_options, spend_options
from tallyspark.sources.cards import Card
from tallyspark.sources.storage import fresh_path

ROUTED = "cycle_id long, spend_id long, spend_seq long, card_id string, rupees_paise long, rule_id string"


def route(spends: DataFrame, cards: list[Card], keep_days: int | None = None) -> DataFrame:
    """Streaming ``greedy_allocate``: ROUTED, one row a spend, appended once.

    A spend is scored against what its wallet's buckets hold when it arrives; within a micro-batch
    by date, then id. An answer given is never taken back, so a spend that comes in a later batch
    than a younger one of its wallet is numbered and scored after that one. With ``keep_days`` the
    spends also carry event_time and a watermark: a wallet silent for so long past it is forgotten,
    and what comes later still than the watermark is left out by Spark. Without it nothing is.
    """
    wallet = Wallet(cards)
    slots = [(k, b.id) for k, c in enumerate(cards) for b in c.buckets]

    def fold(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # plain rows: most wallets have few, and a step of pandas costs as much as all of them
        rows = [r for f in frames for r in zip(*(f[c].tolist() for c in names))]
        rows.sort(key=lambda r: (r[0] is None, r[0] or "", r[1] != r[1], r[1]))
        seen, held = state.get if state.exists else (0, [0] * len(slots))
        used: list[dict[str, int]] = [{} for _ in cards]
        for (k, bucket), x in zip(slots, held):
            used[k][bucket] = int(x)
        chosen, paid, rules = wallet.greedy([(r[2], spend_options(r[3].tolist(), len(cards))) for r in rows], used)
        state.update((seen + len(rows), [used[k].get(bucket, 0) for k, bucket in slots]))
        if keep_days is not None:
            latest = int(max(r[4] for r in rows).timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + keep_days * 86_400_000)
        yield pd.DataFrame({
            "cycle_id": key[0], "spend_id": [r[1] for r in rows], "spend_seq": range(seen + 1, seen + 1 + len(rows)), "card_id": [cards[c].id for c in chosen], "rupees_paise": paid,
            "rule_id": [cards[c].rules[r].id if r >= 0 else None for c, r in zip(chosen, rules)],
        })

    names = ["date", "spend_id", "amount_paise", "options"] + ([] if keep_days is None else ["event_time"])
    timed = [] if keep_days is None else ["event_time"]
    rows = spends.select("cycle_id", "spend_id", F.col("date").cast("string").alias("date"), "amount_paise", card_options(cards).alias("options"), *timed)
    timeout = GroupStateTimeout.NoTimeout if keep_days is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("cycle_id").applyInPandasWithState(fold, ROUTED, "seen long, held array<long>", "append", timeout)


def run_available(stream: DataFrame, spark: SparkSession, folder: str | None = None) -> DataFrame:
    """Runs a stream over the input there is, into Parquet under ``folder`` with its own checkpoint,
    and reads the rows back. The folder is spark.checkpoint.dir; where that is unset, a session of one
    process gets a folder of our own, and a cluster is refused."""
    at = fresh_path(spark, "stream", folder)
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
