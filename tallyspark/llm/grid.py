"""Sizes of the chunk-by-part exchange that counts hashes without a row for each hash.

Rows are dealt evenly into chunks, whatever their ids. A chunk sends, for each range of the hash
space (a part) in which it has hashes, one row with its distinct hashes; a part sends one row back
for each that it got. A hash that a third of all documents share thus costs one entry a chunk and no
task ever holds its occurrences. Rows exchanged are at most chunks x parts, and never more than the
distinct hashes of the chunks, so the exchange stays linear in the bytes at any size.

A repeated id, a null id or rows that are equal throughout do not bend the deal: the row's number
counts too. Input that gives its rows another order when read again (after a lost executor) must be
written to a table first, as the pipeline does; a chunk that differs between its two readings raises.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one chunk has on average.
CHUNK_BYTES = 8 << 20


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def chunk_count(size: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, math.ceil(size / chunk_bytes))


def dealt(rows: DataFrame, chunks: int) -> DataFrame:
    """``rows`` (doc_id, text, ...) with the number of their chunk."""
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))
