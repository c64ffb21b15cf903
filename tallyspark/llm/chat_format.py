"""Conversations rendered through a compiled template, and read back.

Turns are dealt by conversation and sorted inside the partition; the renderer streams through them,
so a conversation that holds a third of all rows costs time in its task but no memory. Its output is
rows of parts: formatted text with the spans under the loss, a new part beginning after a turn once
``part_chars`` are full (almost every conversation is one part).

Edge cases: a null text is empty, a null role is the empty role; rows of one turn number go by role
and text; repeated rows are turns of their own; a null conv_id is a conversation; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import DEFAULT_TEMPLATE, compile_template, unescape

PART_CHARS = 1 << 20
_OUT = "conv_id long, part int, formatted string, loss array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def format_conversations(turns: DataFrame, template: str = DEFAULT_TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part (from 0), formatted text, and the spans [start, end) of it under the loss."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows: list[tuple] = []
        size = 0
        for conv_id, own in groupby(_turns(batches), key=lambda t: t[0]):
            taken = [0]

            def messages(own=own, taken=taken):
                for _, _, role, text in own:
                    taken[0] += 1
                    yield {"role": role or "", "text": text or ""}

            text, spans, at, part, turn = [], [], 0, 0, 0
            for fragment, marked in render({"messages": messages()}):
                if at >= part_chars and taken[0] != turn and not marked and not (spans and spans[-1]["end"] == at):
                    rows.append((conv_id, part, "".join(text), spans))
                    yield _parts(rows)
                    rows, size, text, spans, at, part = [], 0, [], [], 0, part + 1
                turn = taken[0]
                if marked and fragment:
                    if spans and spans[-1]["end"] == at:
                        spans[-1]["end"] = at + len(fragment)
                    else:
                        spans.append({"start": at, "end": at + len(fragment)})
                text.append(fragment)
                at += len(fragment)
            rows.append((conv_id, part, "".join(text), spans))
            size += at
            if size >= part_chars:
                yield _parts(rows)
                rows, size = [], 0
        if rows:
            yield _parts(rows)

    cells = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = cells.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(work, _OUT)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    conv, part, text, spans = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(text), pa.array(spans, _SPAN)], names=["conv_id", "part", "formatted", "loss"])


_END = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n")


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of the default format; start and end bound the escaped text."""
    at = 0
    while at < len(formatted):
        head = formatted.find("\n", at)
        if head < 0 or not formatted.startswith("### ", at):
            raise ValueError("not in the default format")
        start = stop = head + 1
        for m in _END.finditer(formatted, start):
            if m[0] == "</turn>\n":
                stop = m.start()
                break
        else:
            raise ValueError("a turn does not end")
        yield unescape(formatted[at + 4 : head]), unescape(formatted[start:stop]), start, stop
        at = stop + len("</turn>\n")


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from the parts as ``format_conversations`` left them: in
    order and in one partition, so nothing is shuffled and only running digests are held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv_id, parts in groupby(_turns(batches), key=lambda t: t[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for _, _, text, spans in parts:
                chars += len(text)
                for role, own, _, _ in read_turns(text):
                    turns.update(f"{role}\n{own}\n".encode())
                    n += 1
                for span in spans:
                    own = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(own)
                    loss.update(own.encode())
            out.append((conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 4096:
                yield _digest_batch(out)
                out = []
        if out:
            yield _digest_batch(out)

    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns, types = zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
