from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, chunk int, part string, label int, rank int, key string, score string"


@pytest.fixture(scope="session")
def corpus(spark, sf):
    """The documents with rows that are null, empty, tied, repeated or very long."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    longest = " ".join(f"w{i * i % 977} über" for i in range(60_000))
    top = max(i for i, _ in rows) + 1
    odd = [None, "", " \n\t ", "one", "one", "two words", "Two WORDS", longest, longest + " tail", "no" * 40_000, "é\u00a0\u2003x", "日本語 テキスト \U0001f600"]
    return rows + [(top + k, t) for k, t in enumerate(odd)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus)


def frame(spark, rows):
    """Rows under a schema whose other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, 1, "p", 2, 3, "k", "s") for i, t in rows], DOCS)
