"""The corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows as
Parquet into the shared folder and hands what it reads back to the next. All stages but the last
return the columns of ``documents``. The SQL of the whole does not exist (a trained classifier and
a packing have none), so ORACLE_SQL is None and tests hold each stage against plain Python.

Edge cases follow the operators: a null or empty text is kept by the classifier only if its prior
clears the threshold, is near nothing, loses nothing, and packs as its end token. Rows that repeat
both doc_id and text (null or not) are one document: the near-duplicate stage hands on one of them.
Rows of one doc_id with different texts are kept or dropped together, and no such text is dropped
for another of its own id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import crf_quality, packing, setsketch_dedup, substring_dedup
from tallyspark.llm.storage import written
from tallyspark.sources.ship import ship

THRESHOLD, WINDOW = 0.3, 35
_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose line-chain score is at least THRESHOLD."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = crf_quality.train(docs, labels)
    return crf_quality.score(docs, model, carry=_COLUMNS[1:]).filter(F.col("score") >= THRESHOLD).select(*_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near duplicates (five words, 0.8), in one row
    for each of its texts."""
    found = setsketch_dedup.near_duplicates(docs, shingle=5, percent=80)
    dropped = found.filter(~F.coalesce(F.col("kept"), F.lit(True))).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*_COLUMNS).dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that a window of WINDOW words repeated anywhere covers."""
    found = substring_dedup.repeated_windows(docs, window=WINDOW, keep_spacing=True, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with the sequence and the place that holds each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", best_fit),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
