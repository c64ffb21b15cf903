"""Bottom-k fingerprints of documents, in DataFrame functions only.

A sketch is the ascending array of the ``k`` smallest 64-bit hashes of a text's distinct word
shingles. The sketch of a union is the ``k`` smallest of both, so sketches of parts merge: a text is
sketched in parts of ``part`` words, each reaching ``shingle - 1`` words into the next, which are
merged as they come, so that a long text never holds all its hashes at once. As a string a sketch is
its hashes in hexadecimal, 16 digits each.

Edge cases: a null or empty text, or one without words, has the empty sketch; two empty sketches
are alike (1.0), an empty and a full one are not (0.0); fewer words than a shingle form one; ids
that repeat follow each other by the hash of the text, then the text; rows without an id come after
all others, in that order too; with a single row the next document is the row itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, SHINGLE, PART = 128, 5, 4096
#: UTF-8 bytes of text that one range of documents holds on average, and the most ranges there are.
RANGE_BYTES, RANGES = 2 << 20, 1 << 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, wherever the optimizer moves it."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = SIZE, shingle: int = SHINGLE, part: int = PART) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes, ascending."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    none = F.array().cast("array<bigint>")

    def least(w: Column, first: Column, last: Column) -> Column:
        hashes = F.transform(F.sequence(first, last), lambda i: F.xxhash64(F.slice(w, i, shingle)))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    def whole(w: Column) -> Column:
        last = F.greatest(F.size(w) - F.lit(shingle - 1), F.lit(1))
        parts = F.sequence(F.lit(1), last, F.lit(part))
        several = F.aggregate(parts, none, lambda found, first: merge(found, least(w, first, F.least(first + F.lit(part - 1), last)), k))
        return F.when(F.size(w) == 0, none).when(last <= part, least(w, F.lit(1), last)).otherwise(several)

    return _let(words, whole)


def merge(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of the union of both shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both sketches hold."""
    both = F.array_intersect(a, b)
    return _let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, both)) / F.size(u)))


def distinct_count(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / span)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's count over a's."""
    share = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / F.greatest(distinct_count(a, k), F.lit(1.0))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def as_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _ranges(rows: DataFrame, range_bytes: int) -> Column:
    """The number of each row's range in the order of doc_id, the text's hash, and the text.

    Quantiles of the ids (at most RANGES, so the driver holds at most that many longs) part them
    evenly however they are spread. An id that holds several quantiles, or rows without an id, are
    parted by the hash. Quantiles lie in blocks of about their root, so that a row is compared with
    two roots and not with all.
    """
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    n = min(RANGES, max(1, (size["bytes"] or 0) // range_bytes))
    of_ids = max(1, n * size["named"] // max(1, size["n"]))
    shares = [(i + 1) / of_ids for i in range(of_ids - 1)]
    cuts = sorted(rows.agg(F.percentile_approx("doc_id", shares, 10 * of_ids).alias("q")).first()["q"] or []) if shares and size["named"] else []
    width = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def before(own: Column, ties: bool) -> Column:
        """How many quantiles come before an id (or with it)."""
        if not blocks:
            return F.lit(0)
        under = (lambda x: x <= own) if ties else (lambda x: x < own)
        full = F.size(F.filter(F.lit([b[-1] for b in blocks]), under))
        inside = F.get(F.lit(blocks), full)
        return F.when(full == len(blocks), len(cuts)).otherwise(full * F.lit(width) + F.size(F.filter(inside, under)))

    share = (F.xxhash64("text").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    lo, hi = before(F.col("doc_id"), False), before(F.col("doc_id"), True)
    # all rows of an id without ties go to the range that its last quantile opens
    named = F.when(hi - lo <= 1, hi).otherwise(lo + 1 + F.least(F.floor(share * (hi - lo)), hi - lo - 1))
    unnamed = F.lit(len(cuts) + 1) + F.floor(share * max(1, n - of_ids))
    return F.when(F.col("doc_id").isNull(), unnamed).otherwise(named).cast("long")


def with_next(docs: DataFrame, k: int = SIZE, shingle: int = SHINGLE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each document and the one after it in ascending
    id, the first after the last.

    Texts are shuffled once, by range, are sketched there once, and look ahead inside the range; only
    the first document of each range travels again, to the range before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = rows.select("doc_id", "text", F.coalesce(_ranges(rows, range_bytes), F.lit(0).cast("long")).alias("range"), F.xxhash64("text").alias("hash")).repartition("range")
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_last(), "hash", "text")
    own = sketch(F.col("text"), k, shingle).alias("sketch")
    heads = placed.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select(F.col("range").alias("own"), F.struct("text", own).alias("head"))
    every = Window.orderBy("own")  # at most RANGES + 1 rows, without texts
    before = heads.select("own", F.lag("own").over(every).alias("before"), F.max("own").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    heads = heads.join(before.select(F.col("own").alias("own2"), F.coalesce("before", "last").alias("to")), F.col("own") == F.col("own2")).select("to", "head")
    ahead = placed.select("*", own).withColumn("_next", F.lead(F.struct("text", "sketch")).over(order))
    found = ahead.join(heads, F.col("range") == F.col("to"), "left").withColumn("next", F.coalesce("_next", "head"))
    return found.select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def fingerprints(docs: DataFrame, k: int = SIZE, shingle: int = SHINGLE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document's sketch, that of its edited text, how alike they and the next one's are, the
    estimated share of the document's shingles that the edited text has, and of distinct shingles."""
    rows = with_next(docs, k, shingle, range_bytes)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    texts = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    sketches = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), k, shingle).alias("edited_sketch"), "next_sketch")
    own, changed = F.col("sketch"), F.col("edited_sketch")
    return sketches.select(
        "doc_id", "n_chars", "edited_sha256", as_string(own).alias("fingerprint"), as_string(changed).alias("edited_fingerprint"),
        resemblance(own, changed, k).alias("near_edited"), resemblance(own, F.col("next_sketch"), k).alias("near_next"),
        containment(own, changed, k).alias("in_edited"), distinct_count(own, k).alias("shingles"),
    )
