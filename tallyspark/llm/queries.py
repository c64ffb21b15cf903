"""The numbered queries: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf_quality import held_out, score, train

    docs = _read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ads_search import search

    return search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setsketch_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_extract import extract

    return extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_windows

    found = repeated_windows(_read(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .monoid_bpe import digests, encode_documents

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(encode_documents(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bottomk import fingerprints

    return fingerprints(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "shingles"
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, format_conversations

    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(turns))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bloom_lm import score_texts

    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_texts(docs.withColumn("held_out", held_out)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import duplicated_spans

    found = duplicated_spans(_read(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restored

    return fill_in_middle(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth text, by crc32 of its id, repeats a stretch from one of its words to its end."""
    draw = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "text", (draw % 10 == 0).alias("planted"), F.floor(draw / 10).cast("long").alias("g"))
    rows = rows.withColumn("words", F.when(F.col("planted"), F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), "")))
    n = F.size("words").cast("long")
    a = F.when(n > 0, F.col("g") % n)
    rows = rows.withColumns({"a": a, "p": 1 + F.floor((n - a) / (3 + F.col("g") % 8))})
    told = F.transform("words", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("planted") & F.col("a").isNotNull(), F.array_join(told, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs

    found = periodic_runs(_with_planted_periods(_read(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda top, run: F.when(top.isNull() | (run["length"] * top["period"] > top["length"] * run["period"]), run).otherwise(top))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_crf_quality": op1_line_crf_quality,
    "op2_adaptive_scan": op2_adaptive_scan,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_block_labeller": op4_block_labeller,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_fingerprints": op7_fingerprints,
    "op8_chat_format": op8_chat_format,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_lm_scores": op10_lm_scores,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_periodic_runs": op13_periodic_runs,
}

# Rows, counts and digests that SQL can state; models, sketches, tokenizers and packings have no SQL,
# and near duplicates take too long in it, so tests hold those against plain Python.
_SAID = "\\### Assistant: </turn> ok"
_ESCAPED = "replace(replace(replace({x}, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"

ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": r"""WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
      starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
      windows AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS x FROM starts),
      again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY x) AS n FROM windows) WHERE n > 1),
      gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM again),
      words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
      kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.k) AS text, count(*) AS n FROM words ANTI JOIN gone ON gone.r = words.r AND gone.k = words.k GROUP BY words.r)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r""",
    "op8_chat_format": f"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
      e AS (SELECT *, length({_ESCAPED.format(x='text')}) + length(replace({_ESCAPED.format(x='role')}, chr(10), '\\n')) + 13 AS chars FROM t)
      SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    # texts as hexadecimal, in blocks, so that each stretch is cut from a short string
    "op11_suffix_dedup": """WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
      blocks AS (SELECT r, doc_id, b, substring(x, 2 * b + 1, 2 * 561) AS y FROM (SELECT r, doc_id, x, unnest(range(0, greatest(len(x) // 2 - 49, 0), 512)) AS b FROM d)),
      stretches AS (SELECT r, doc_id, b + k AS i, substring(y, 2 * k + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(512, len(y) // 2 - 49))) AS k FROM blocks)),
      gone AS (SELECT r, i FROM (SELECT r, i, coalesce(doc_id, 9223372036854775807) AS doc_id, min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY s) AS least FROM stretches) WHERE doc_id > least),
      spans AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM gone)) GROUP BY r, span),
      ends AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM spans),
      last AS (SELECT r, max(b) AS b, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
      pieces AS (SELECT d.r, a, substring(x, 2 * before + 1, 2 * (a - before)) AS y FROM d JOIN ends ON d.r = ends.r UNION ALL SELECT d.r, 9223372036854775807, substring(x, 2 * coalesce(b, 0) + 1) FROM d LEFT JOIN last ON d.r = last.r),
      kept AS (SELECT r, string_agg(y, '' ORDER BY a) AS y FROM pieces GROUP BY r)
      SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(y)) AS kept_sha256
      FROM d JOIN kept ON kept.r = d.r LEFT JOIN last ON last.r = d.r""",
    "op12_fill_in_middle": """WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
      g AS (SELECT *, CAST('0x' || substring(h, 1, 8) AS UBIGINT) % (n + 1) AS one, CAST('0x' || substring(h, 9, 8) AS UBIGINT) % (n + 1) AS two,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substring(h, 17, 8) AS UBIGINT) % 100 >= 90 THEN 'plain'
          WHEN CAST('0x' || substring(h, 25, 8) AS UBIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
      c AS (SELECT *, CAST(least(one, two) AS BIGINT) AS a, CAST(greatest(one, two) AS BIGINT) AS b FROM g),
      p AS (SELECT *, substring(text, 1, a) AS head, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS tail FROM c)
      SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid WHEN 'spm' THEN '<S>' || tail || '<P>' || head || '<M>' || mid ELSE text END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM p""",
    # crc32 of an id's digits: eight shifts a byte, the polynomial reflected
    "op13_periodic_runs": """WITH RECURSIVE ids AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents),
      crc AS (SELECT r, coalesce(CAST(doc_id AS VARCHAR), '') AS digits, CAST(4294967295 AS BIGINT) AS c, 0 AS k FROM ids
        UNION ALL SELECT r, digits, CAST(list_reduce(list_prepend(xor(c, CAST(ascii(substring(digits, k + 1, 1)) AS BIGINT)), CAST(range(8) AS BIGINT[])), lambda x, s: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) AS BIGINT), k + 1 FROM crc WHERE k < length(digits)),
      drawn AS (SELECT ids.r, doc_id, w0, len(w0) AS n, xor(c, 4294967295) % 10 AS planted, xor(c, 4294967295) // 10 AS g FROM ids JOIN crc ON crc.r = ids.r AND crc.k = length(crc.digits)),
      cut AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM drawn),
      d AS (SELECT r, doc_id, n, CASE WHEN planted = 0 AND n > 0 THEN list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w0 END AS w FROM cut),
      words AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
      same AS (SELECT x.r, x.n, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
      isles AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM same) GROUP BY r, q, isle),
      runs AS (SELECT r, start, length, min(q) AS period FROM isles WHERE length >= 6 AND length >= 4 * q GROUP BY r, start, length),
      best AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
      top AS (SELECT x.* FROM runs x WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.r = x.r AND (y.length * x.period > x.length * y.period OR y.length * x.period = x.length * y.period AND (y.start < x.start OR y.start = x.start AND y.period < x.period)))),
      gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
      kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS text FROM words ANTI JOIN gone ON gone.r = words.r AND gone.i = words.i GROUP BY words.r)
      SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(top.period AS BIGINT) AS period,
        CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
      FROM d LEFT JOIN best ON best.r = d.r LEFT JOIN top ON top.r = d.r LEFT JOIN kept ON kept.r = d.r""",
}
