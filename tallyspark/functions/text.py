"""Typing and text functions, all built of Spark's own expressions.

White space means Unicode's here, no-break space included, which Spark's trim and Java's ``\\s`` leave
alone; and ends of text are ``\\z``, since ``$`` also matches before a last line feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row. A Column used twice is an expression written
    twice, and steps that each use the last one's result would double at every step."""
    return F.transform(F.array(value), body)[0]


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{_WS}+|{_WS}+\\z", "")


def _group(x: Column, pattern: str, k: int) -> Column:
    """A capture, null where it did not take part or nothing matched."""
    got = F.regexp_extract(x, pattern, k)
    return F.when(got != "", got)


def _digits_to_paise(whole: Column, fraction: Column) -> Column:
    digits = F.concat(F.regexp_replace(whole, ",", ""), F.rpad(F.coalesce(fraction, F.lit("")), 2, "0"))
    return digits.try_cast("bigint")


def money(text: Column) -> Column:
    """Strict: optional minus, digits with commas, at most two decimals; else null. BIGINT paise."""
    pattern = "^(-)?([0-9,]+)(?:\\.([0-9]+))?\\z"
    t = trim(text)
    fraction = _group(t, pattern, 3)
    value = _digits_to_paise(F.regexp_extract(t, pattern, 2), fraction)
    ok = t.rlike(pattern) & (F.coalesce(F.length(fraction), F.lit(0)) <= 2)
    return F.when(ok, F.when(t.startswith("-"), -value).otherwise(value))


def money_or_raise(text: Column) -> Column:
    """``money`` that fails the query on a malformed amount."""
    return F.coalesce(money(text), F.raise_error(F.concat(F.lit("not an amount: "), F.coalesce(text, F.lit("null")))).cast("bigint"))


def format_money(paise: Column) -> Column:
    """-7 is -0.07."""
    size = F.abs(paise)
    text = F.concat(F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    return F.when(paise < 0, F.concat(F.lit("-"), text)).otherwise(text)


# Month abbreviations of English statements.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def statement_date(text: Column) -> Column:
    """Day-first dates, numeric or with a month's name; impossible ones are null."""
    numeric = "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2}|[0-9]{4})\\z"
    named = f"^([0-9]{{1,2}})(?:[-/]|{_WS})*([A-Za-z]{{3,4}})(?:[-/]|{_WS})*([0-9]{{2}}|[0-9]{{4}})\\z"

    def month_of(name: Column) -> Column:
        k = F.array_position(F.array(*map(F.lit, MONTHS)), name)
        return F.when(name == "sept", F.lit(9)).when(k > 0, k).cast("int")

    def parts(t: Column, pattern: str, month: Column) -> Column:
        return F.struct(F.regexp_extract(t, pattern, 1).try_cast("int").alias("day"), month.alias("month"), F.regexp_extract(t, pattern, 3).alias("year"))

    def fields(t: Column) -> Column:
        by_name = parts(t, named, month_of(F.lower(F.regexp_extract(t, named, 2))))
        return F.when(t.rlike(numeric), parts(t, numeric, F.regexp_extract(t, numeric, 2).try_cast("int"))).otherwise(by_name)

    def date(f: Column) -> Column:
        year = f["year"].try_cast("int")
        full = F.when(F.length(f["year"]) > 2, year).when(year >= 70, year + 1900).otherwise(year + 2000)
        return F.to_date(F.try_make_timestamp(full, f["month"], f["day"], F.lit(0), F.lit(0), F.lit(0)))

    return let(let(trim(text), fields), date)


def amount(text: Column) -> Column:
    """struct<paise, sign_explicit>, or null: currency marks, brackets, Dr/Cr and minus signs."""
    lead = f"(?is)^(DR|CR)\\.?{_WS}+(.*)\\z"
    tail = f"(?is)^(.*?){_WS}*(DR|CR)\\.?\\z"
    bare = trim(F.regexp_replace(F.regexp_replace(trim(text), "₹", ""), f"(?i)^(INR|Rs\\.?){_WS}*", ""))

    def brackets(v: Column) -> Column:
        held = v.startswith("(") & v.endswith(")") & (F.length(v) >= 2)
        return F.struct(held.alias("bracketed"), F.when(held, trim(F.regexp_replace(v, "^\\(|\\)\\z", ""))).otherwise(v).alias("v"))

    def front_mark(s: Column) -> Column:
        v = s["v"]
        return F.struct(s["bracketed"].alias("bracketed"), _group(v, lead, 1).alias("front"), F.when(v.rlike(lead), F.regexp_extract(v, lead, 2)).otherwise(v).alias("v"))

    def back_mark(s: Column) -> Column:
        v = s["v"]
        mark = F.upper(F.coalesce(s["front"], _group(v, tail, 2)))
        return F.struct(s["bracketed"].alias("bracketed"), mark.alias("mark"), trim(F.when(v.rlike(tail), F.regexp_extract(v, tail, 1)).otherwise(v)).alias("v"))

    def minus(s: Column) -> Column:
        v = s["v"]
        return F.struct(s["bracketed"].alias("bracketed"), s["mark"].alias("mark"), (v.endswith("-") | v.startswith("-")).alias("minus"), trim(F.regexp_replace(trim(F.regexp_replace(v, "-\\z", "")), "^-", "")).alias("v"))

    def signed(s: Column) -> Column:
        negative = F.when(s["minus"], F.lit(True)).when(s["mark"].isNotNull(), s["mark"] == "DR").otherwise(s["bracketed"])
        size = F.when(s["v"].rlike("^[0-9][0-9,]*(\\.[0-9]{1,2})?\\z"), money(s["v"]))
        explicit = s["minus"] | s["mark"].isNotNull() | s["bracketed"]
        return let(size, lambda x: F.when(x.isNotNull(), F.struct(F.when(negative, -x).otherwise(x).alias("paise"), explicit.alias("sign_explicit"))))

    found = bare
    for step in (brackets, front_mark, back_mark, minus, signed):
        found = let(found, step)
    return found


def split_amount(debit: Column, credit: Column) -> Column:
    """Debit column first, as a negative; then credit; null if both are zero or unreadable."""
    d, c = (F.abs(F.coalesce(amount(x)["paise"], F.lit(0))) for x in (debit, credit))
    return let(F.struct(d.alias("d"), c.alias("c")), lambda s: F.when(s["d"] != 0, -s["d"]).when(s["c"] != 0, s["c"]))


def signed_amount(text: Column, unsigned_is_debit: bool = True) -> Column:
    return let(amount(text), lambda a: F.when(a["sign_explicit"] | F.lit(not unsigned_is_debit), a["paise"]).otherwise(-a["paise"]))


def starts_with_date(text: Column) -> Column:
    """Whether the first token, or the first 10, 9, 8 or 6 characters, read as a date."""

    def found(t: Column) -> Column:
        heads = [F.when(F.length(t) >= n, F.substring(t, 1, n)) for n in (10, 9, 8, 6)]
        return F.exists(F.array(F.regexp_extract(t, f"^((?:(?!{_WS}).)*)", 1), *heads), lambda s: statement_date(s).isNotNull())

    return F.coalesce(let(F.regexp_replace(text, f"^{_WS}+", ""), found), F.lit(False))


def normalise_description(text: Column) -> Column:
    return F.regexp_replace(F.upper(trim(text)), f"{_WS}+", " ")


def mask_structure(text: Column) -> Column:
    """ASCII letters become A or a, digits 9; all else stays."""
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return F.translate(text, upper + lower + digit, "A" * 26 + "a" * 26 + "9" * 10)


def format_rupees(paise: Column, symbol: bool = True, decimals: bool = True) -> Column:
    """Indian grouping: the last three digits, then pairs."""
    size = F.abs(paise)
    whole = F.floor(size / 100).cast("string")
    head = F.regexp_replace(whole, "(?<=\\d)(?=(\\d{2})*\\d{3}\\z)", ",")
    text = F.concat(F.lit("₹" if symbol else ""), head, F.concat(F.lit("."), F.lpad((size % 100).cast("string"), 2, "0")) if decimals else F.lit(""))
    return F.when(paise < 0, F.concat(F.lit("-"), text)).otherwise(text)


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), trim(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    return let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), lambda s: F.size(F.array_intersect(s["x"], s["y"])) / F.size(F.array_union(s["x"], s["y"])))
