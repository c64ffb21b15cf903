"""Predicates over spends, compiled to two-valued boolean columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.sources.cards import Predicate


def has_any_tag(tags: Column, wanted: tuple[str, ...]) -> Column:
    """Never null: a null array or element matches nothing."""
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.exists(tags, lambda t: F.coalesce(t.isin(*wanted), F.lit(False))), F.lit(False))


def compile_predicate(p: Predicate, amount: Column | None = None) -> Column:
    """Reads the columns mcc, channel, tags, amount_paise (or ``amount``) and date of a spend."""
    match p.op:
        case "always":
            return F.lit(True)
        case "all":
            return reduce(lambda a, b: a & b, (compile_predicate(x, amount) for x in p.args), F.lit(True))
        case "any":
            return reduce(lambda a, b: a | b, (compile_predicate(x, amount) for x in p.args), F.lit(False))
        case "not":
            return ~compile_predicate(p.args[0], amount)
        case "mcc_in":
            found = F.col("mcc").isin(*p.args) if p.args else F.lit(False)
        case "channel":
            found = F.col("channel") == p.args[0]
        case "merchant_in":
            return has_any_tag(F.col("tags"), p.args)
        case "amount_gte":
            found = (F.col("amount_paise") if amount is None else amount) >= p.args[0]
        case "date_between":
            found = F.col("date").between(F.lit(p.args[0]), F.lit(p.args[1]))
        case _:
            raise ValueError(f"unknown predicate: {p.op!r}")
    return F.coalesce(found, F.lit(False))
