"""Marginal rewards, outcomes and rankings as Catalyst expressions.

Each card becomes one struct column over a spend (and, optionally, a map of what its buckets have
consumed), so scoring stays inside the scan's stage: no join, no shuffle, no Python.
"""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.predicates import compile_predicate
from tallyspark.sources.cards import Card, Rule

WARN_AT = 0.8
NO_RULE = "no rule on this card matches this spend"
_OUTCOMES = "array<struct<bucket_id:string,label:string,limit_paise:bigint,consumed_paise:bigint,applied_paise:bigint,clamped:boolean>>"


def _spent(amount: Column | None) -> Column:
    return F.col("amount_paise") if amount is None else amount


def gross_paise(rate: float, amount: Column | None = None) -> Column:
    """Half away from zero, in double arithmetic."""
    return F.round(_spent(amount).cast("double") * F.lit(float(rate))).cast("bigint")


def consumed(state: Column | None, bucket_id: str) -> Column:
    return F.lit(0).cast("bigint") if state is None else F.coalesce(F.try_element_at(state, F.lit(bucket_id)), F.lit(0)).cast("bigint")


def headroom(card: Card, bucket_id: str, state: Column | None) -> Column:
    return F.greatest(F.lit(card.bucket(bucket_id).limit_paise) - consumed(state, bucket_id), F.lit(0)).cast("bigint")


def _known(card: Card, rule: Rule) -> list[str]:
    return [b for b in rule.consumes if card.bucket(b)]


def granted_paise(card: Card, rule: Rule, state: Column | None, amount: Column | None = None) -> Column:
    rooms = [headroom(card, b, state) for b in _known(card, rule)]
    gross = gross_paise(rule.rate, amount)
    return F.least(gross, *rooms) if rooms else gross


def _binding(card: Card, rule: Rule, state: Column | None, amount: Column | None = None) -> Column:
    """The last bucket that strictly lowered the grant."""
    best, bound = gross_paise(rule.rate, amount), F.lit(None).cast("string")
    for b in _known(card, rule):
        room = headroom(card, b, state)
        bound = F.when(room < best, F.lit(b)).otherwise(bound)
        best = F.least(best, room)
    return bound


def in_rupees(card: Card, rule: Rule, granted: Column) -> Column:
    if rule.unit == "cashback":
        return granted
    return F.round(granted * F.lit(card.point_value_paise) / F.lit(100.0)).cast("bigint")


def exclusion(card: Card) -> Column:
    """Why the card pays nothing whatever its rules, else null."""
    out = F.lit(None).cast("string")
    if card.excluded_tags:
        tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
        first = F.filter(F.array(*map(F.lit, card.excluded_tags)), lambda t: F.array_contains(tags, t))
        out = F.when(F.size(first) > 0, F.concat(F.try_element_at(first, F.lit(1)), F.lit(" spends earn nothing on this card")))
    if card.excluded_mccs:
        hit = F.coalesce(F.col("mcc").isin(*card.excluded_mccs), F.lit(False))
        out = F.when(hit, F.concat(F.lit("MCC "), F.col("mcc").cast("string"), F.lit(" is excluded from rewards on this card"))).otherwise(out)
    return out


def _rule_reward(card: Card, rule: Rule, state: Column | None, amount: Column | None = None) -> Column:
    gross, granted, bound = gross_paise(rule.rate, amount), granted_paise(card, rule, state, amount), _binding(card, rule, state, amount)
    known = _known(card, rule)
    outcomes = F.array(*(
        F.struct(
            F.lit(b).alias("bucket_id"), F.lit(card.bucket(b).title).alias("label"), F.lit(card.bucket(b).limit_paise).cast("bigint").alias("limit_paise"),
            consumed(state, b).alias("consumed_paise"), granted.alias("applied_paise"), F.coalesce(bound == b, F.lit(False)).alias("clamped"),
        ) for b in known
    )).cast(_OUTCOMES)
    rupees = in_rupees(card, rule, granted)
    rate = F.when(_spent(amount) == 0, F.lit(0.0)).otherwise(rupees / _spent(amount))
    text = F.lit(rule.title)
    for b in known:
        text = F.when((bound == b) & (granted < gross), F.lit(f"{rule.title} — clipped by the {card.bucket(b).title} cap")).otherwise(text)
    until = F.lit(None).cast("bigint")
    if known and rule.rate > 0:
        rooms = [headroom(card, b, state) for b in known]
        until = F.round((F.least(*rooms) if len(rooms) > 1 else rooms[0]) / F.lit(rule.rate)).cast("bigint")
    return F.when(
        compile_predicate(rule.when, amount) & (gross > 0) & (granted > 0),
        F.struct(rupees.alias("rupees_paise"), F.lit(rule.id).alias("rule_id"), outcomes.alias("buckets"), rate.cast("double").alias("effective_rate"), text.alias("explanation"), until.alias("spend_until_drop")),
    )


def _nothing(why: Column) -> Column:
    return F.struct(
        F.lit(0).cast("bigint").alias("rupees_paise"), F.lit(None).cast("string").alias("rule_id"), F.array().cast(_OUTCOMES).alias("buckets"),
        F.lit(0.0).alias("effective_rate"), why.alias("explanation"), F.lit(None).cast("bigint").alias("spend_until_drop"),
    )


def marginal_reward(card: Card, state: Column | None = None, enforce_valid_from: bool = False, amount: Column | None = None) -> Column:
    """What the card pays for the row's spend: the first rule that matches and still has room."""
    why = exclusion(card)
    paid = F.coalesce(*(_rule_reward(card, r, state, amount) for r in card.rules), _nothing(F.lit(NO_RULE))) if card.rules else _nothing(F.lit(NO_RULE))
    reward = F.when(why.isNotNull(), _nothing(why)).otherwise(paid)
    if enforce_valid_from and card.valid_from:
        reward = F.when(F.col("date") < F.lit(card.valid_from), _nothing(F.lit("not valid yet"))).otherwise(reward)
    return reward


def rule_candidates(card: Card) -> Column:
    """array<struct<rule,gross>> of matching rules with a gross reward, in order; empty if excluded.
    Folds that carry state need nothing else of a spend."""
    empty = F.array().cast("array<struct<rule:int,gross:bigint>>")
    if not card.rules:
        return empty
    options = [F.when(compile_predicate(r.when) & (gross_paise(r.rate) > 0), F.struct(F.lit(k).cast("int").alias("rule"), gross_paise(r.rate).alias("gross"))) for k, r in enumerate(card.rules)]
    return F.when(exclusion(card).isNotNull(), empty).otherwise(F.filter(F.array(*options), lambda x: x.isNotNull()))


def rule_gross(cards: list[Card]) -> Column:
    """array<bigint>: the gross reward of every rule of every card in turn, 0 where it does not match or
    the card excludes the spend."""
    every = []
    for card in cards:
        open_ = exclusion(card).isNull()
        every += [F.when(open_ & compile_predicate(r.when), F.greatest(gross_paise(r.rate), F.lit(0))).otherwise(F.lit(0)).cast("bigint") for r in card.rules]
    return F.array(*every).cast("array<bigint>")


def score_cards(spends: DataFrame, cards: list[Card], states: dict[str, Column] | None = None) -> DataFrame:
    """One row for each spend and card, with card_ord, card_id and the reward's fields."""
    states = states or {}
    every = F.array(*(F.struct(F.lit(k).alias("card_ord"), F.lit(c.id).alias("card_id"), marginal_reward(c, states.get(c.id)).alias("reward")) for k, c in enumerate(cards)))
    keep = [c for c in spends.columns]
    return spends.withColumn("_scored", F.explode(every)).select(*keep, "_scored.card_ord", "_scored.card_id", "_scored.reward.*")


def ranking(cards: list[Card], states: dict[str, Column] | None = None, amount: Column | None = None) -> Column:
    """array<struct<loss,card_ord,card_id,rupees_paise>>, best card first; ties keep the cards' order."""
    states = states or {}
    entries = []
    for k, c in enumerate(cards):
        rupees = marginal_reward(c, states.get(c.id), amount=amount).getField("rupees_paise")
        entries.append(F.struct((-rupees).alias("loss"), F.lit(k).alias("card_ord"), F.lit(c.id).alias("card_id"), rupees.alias("rupees_paise")))
    return F.array_sort(F.array(*entries))


def rank_cards(spends: DataFrame, cards: list[Card], keys: list[str], states: dict[str, Column] | None = None) -> DataFrame:
    ranked = spends.select(*keys, F.posexplode(ranking(cards, states)).alias("_p", "_r"))
    return ranked.select(*keys, (F.col("_p") + 1).cast("int").alias("rank"), "_r.card_id", "_r.rupees_paise")


def winners(spends: DataFrame, cards: list[Card], keys: list[str], states: dict[str, Column] | None = None) -> DataFrame:
    """Winner, runner-up and by how much; the advantage is 0 with fewer than two cards."""
    r = spends.select(*keys, ranking(cards, states).alias("r"))
    first, second = F.try_element_at("r", F.lit(1)), F.try_element_at("r", F.lit(2))
    return r.select(
        *keys, first["card_id"].alias("winner"), first["rupees_paise"].alias("winner_paise"), second["card_id"].alias("runner_up"),
        F.coalesce(first["rupees_paise"] - second["rupees_paise"], F.lit(0)).cast("bigint").alias("advantage_paise"),
    )


def why_panel(spends: DataFrame, cards: list[Card], keys: list[str], states: dict[str, Column] | None = None) -> DataFrame:
    """Why each card ranks where it does: rank, rule, terms, the terms' source and dates, and
    whether a bucket clips the spend or is at least WARN_AT full after it. One row a card; the
    ranking is an array within the spend's row, so nothing shuffles."""
    states = states or {}
    day = lambda d: F.lit(d).cast("date")
    entries = []
    for k, c in enumerate(cards):
        reward = marginal_reward(c, states.get(c.id))
        entries.append(F.struct(reward.alias("reward"), F.lit(k).alias("card_ord"), F.lit(c.id).alias("card_id"), F.lit(c.name).alias("name"), F.lit(urlsplit(c.source_url).hostname).alias("source_host"), day(c.retrieved_on).alias("retrieved_on"), day(c.valid_from).alias("valid_from")))
    tight = lambda b: b["clamped"] | ((b["limit_paise"] > 0) & (b["consumed_paise"] + b["applied_paise"] >= b["limit_paise"] * WARN_AT))
    ranked = F.array_sort(F.transform(F.array(*entries), lambda e: F.struct((-e["reward"]["rupees_paise"]).alias("loss"), e["card_ord"].alias("card_ord"), e.alias("card"))))
    rows = spends.select(*keys, F.posexplode(ranked).alias("_p", "_r"))
    card, reward = F.col("_r.card"), F.col("_r.card.reward")
    return rows.select(
        *keys, (F.col("_p") + 1).cast("int").alias("rank"), card["card_id"].alias("card_id"), card["name"].alias("name"), reward["rupees_paise"].alias("rupees_paise"), reward["rule_id"].alias("rule_id"),
        reward["explanation"].alias("explanation"), card["source_host"].alias("source_host"), card["retrieved_on"].alias("retrieved_on"), card["valid_from"].alias("valid_from"), F.exists(reward["buckets"], tight).alias("tight"),
    )


def cap_gauge(limit: Column, used: Column, pending: Column) -> dict[str, Column]:
    """Fractions, status text and utilisation band of one bucket, before and after a spend."""
    from tallyspark.functions.text import format_rupees

    def share(x: Column) -> Column:
        return F.when(limit <= 0, F.lit(0.0)).otherwise(x / limit)

    after = used + pending
    status = (
        F.when(limit <= 0, F.lit("no cap"))
        .when(after > limit, F.concat(format_rupees(after - limit), F.lit(" over — drops to base rate")))
        .when(pending > 0, F.lit("this txn fits"))
        .otherwise(F.concat(format_rupees(limit - used, decimals=False), F.lit(" left this cycle")))
    )
    level = F.when(limit <= 0, F.lit(0.0)).otherwise(after / limit)
    band = F.when(level >= 1, F.lit("danger")).when(level >= 0.8, F.lit("warning")).otherwise(F.lit("accent"))
    return {"used_fraction": share(used), "pending_fraction": share(pending), "status": status, "band": band}


def pending_per_bucket(card: Card, state: Column | None = None) -> Column:
    """array<struct<bucket_id, pending_paise>> over all the card's buckets: what the spend would apply
    to each, 0 where it touches it not."""
    applied = marginal_reward(card, state)["buckets"]
    of = lambda b: F.coalesce(F.try_element_at(F.filter(applied, lambda x: x["bucket_id"] == b), F.lit(1))["applied_paise"], F.lit(0))
    pending = [F.struct(F.lit(b.id).alias("bucket_id"), of(b.id).cast("bigint").alias("pending_paise")) for b in card.buckets]
    return F.array(*pending) if pending else F.array().cast("array<struct<bucket_id:string,pending_paise:bigint>>")


def asked_amount(raw: Column) -> Column:
    """Paise of an amount as typed: its digits are whole rupees; null without digits, or with more than
    fit."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    rupees = F.when(digits != "", digits.try_cast("bigint"))
    return F.when(rupees <= (2**63 - 1) // 100, rupees * 100)
