"""Rule data: every way to be wrong, with its path, and round trips."""

from __future__ import annotations

import copy
import json
from datetime import date, datetime

import pytest
import yaml
from pyspark.sql import functions as F

from tallyspark.operators import rewards
from tallyspark.sources import cards as C

GOOD = {
    "card": "good", "name": "Good", "issuer": "Bank", "source_url": "https://terms.example/x", "retrieved_on": "2026-08-15", "valid_from": date(2026, 1, 1), "point_value": 0.25,
    "buckets": [{"id": "cap", "limit": {"amount": 1999.99, "unit": "cashback"}}, {"id": "pool", "label": "Pool", "limit": {"amount": 10, "unit": "points", "period": "year"}}],
    "rules": [
        {"id": "a", "when": {"all": [{"mcc_in": [5814, 5411]}, {"not": {"merchant_in": ["swiggy"]}}, {"channel": "online"}]}, "earn": {"rate": 0.05, "unit": "cashback"}, "consumes": ["cap"]},
        {"id": "b", "description": "two", "when": {"any": [{"amount_gte": 500.5}, {"date_between": {"from": "2026-01-01", "to": datetime(2026, 12, 31)}}]}, "earn": {"rate": 2, "unit": "points"}, "consumes": ["pool"]},
        {"id": "c", "when": {"always": True}, "earn": {"rate": 0.01, "unit": "cashback"}},
    ],
    "exclusions": {"mcc": [6513], "tags": ["fuel"]},
    "milestones": [{"id": "m", "threshold": 100000, "grant": 500, "period": "year"}],
}


def changed(path, value="drop"):
    """GOOD with another value at a path, or without it."""
    *way, last = path
    whole = at = copy.deepcopy(GOOD)
    for step in way:
        at = at[step]
    if value == "drop":
        del at[last]
    else:
        at[last] = value
    return whole


WRONG = [
    *((changed([k]), k, "missing") for k in ("card", "name", "issuer", "source_url", "retrieved_on", "valid_from")),
    (changed(["source_url"], "terms.example"), "source_url", "web address"),
    (changed(["retrieved_on"], "last week"), "retrieved_on", "expected a date"),
    (changed(["buckets"], {"id": "cap"}), "buckets", "expected a list"),
    (changed(["buckets", 0], "cap"), "buckets[0]", "expected a map"),
    (changed(["buckets", 0, "id"]), "buckets[0].id", "missing"),
    (changed(["buckets", 0, "limit"]), "buckets[0].limit", "expected a map"),
    (changed(["buckets", 0, "limit", "amount"], "2000"), "buckets[0].limit.amount", "rupee amount"),
    (changed(["buckets", 0, "limit", "amount"], True), "buckets[0].limit.amount", "rupee amount"),
    (changed(["buckets", 0, "limit", "unit"], "miles"), "buckets[0].limit.unit", "unknown reward unit"),
    (changed(["buckets", 1, "limit", "period"], "week"), "buckets[1].limit.period", "unknown period"),
    (changed(["rules", 0, "when"]), "rules[0].when", "needs a predicate"),
    (changed(["rules", 0, "when"], "always"), "rules[0].when", "expected a map"),
    (changed(["rules", 0, "when"], {}), "rules[0].when", "one operator"),
    (changed(["rules", 0, "when"], {"always": True, "channel": "online"}), "rules[0].when", "one operator"),
    (changed(["rules", 0, "when"], {"mcc_inn": [1]}), "rules[0].when.mcc_inn", "grammar is closed"),
    (changed(["rules", 0, "when", "all", 2, "channel"], "phone"), "rules[0].when.all[2].channel", "unknown channel"),
    (changed(["rules", 0, "when", "all", 0, "mcc_in"], 5814), "rules[0].when.all[0].mcc_in", "expected a list"),
    (changed(["rules", 0, "when", "all", 0, "mcc_in"], ["5814"]), "rules[0].when.all[0].mcc_in[0]", "expected a number"),
    (changed(["rules", 1, "when", "any", 0, "amount_gte"], "500"), "rules[1].when.any[0].amount_gte", "rupee amount"),
    (changed(["rules", 1, "when", "any", 1, "date_between"], [1]), "rules[1].when.any[1].date_between", "expected a map"),
    (changed(["rules", 1, "when", "any", 1, "date_between", "to"]), "rules[1].when.any[1].date_between.to", "expected a date"),
    (changed(["rules", 2, "earn"]), "rules[2].earn", "expected a map"),
    (changed(["rules", 2, "earn", "rate"], "5%"), "rules[2].earn.rate", "expected a number"),
    (changed(["rules", 2, "earn", "unit"]), "rules[2].earn.unit", "unknown reward unit"),
    (changed(["rules", 2, "id"]), "rules[2].id", "missing"),
    (changed(["rules", 0, "consumes"], "cap"), "rules[0].consumes", "expected a list"),
    (changed(["rules", 0, "consumes"], ["pool"]), "rules[0].consumes[0]", "holds points"),
    (changed(["exclusions"], ["fuel"]), "exclusions", "expected a map"),
    (changed(["exclusions", "mcc"], ["6513"]), "exclusions.mcc[0]", "expected a number"),
    (changed(["milestones", 0, "threshold"], None), "milestones[0].threshold", "rupee amount"),
    (changed(["milestones", 0, "period"], "week"), "milestones[0].period", "unknown period"),
    (changed(["point_value"], "one"), "point_value", "rupee amount"),
    ("no map", "", "expected a map"),
    (None, "", "expected a map"),
]


@pytest.mark.parametrize(("data", "path", "reason"), WRONG)
def test_every_error_has_its_path(data, path, reason):
    card, problems = C.check_card(data)
    assert card is None and [(p.path, p.warning) for p in problems] == [(path, False)] and reason in problems[0].reason
    with pytest.raises(ValueError, match=reason):
        C.decode_card(data)


def test_all_problems_are_told_at_once():
    data = changed(["rules", 0, "when"], {"all": [{"channel": "phone"}, {"amount_gte": "1"}]})
    data["buckets"][0]["limit"] = {"amount": "x", "unit": "y", "period": "z"}
    del data["name"]
    assert {p.path for p in C.check_card(data)[1]} == {"name", "buckets[0].limit.amount", "buckets[0].limit.unit", "buckets[0].limit.period", "rules[0].when.all[0].channel", "rules[0].when.all[1].amount_gte"}


def test_a_good_card_is_read_whole():
    card, problems = C.check_card(GOOD | {"version": 7})
    assert not problems and card.point_value_paise == 25 and card.valid_from == date(2026, 1, 1)
    assert [(b.id, b.limit_paise, b.unit, b.period, b.title) for b in card.buckets] == [("cap", 199_999, "cashback", "cycle", "cap"), ("pool", 1000, "points", "year", "Pool")]
    assert card.rules[1].when == C.Predicate("any", (C.Predicate("amount_gte", (50_050,)), C.Predicate("date_between", (date(2026, 1, 1), date(2026, 12, 31)))))
    assert (card.excluded_mccs, card.excluded_tags, card.milestones[0].threshold_paise) == ((6513,), ("fuel",), 10_000_000)
    bare = {k: GOOD[k] for k in ("card", "name", "issuer", "source_url", "retrieved_on", "valid_from")}
    assert C.decode_card(bare).rules == ()


def test_an_unknown_bucket_is_a_warning():
    card, problems = C.check_card(changed(["rules", 0, "consumes"], ["cap", "typo"]))
    assert card is not None and [(p.path, p.warning) for p in problems] == [("rules[0].consumes[1]", True)]
    assert all(not C.check_card(data)[1] for data in (C.SBI_CASHBACK, C.AXIS_ACE, C.AMAZON_PAY_ICICI))


@pytest.mark.parametrize(("rupees", "paise"), [(1.005, 100), (0.575, 57), (2.675, 268), (8.5, 850), (0.125, 13), (-0.125, -13), (3, 300)])
def test_rupees_round_as_doubles(rupees, paise):
    assert C.paise(rupees) == paise


def test_yaml_round_trip(tmp_path):
    for n, card in enumerate([*C.bundled_cards(), C.decode_card(GOOD)]):
        path = tmp_path / f"{n}.yaml"
        path.write_text(yaml.safe_dump(C.encode_card(card)))
        assert C.load_cards(str(path)) == [card]
    with pytest.raises(FileNotFoundError):
        C.load_cards(str(tmp_path / "missing.yaml"))


def test_a_bundle_is_a_table_with_its_errors(spark, tmp_path):
    bad = changed(["rules", 0, "when"], {"all": [{"channel": "phone"}, {"amount_gte": "1"}]})
    texts = {"good": yaml.safe_dump(GOOD), "sbi": yaml.safe_dump(C.SBI_CASHBACK), "bad": yaml.safe_dump(bad), "broken": "a: [", "empty": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    rows = C.read_bundle(spark, str(tmp_path)).collect()
    of = lambda file: [r for r in rows if r["file"] == f"{file}.yaml"]
    assert [(r["kind"], r["path"]) for r in of("bad")] == [("error", "rules[0].when.all[0].channel"), ("error", "rules[0].when.all[1].amount_gte")]
    assert [r["kind"] for r in of("broken")] == ["error"] and "YAML" in of("broken")[0]["reason"] and of("empty")[0]["reason"].startswith("expected a map")
    assert [(r["kind"], r["id"]) for r in of("good")] == [("card", "good"), ("bucket", "cap"), ("bucket", "pool"), ("rule", "a"), ("rule", "b"), ("rule", "c"), ("milestone", "m"), ("exclusion", "6513"), ("exclusion", "fuel")]
    assert json.loads(of("sbi")[4]["data"])["earn"] == {"rate": 0.05, "unit": "cashback"} and all(r["reason"] is None for r in of("good") + of("sbi"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        C.read_bundle(spark, str(tmp_path / "missing.yaml"))


def test_published_terms_pay_as_published(spark):
    """Worked examples of the three bundled cards."""
    sbi, axis, icici = C.bundled_cards()
    spend = lambda rupees, tags=(), mcc=None, channel="online": spark.range(1).select(F.lit(rupees * 100).cast("long").alias("amount_paise"), F.lit(mcc).cast("int").alias("mcc"), F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"), F.lit(channel).alias("channel"), F.lit(date(2026, 8, 20)).alias("date"))
    paid = lambda card, row, state=None: row.select(rewards.marginal_reward(card, state and F.create_map(*(x for k, v in state.items() for x in (F.lit(k), F.lit(v).cast("bigint"))))).alias("r")).first()["r"]
    assert (paid(sbi, spend(1000))["rupees_paise"], paid(sbi, spend(1000, channel="offline"))["rupees_paise"]) == (5000, 1000)
    capped = paid(sbi, spend(50_000))
    assert capped["rupees_paise"] == 200_000 and "Online cashback" in capped["explanation"]
    shared = paid(sbi, spend(50_000, channel="offline"), {"overall_cap": 390_000})
    assert shared["rupees_paise"] == 10_000 and [b["bucket_id"] for b in shared["buckets"] if b["clamped"]] == ["overall_cap"]
    assert paid(sbi, spend(3000, ["fuel"]))["rupees_paise"] == 0 and paid(axis, spend(5000, ["rent"]))["rupees_paise"] == 0
    assert [paid(axis, spend(1000, *x))["rule_id"] for x in ((["google_pay"], 4814), ((), 4814), (["swiggy"],))] == ["utility_googlepay", "base", "food_and_travel"]
    empty = paid(axis, spend(1000, ["swiggy"]), {"accelerated_cap": 50_000})
    assert (empty["rule_id"], empty["rupees_paise"]) == ("base", 1500)
    assert paid(axis, spend(200_000))["rupees_paise"] == 300_000 and paid(axis, spend(200_000))["buckets"] == []
    assert (paid(icici, spend(1000, ["amazon"]))["rupees_paise"], paid(icici, spend(200_000))["rupees_paise"]) == (5000, 200_000)
    ranked = rewards.rank_cards(spend(20_000).withColumn("id", F.lit(1)), [sbi, axis, icici], ["id"], {"sbi-cashback": F.create_map(F.lit("online_cap"), F.lit(195_000).cast("bigint"))}).orderBy("rank").collect()
    assert [(r["card_id"], r["rupees_paise"]) for r in ranked] == [("axis-ace", 30_000), ("amazon-pay-icici", 20_000), ("sbi-cashback", 5000)]
