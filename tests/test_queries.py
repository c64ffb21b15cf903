"""Every registered query against its DuckDB equivalent, and the worked examples of the operators."""

from __future__ import annotations

import ast
import dataclasses
import itertools
import random
from datetime import date
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import allocation, merchants, quality, rewards
from tallyspark.operators.allocation import Wallet
from tallyspark.plans import domain
from tallyspark.plans.registry import ORACLE_SQL, QUERIES
from tallyspark.sources.cards import Bucket, Card, Milestone, Predicate, Rule, bundled_cards
from tallyspark.streaming import allocation as streams

ROOT = Path(__file__).resolve().parents[1]


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, sf)
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(found.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    order = [names.index(c) for c in sorted(names)]
    theirs = sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=key)
    ours = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in found.collect()), key=key)
    assert ours == theirs


@pytest.mark.parametrize("name", ["allocate_cycle", "leakage_report"])
def test_queries_without_sql_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_search_lies_between_greedy_and_optimum(spark, sf):
    rows = QUERIES["brute_force"](spark, sf).collect()
    assert rows and all(r["allocated_paise"] <= r["optimum_paise"] for r in rows)
    cycles = QUERIES["allocate_cycle"](spark, sf).collect()
    assert all(r["greedy_paise"] <= r["allocated_paise"] for r in cycles)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("shown", "paise"), [("1,234.50", 123450), ("-7", -700), ("0.5", 50), ("12.345", None), ("", None), ("abc", None), (None, None)])
def test_money(spark, shown, paise):
    assert one(spark, text.money(F.lit(shown).cast("string"))) == paise


@pytest.mark.parametrize(("shown", "paise", "explicit"), [
    ("800.00 Dr", -80000, True), ("(800.00)", -80000, True), ("CR 5", 500, True), ("₹1,000.00", 100000, False), ("Rs. 20-", -2000, True), ("INR 3.1", 310, False), ("-4", -400, True),
])
def test_amount(spark, shown, paise, explicit):
    assert tuple(one(spark, text.amount(F.lit(shown)))) == (paise, explicit)
    assert one(spark, text.amount(F.lit("SWIGGY"))) is None and one(spark, text.amount(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("shown", "day"), [
    ("05-08-26", date(2026, 8, 5)), ("5/8/1999", date(1999, 8, 5)), ("1.2.70", date(1970, 2, 1)), ("12 Aug 2026", date(2026, 8, 12)), ("12Sept69", date(2069, 9, 12)), ("31-02-26", None), ("99 Foo 26", None), ("", None),
])
def test_dates(spark, shown, day):
    assert one(spark, text.statement_date(F.lit(shown))) == day


def test_welded_date(spark):
    assert one(spark, text.starts_with_date(F.lit("05-08-26UPI/DR/1"))) and not one(spark, text.starts_with_date(F.lit("UPI 05-08-26")))


def test_descriptor(spark):
    d = one(spark, merchants.parse_descriptor(F.lit("UPI/DR/622012345678/Corner Shop/YESB/corner.shop/Pay")))
    assert (d["kind"], d["candidates"], d["reference"], d["handle"], d["note"]) == ("upi", ["CORNER SHOP", "PAY"], "622012345678", "corner.shop", "Pay")
    assert one(spark, merchants.parse_descriptor(F.lit(" ")))["kind"] == "unknown"


def test_jaro():
    assert round(merchants.jaro("MARTHA", "MARHTA"), 3) == 0.944 and merchants.jaro("", "") == 1.0 and merchants.jaro("a", "") == 0.0


def flat(card, rate, milestones=()):
    return Card(card, "", "", rules=(Rule("all", Predicate("always"), rate),), milestones=milestones)


def test_milestone_example():
    cards = [flat("two", 0.02), flat("goal", 0.01, (Milestone("m", 1_000_000, 50_000),))]
    wallet = Wallet(cards)
    spends = [(100_000, [[(0, 2000)], [(0, 1000)]]) for _ in range(10)]
    naive = sum(r + m for r, _, m in wallet.value(spends, wallet.greedy(spends)[0]))
    assignment, total = wallet.allocate(spends)
    assert (naive, total) == (20_000, 60_000) and wallet.brute_force(spends)[1] == 60_000
    assert sum(r + m for r, _, m in wallet.value(spends, assignment)) == total


def test_random_cycles_against_brute_force():
    rng, best = random.Random(20260815), 0
    for _ in range(200):
        cards = [flat(f"c{k}", 0.01, tuple(Milestone(f"m{j}", rng.randint(1, 40) * 10_000, rng.randint(1, 30) * 1000) for j in range(rng.randint(0, 1)))) for k in range(rng.randint(2, 3))]
        spends = [(amount, [[(0, rng.randint(1, amount // 20))] for _ in cards]) for amount in (rng.randint(5_000, 120_000) for _ in range(rng.randint(2, 7)))]
        wallet = Wallet(cards)
        naive = sum(r + m for r, _, m in wallet.value(spends, wallet.greedy(spends)[0]))
        assignment, total = wallet.allocate(spends)
        optimum = wallet.brute_force(spends)[1]
        assert naive <= total <= optimum and sum(r + m for r, _, m in wallet.value(spends, assignment)) == total
        best += total == optimum
    assert best > 150


def test_brute_force_equals_all_assignments():
    """Totals and first best assignments, ties and shared caps included, of a plain enumeration."""
    rng, cards = random.Random(4), bundled_cards()
    for trial in range(120):
        own = [*cards, flat("x", 0.01, (Milestone("m", 90_000, 900),))][: rng.randint(1, 4)] if trial % 2 else [flat(f"f{c}", rng.choice((0.01, 0.02)), (Milestone("m", 50_000, rng.choice((0, 700))),)) for c in range(rng.randint(1, 3))]
        start = [{b.id: rng.choice((0, b.limit_paise // 2, b.limit_paise - 300, b.limit_paise + 5)) for b in c.buckets} for c in own] if trial % 4 > 1 else None
        wallet, spends = Wallet(own, start), []
        for _ in range(rng.randint(0, 5)):
            amount = rng.choice((100, 10_000, 40_000, 3_000_000))
            spends.append((amount, [[(r, amount // (20 + 30 * r)) for r in range(len(c.rules)) if rng.random() < 0.8] for c in own]))
        best, most = [0] * len(spends), -1
        for tried in itertools.product(range(len(own)), repeat=len(spends)):
            total = sum(r + m for r, _, m in wallet.value(spends, list(tried)))
            if total > most:
                best, most = list(tried), total
        assert wallet.brute_force(spends) == (best, most)
        if spends:
            assert sum(r + m for r, _, m in wallet.value(spends, wallet.greedy(spends)[0])) <= wallet.allocate(spends)[1] <= most


def test_recommendation_flip_by_plain_arithmetic(spark, sf):
    """The winner at the flip is another than at the spend, and not yet within a rupee below it; where
    there is no flip, no doubled amount has another winner."""

    def winner(key, channel, amount):
        k, pay = key % 8, lambda rate: int(amount * rate / 10_000 + 0.5)
        own = 200_000 - (key % 5 * 50_000 if channel == "online" else key % 3 * 99_990)
        sbi = 0 if k == 2 else max(0, min(pay(500 if channel == "online" else 100), own, 400_000 - key % 7 * 66_000))
        fast = min(pay({5: 500, 0: 400, 7: 400}.get(k, 0)), 50_000 - key % 11 * 5_000)
        axis = 0 if k in (2, 3) else fast if fast > 0 else pay(150)
        return None if max(sbi, axis) <= 0 else "sbi" if sbi >= axis else "axis"

    spends = domain.spends(spark, sf)
    rows = spends.join(QUERIES["recommendation_flip"](spark, sf), "spend_id").select("spend_id", "channel", "amount_paise", "flip_paise").collect()
    assert len(rows) == spends.count()
    flips = 0
    for key, channel, amount, flip in rows:
        first = winner(key, channel, amount)
        if flip is not None:
            flips += 1
            assert first is not None and winner(key, channel, flip) != first
            assert any(winner(key, channel, below) == first for below in range(flip - 100, flip))
        elif first is not None:
            assert all(winner(key, channel, (2 * amount + 100) * 2**i) == first for i in range(30) if (2 * amount + 100) * 2**i <= 50_000_000)
    assert flips > 50


def test_leakage_sweep_scales_every_amount(spark, sf):
    """Each row of the sweep is the report on cycles whose amounts were multiplied beforehand."""
    found = {r["scale"]: r for r in QUERIES["leakage_sweep"](spark, sf).collect()}
    assert sorted(found) == [1, 2, 4, 8, 16, 32]
    base = sum(r["amount_paise"] for r in domain.spends(spark, sf).select("amount_paise").collect())
    for scale, row in found.items():
        assert row["spend_paise"] == base * scale and row["missed_paise"] == row["allocated_paise"] - row["greedy_paise"] >= 0
    from tallyspark.plans.registry import _goal_cards

    ten = domain.ordered_spends(spark, sf, 8)
    assert allocation.leakage_report(allocation.allocate_cycles(ten, _goal_cards())).first().asDict() == {k: v for k, v in found[8].asDict().items() if k != "scale"}


def test_states_bind_every_search(spark, sf):
    """A cycle whose buckets are full at its start is worth what its uncapped rules pay."""
    spends = domain.lineitem_spends(spark, sf).filter("cycle_id < 200")
    few = spends.groupBy("cycle_id").agg(F.count("*").alias("n")).filter("n <= 6").select("cycle_id")
    spends, cards = spends.join(few, "cycle_id"), bundled_cards()
    full = {c.id: F.create_map(*(x for b in c.buckets for x in (F.lit(b.id), F.lit(b.limit_paise).cast("bigint")))) for c in cards if c.buckets}
    uncapped = [dataclasses.replace(c, rules=tuple(r for r in c.rules if not any(c.bucket(b) for b in r.consumes))) for c in cards]
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    for search in (allocation.brute_force_cycles, lambda *a, **k: allocation.allocate_cycles(*a, **k).select("cycle_id", "greedy_paise", "allocated_paise")):
        assert rows(search(spends, cards, states=full)) == rows(search(spends, uncapped))


def test_brute_force_takes_every_cycle_within_the_guard(spark, sf):
    sizes = domain.lineitem_spends(spark, sf).groupBy("cycle_id").count().collect()
    found = {r["cycle_id"] for r in QUERIES["brute_force"](spark, sf).collect()}
    assert found == {r["cycle_id"] for r in sizes if r["count"] <= 12} and any(r["count"] > 6 for r in sizes if r["cycle_id"] in found)


def _as_stream(spark, orders, folder, batches):
    """The orders as files of one batch each, oldest spends first."""
    ranked = orders.withColumn("_n", F.ntile(batches).over(Window.orderBy("o_orderdate", "o_orderkey")))
    for n in range(batches):
        ranked.filter(F.col("_n") == n + 1).drop("_n").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_state_carries_over_batches(spark, sf, tmp_path):
    orders = domain.read(spark, sf, "orders")
    stream = _as_stream(spark, orders, str(tmp_path / "orders"), 3)
    routed = streams.run_available(streams.route(domain.as_spends(stream, 10), bundled_cards()), spark, f"file://{tmp_path}")
    whole = allocation.greedy_allocate(domain.ordered_spends(spark, sf, 10), bundled_cards())
    columns = ["cycle_id", "spend_seq", "card_id", "rupees_paise", "rule_id"]
    assert sorted(map(tuple, routed.select(columns).collect()), key=str) == sorted(map(tuple, whole.select(columns).collect()), key=str)


def test_silent_wallets_are_forgotten(spark, tmp_path):
    """An empty cap after the wallet's state timed out, a full one before."""
    card = Card("c", "", "", buckets=(Bucket("b", 100),), rules=(Rule("r", Predicate("always"), 0.1, consumes=("b",)),))
    days = ["2026-01-01", "2026-01-02", "2026-03-01", "2026-05-01", "2026-07-01"]
    wallets = [1, 1, 2, 2, 1]
    schema = "cycle_id long, spend_id long, amount_paise long, date date, event_time timestamp, mcc int, tags array<string>, channel string"
    for k, (day, wallet) in enumerate(zip(days, wallets)):
        row = spark.createDataFrame([(wallet, k, 1_000, date.fromisoformat(day))], "cycle_id long, spend_id long, amount_paise long, date date")
        row = row.select("*", F.col("date").cast("timestamp").alias("event_time"), F.lit(None).cast("int").alias("mcc"), F.array().cast("array<string>").alias("tags"), F.lit("online").alias("channel"))
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("event_time", "1 day")
    paid = {r["spend_id"]: (r["spend_seq"], r["rupees_paise"]) for r in streams.run_available(streams.route(stream, [card], keep_days=30), spark, f"file://{tmp_path}").collect()}
    assert paid[0] == (1, 100) and paid[1] == (2, 0) and paid[4] == (1, 100)


def test_first_mismatches_are_the_first(spark):
    rows = spark.createDataFrame([("d", n, 10, 100 * n) for n in range(9)] + [("e", 0, 10, None)], "doc string, n long, amount_paise long, balance_paise long")
    found = quality.first_mismatches(quality.reconcile(rows, "doc", ["n"]), "doc", 3).collect()
    assert sorted((r["position"], r["drift_paise"]) for r in found) == [(1, 90), (2, 90), (3, 90)]


def test_why_panel_without_room(spark):
    card = Card("c", "Card", "", buckets=(Bucket("b", 100),), rules=(Rule("r", Predicate("always"), 0.1, consumes=("b",)),), source_url="https://terms.example/x")
    spend = spark.sql("SELECT 1L AS id, 700L AS amount_paise, CAST(NULL AS INT) AS mcc, array() AS tags, 'online' AS channel, DATE '2026-01-01' AS date")
    for used, paid, tight in ((0, 70, False), (20, 70, True), (60, 40, True), (100, 0, False)):
        row = rewards.why_panel(spend, [card], ["id"], {"c": F.create_map(F.lit("b"), F.lit(used))}).first()
        assert (row["rupees_paise"], row["tight"], row["source_host"], row["rank"]) == (paid, tight, "terms.example", 1)


def test_no_cards():
    with pytest.raises(ValueError, match="at least one card"):
        Wallet([])


def test_leakage(spark):
    assert one(spark, allocation.leakage(F.lit(40), F.lit(60))) == pytest.approx(2 / 3) and one(spark, allocation.leakage(F.lit(-1), F.lit(60))) == 0 and one(spark, allocation.leakage(F.lit(1), F.lit(0))) == 0


def test_nothing_else_imports_the_training_data_package():
    for path in (ROOT / "tallyspark").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), path


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
