"""Card rules: decoding, validation and the bundled terms.

Rule data is configuration, read once on the driver. Amounts are rupees in the data and integer
paise afterwards. Anything unknown is an error rather than skipped: ``decode_card`` raises the first,
``check_card`` and ``read_bundle`` tell all, each with its path.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

UNITS, PERIODS, CHANNELS = ("cashback", "points"), ("cycle", "month", "year"), ("online", "offline")


@dataclass(frozen=True)
class Predicate:
    """One of: always, all, any, not, mcc_in, channel, merchant_in, amount_gte, date_between."""

    op: str
    args: tuple = ()


@dataclass(frozen=True)
class Bucket:
    id: str
    limit_paise: int
    unit: str = "cashback"
    period: str = "cycle"
    label: str | None = None

    @property
    def title(self) -> str:
        return self.label or self.id


@dataclass(frozen=True)
class Rule:
    id: str
    when: Predicate
    rate: float
    unit: str = "cashback"
    consumes: tuple[str, ...] = ()
    description: str | None = None

    @property
    def title(self) -> str:
        percent = self.rate * 100
        return self.description or f"{percent:.{0 if percent % 1 == 0 else 1}f}% {self.unit}"


@dataclass(frozen=True)
class Milestone:
    id: str
    threshold_paise: int
    grant_paise: int
    period: str = "cycle"


@dataclass(frozen=True)
class Card:
    id: str
    name: str
    issuer: str
    buckets: tuple[Bucket, ...] = ()
    rules: tuple[Rule, ...] = ()
    excluded_mccs: tuple[int, ...] = ()
    excluded_tags: tuple[str, ...] = ()
    milestones: tuple[Milestone, ...] = ()
    point_value_paise: int = 0
    source_url: str = ""
    retrieved_on: date | None = None
    valid_from: date | None = None
    index: dict[str, Bucket] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        self.index.update({b.id: b for b in self.buckets})
        for rule in self.rules:
            for name in rule.consumes:
                if name in self.index and self.index[name].unit != rule.unit:
                    raise ValueError(f"{self.id}: rule {rule.id} earns {rule.unit}, bucket {name} holds {self.index[name].unit}")

    def bucket(self, name: str) -> Bucket | None:
        return self.index.get(name)


def paise(rupees: int | float) -> int:
    """Half away from zero, of the product in double arithmetic."""
    return int(Decimal(rupees * 100).quantize(Decimal(1), ROUND_HALF_UP))


@dataclass(frozen=True)
class Problem:
    """Where rule data is wrong, and why. A warning leaves the card usable."""

    path: str
    reason: str
    warning: bool = False

    def __str__(self) -> str:
        return f"{self.path or 'card'}: {self.reason}"


class _Wrong(Exception):
    """A value that stands for nothing; its problem is noted already."""


class _Decoder:
    """Reads rule data piece by piece and notes every problem with its path, so that one pass over a
    bundle names all of them."""

    def __init__(self) -> None:
        self.problems: list[Problem] = []

    def wrong(self, path: str, reason: str) -> _Wrong:
        self.problems.append(Problem(path, reason))
        return _Wrong()

    def attempt(self, read, *args):
        """The value read, or None where a problem was noted."""
        try:
            return read(*args)
        except _Wrong:
            return None

    def map(self, value, path: str) -> dict[str, object]:
        if not isinstance(value, dict):
            raise self.wrong(path, f"expected a map, got {value!r}")
        return {str(k): v for k, v in value.items()}

    def list(self, value, path: str) -> list:
        if value is None:
            return []
        if not isinstance(value, list):
            raise self.wrong(path, f"expected a list, got {value!r}")
        return value

    def every(self, value, path: str, read) -> tuple:
        """All items of a list; each item's problems are noted before the list is given up."""
        items = [self.attempt(read, x, f"{path}[{k}]") for k, x in enumerate(self.list(value, path))]
        if any(x is None for x in items):
            raise _Wrong
        return tuple(items)

    def text(self, data: dict, key: str, path: str) -> str:
        if data.get(key) is None:
            raise self.wrong(_under(path, key), "a required field is missing")
        return str(data[key])

    def one_of(self, value, allowed: tuple[str, ...], what: str, path: str) -> str:
        if value not in allowed:
            raise self.wrong(path, f"unknown {what}: {value!r}")
        return value

    def number(self, value, path: str, what: str = "a number") -> int | float:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise self.wrong(path, f"expected {what}, got {value!r}")
        return value

    def rupees(self, value, path: str) -> int:
        return paise(self.number(value, path, "a rupee amount"))

    def date(self, value, path: str) -> date:
        if isinstance(value, datetime):
            return value.date()
        if isinstance(value, date):
            return value
        try:
            return date.fromisoformat(str(value)[:10])
        except ValueError:
            raise self.wrong(path, f"expected a date, got {value!r}") from None

    def together(self, **parts):
        """All parts of an entity by name, each tried before it is given up."""
        found = {name: self.attempt(*part) for name, part in parts.items()}
        if any(v is None for v in found.values()):
            raise _Wrong
        return found

    def predicate(self, data, path: str) -> Predicate:
        if data is None:
            raise self.wrong(path, "a rule needs a predicate")
        whole = self.map(data, path)
        if len(whole) != 1:
            raise self.wrong(path, f"a predicate is a map of one operator, found {sorted(whole)}")
        (op, value), = whole.items()
        own = _under(path, op)
        if op == "always":
            return Predicate(op)
        if op in ("all", "any"):
            return Predicate(op, self.every(value, own, self.predicate))
        if op == "not":
            return Predicate(op, (self.predicate(value, own),))
        if op == "mcc_in":
            return Predicate(op, tuple(int(x) for x in self.every(value, own, self.number)))
        if op == "merchant_in":
            return Predicate(op, tuple(map(str, self.list(value, own))))
        if op == "channel":
            return Predicate(op, (self.one_of(value, CHANNELS, "channel", own),))
        if op == "amount_gte":
            return Predicate(op, (self.rupees(value, own),))
        if op == "date_between":
            ends = self.map(value, own)
            return Predicate(op, tuple(self.together(**{k: (self.date, ends.get(k), _under(own, k)) for k in ("from", "to")}).values()))
        raise self.wrong(own, f"unknown predicate operator {op!r}; the grammar is closed")

    def bucket(self, data, path: str) -> Bucket:
        own = self.map(data, path)
        limit, at = self.map(own.get("limit"), _under(path, "limit")), _under(path, "limit")
        found = self.together(
            id=(self.text, own, "id", path), limit_paise=(self.rupees, limit.get("amount"), _under(at, "amount")), unit=(self.one_of, limit.get("unit"), UNITS, "reward unit", _under(at, "unit")),
            period=(self.one_of, limit.get("period") or "cycle", PERIODS, "period", _under(at, "period")),
        )
        return Bucket(**found, label=_text(own.get("label")))

    def rule(self, data, path: str) -> Rule:
        own = self.map(data, path)
        earn, at = self.attempt(self.map, own.get("earn"), _under(path, "earn")), _under(path, "earn")
        parts = {"id": (self.text, own, "id", path), "when": (self.predicate, own.get("when"), _under(path, "when")), "consumes": (self.list, own.get("consumes"), _under(path, "consumes"))}
        if earn is not None:
            parts |= {"rate": (self.number, earn.get("rate"), _under(at, "rate")), "unit": (self.one_of, earn.get("unit"), UNITS, "reward unit", _under(at, "unit"))}
        found = self.together(**parts)
        if earn is None:
            raise _Wrong
        return Rule(found["id"], found["when"], float(found["rate"]), found["unit"], tuple(map(str, found["consumes"])), _text(own.get("description")))

    def milestone(self, data, path: str) -> Milestone:
        own = self.map(data, path)
        return Milestone(**self.together(
            id=(self.text, own, "id", path), threshold_paise=(self.rupees, own.get("threshold"), _under(path, "threshold")), grant_paise=(self.rupees, own.get("grant"), _under(path, "grant")),
            period=(self.one_of, own.get("period") or "cycle", PERIODS, "period", _under(path, "period")),
        ))

    def address(self, data: dict) -> str:
        url = self.text(data, "source_url", "")
        if not url.startswith("http"):
            raise self.wrong("source_url", f"expected a web address, got {url!r}")
        return url

    def day(self, data: dict, key: str) -> date:
        self.text(data, key, "")
        return self.date(data[key], key)

    def card(self, data, path: str = "") -> Card:
        own = self.map(data, path)
        excluded = self.attempt(self.map, own.get("exclusions") or {}, "exclusions")
        found = self.together(
            id=(self.text, own, "card", ""), name=(self.text, own, "name", ""), issuer=(self.text, own, "issuer", ""), source_url=(self.address, own), retrieved_on=(self.day, own, "retrieved_on"), valid_from=(self.day, own, "valid_from"),
            buckets=(self.every, own.get("buckets"), "buckets", self.bucket), rules=(self.every, own.get("rules"), "rules", self.rule), milestones=(self.every, own.get("milestones"), "milestones", self.milestone),
            excluded_mccs=(self.every, (excluded or {}).get("mcc"), "exclusions.mcc", self.number), excluded_tags=(self.list, (excluded or {}).get("tags"), "exclusions.tags"), point_value_paise=(self.rupees, own.get("point_value") or 0, "point_value"),
        )
        if excluded is None:
            raise _Wrong
        found |= {"excluded_mccs": tuple(map(int, found["excluded_mccs"])), "excluded_tags": tuple(map(str, found["excluded_tags"]))}
        names = {b.id: b for b in found["buckets"]}
        for k, r in enumerate(found["rules"]):
            for j, name in enumerate(r.consumes):
                at = f"rules[{k}].consumes[{j}]"
                if name not in names:
                    self.problems.append(Problem(at, f"unknown bucket {name!r}, so its cap never binds", warning=True))
                elif names[name].unit != r.unit:
                    self.wrong(at, f"rule {r.id} earns {r.unit}, bucket {name} holds {names[name].unit}")
        if any(not p.warning for p in self.problems):
            raise _Wrong
        return Card(**found)


def _under(path: str, key: str) -> str:
    return f"{path}.{key}" if path else key


def _text(value) -> str | None:
    return None if value is None else str(value)


def check_card(data) -> tuple[Card | None, list[Problem]]:
    """The card, where nothing but warnings stands against it, and every problem of its data."""
    decoder = _Decoder()
    return decoder.attempt(decoder.card, data), decoder.problems


def decode_card(data) -> Card:
    """The card, or ``ValueError`` with the first problem."""
    card, problems = check_card(data)
    if card is None:
        raise ValueError(str(next(p for p in problems if not p.warning)))
    return card


def decode_predicate(data) -> Predicate:
    decoder = _Decoder()
    found = decoder.attempt(decoder.predicate, data, "when")
    if found is None:
        raise ValueError(str(decoder.problems[0]))
    return found


def _amount(value: int) -> int | float:
    return value // 100 if value % 100 == 0 else value / 100


def encode_predicate(p: Predicate) -> dict:
    match p.op:
        case "always":
            return {"always": True}
        case "all" | "any":
            return {p.op: [encode_predicate(x) for x in p.args]}
        case "not":
            return {"not": encode_predicate(p.args[0])}
        case "channel":
            return {"channel": p.args[0]}
        case "amount_gte":
            return {"amount_gte": _amount(p.args[0])}
        case "date_between":
            return {"date_between": {"from": p.args[0].isoformat(), "to": p.args[1].isoformat()}}
    return {p.op: list(p.args)}


def encode_card(card: Card) -> dict:
    """Rule data that ``decode_card`` reads as this card."""
    some = lambda **x: {k: v for k, v in x.items() if v not in (None, [], {})}
    return {
        "card": card.id, "name": card.name, "issuer": card.issuer, "source_url": card.source_url, "retrieved_on": card.retrieved_on.isoformat(), "valid_from": card.valid_from.isoformat(), "point_value": _amount(card.point_value_paise),
    } | some(
        buckets=[some(id=b.id, label=b.label, limit={"amount": _amount(b.limit_paise), "unit": b.unit, "period": b.period}) for b in card.buckets],
        rules=[some(id=r.id, description=r.description, when=encode_predicate(r.when), earn={"rate": r.rate, "unit": r.unit}, consumes=list(r.consumes)) for r in card.rules],
        milestones=[{"id": m.id, "threshold": _amount(m.threshold_paise), "grant": _amount(m.grant_paise), "period": m.period} for m in card.milestones],
        exclusions=some(mcc=list(card.excluded_mccs), tags=list(card.excluded_tags)),
    )


def load_cards(*paths: str) -> list[Card]:
    """Cards of an explicit list of YAML files, so that a missing one fails loudly."""
    import yaml

    return [decode_card(yaml.safe_load(Path(p).read_text(encoding="utf-8"))) for p in paths]


def read_bundle(spark: SparkSession, *paths: str) -> DataFrame:
    """A bundle of YAML files in any store that Spark reads, as a table: file, kind (card, bucket, rule,
    milestone, exclusion, error or warning), path, id, data (JSON of the piece; null of a problem) and
    reason (of a problem). All problems of all files have a row; a file that is no YAML has one."""
    from pyspark.sql import functions as F

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(unquote(posixpath.basename(path)), *row) for path, text in zip(frame["path"], frame["value"]) for row in _bundle_rows(text or "")]
            yield pd.DataFrame(found, columns=["file", "kind", "path", "id", "data", "reason"])

    texts = spark.read.text(list(paths), wholetext=True)
    # Spark has no row of an empty file, which must not pass as none
    plain = lambda path: F.regexp_replace(path, "^([a-z0-9+.-]+):/+", "$1:/").alias("path")
    named = spark.createDataFrame([(path,) for path in texts.inputFiles()], "path string").select(plain("path"))
    files = named.join(texts.select(plain("_metadata.file_path"), "value"), "path", "left")
    return files.mapInPandas(rows, "file string, kind string, path string, id string, data string, reason string")


def _bundle_rows(text: str) -> Iterator[tuple]:
    import yaml

    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as error:
        yield "error", "", None, None, f"no YAML: {' '.join(str(error).split())}"
        return
    card, problems = check_card(data)
    for p in problems:
        yield "warning" if p.warning else "error", p.path, None, None, p.reason
    if card is None:
        return
    whole, tell = encode_card(card), lambda x: json.dumps(x, sort_keys=True)
    parts = ("buckets", "rules", "milestones")
    yield "card", "", card.id, tell({k: v for k, v in whole.items() if k not in (*parts, "exclusions")}), None
    for part in parts:
        for k, x in enumerate(whole.get(part, ())):
            yield part[:-1], f"{part}[{k}]", x["id"], tell(x), None
    for kind, values in whole.get("exclusions", {}).items():
        for k, x in enumerate(values):
            yield "exclusion", f"exclusions.{kind}[{k}]", str(x), tell(x), None


# Published terms of three cards.
SBI_CASHBACK = {
    "card": "sbi-cashback", "name": "CASHBACK SBI Card", "issuer": "SBI Card", "valid_from": "2026-08-15", "retrieved_on": "2026-08-15",
    "source_url": "https://www.sbicard.com/en/faq/cashback-sbi-card-faq.page",
    "buckets": [
        {"id": "online_cap", "label": "Online cashback", "limit": {"amount": 2000, "unit": "cashback", "period": "cycle"}},
        {"id": "offline_cap", "label": "Offline cashback", "limit": {"amount": 2000, "unit": "cashback", "period": "cycle"}},
        {"id": "overall_cap", "label": "Overall cashback", "limit": {"amount": 4000, "unit": "cashback", "period": "cycle"}},
    ],
    "rules": [
        {"id": "online", "description": "5% on online transactions", "when": {"channel": "online"}, "earn": {"rate": 0.05, "unit": "cashback"}, "consumes": ["online_cap", "overall_cap"]},
        {"id": "offline", "description": "1% on offline transactions", "when": {"channel": "offline"}, "earn": {"rate": 0.01, "unit": "cashback"}, "consumes": ["offline_cap", "overall_cap"]},
    ],
    "exclusions": {"tags": ["fuel"]},
}
AXIS_ACE = {
    "card": "axis-ace", "name": "Axis Bank ACE", "issuer": "Axis Bank", "valid_from": "2024-04-20", "retrieved_on": "2026-08-15",
    "source_url": "https://www.axis.bank.in/docs/default-source/default-document-library/credit-card/axis-bank-ace-credit-card-tncs.pdf",
    "buckets": [{"id": "accelerated_cap", "label": "Accelerated cashback", "limit": {"amount": 500, "unit": "cashback", "period": "cycle"}}],
    "rules": [
        {"id": "utility_googlepay", "description": "5% on utility bills and recharges through Google Pay", "when": {"all": [{"mcc_in": [4814, 4816, 4899, 4900]}, {"merchant_in": ["google_pay"]}]}, "earn": {"rate": 0.05, "unit": "cashback"}, "consumes": ["accelerated_cap"]},
        {"id": "food_and_travel", "description": "4% on Swiggy, Zomato and Ola", "when": {"merchant_in": ["swiggy", "zomato", "ola"]}, "earn": {"rate": 0.04, "unit": "cashback"}, "consumes": ["accelerated_cap"]},
        {"id": "base", "description": "1.5% on other eligible merchants, uncapped", "when": {"always": True}, "earn": {"rate": 0.015, "unit": "cashback"}},
    ],
    "exclusions": {"tags": ["fuel", "emi", "wallet_load", "cash_advance", "rent", "gold", "insurance", "education", "card_fees", "utility_non_googlepay"]},
}
AMAZON_PAY_ICICI = {
    "card": "amazon-pay-icici", "name": "Amazon Pay ICICI", "issuer": "ICICI Bank", "valid_from": "2026-08-15", "retrieved_on": "2026-08-15", "point_value": 1,
    "source_url": "https://www.icici.bank.in/personal-banking/cards/credit-card/amazon-pay-credit-card/benefits-features",
    "buckets": [],
    "rules": [
        {"id": "amazon_prime", "description": "5% on Amazon.in for Prime members", "when": {"merchant_in": ["amazon"]}, "earn": {"rate": 0.05, "unit": "points"}},
        {"id": "partner_merchants", "description": "2% at Amazon Pay partner merchants", "when": {"merchant_in": ["amazon_pay_partner"]}, "earn": {"rate": 0.02, "unit": "points"}},
        {"id": "base", "description": "1% on all other payments, uncapped", "when": {"always": True}, "earn": {"rate": 0.01, "unit": "points"}},
    ],
}


def bundled_cards() -> list[Card]:
    return [decode_card(c) for c in (SBI_CASHBACK, AXIS_ACE, AMAZON_PAY_ICICI)]
