"""Plain counterparts of text functions, for passes that hold a page's lines in numpy anyway. Tests
hold them to the column expressions of ``text``."""

from __future__ import annotations

import re
from calendar import monthrange

from tallyspark.functions.text import MONTHS

_SPACE = " \t\n\x0b\f\r" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_LEADING, _TOKEN = re.compile(f"[{_SPACE}]+"), re.compile(f"[^{_SPACE}{chr(0x85)}]*")
_NUMERIC = re.compile(r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})")
_NAMED = re.compile(f"([0-9]{{1,2}})[-/{_SPACE}]*([A-Za-z]{{3,4}})[-/{_SPACE}]*([0-9]{{4}}|[0-9]{{2}})")
_MONTH = {name: k for k, name in enumerate(MONTHS, 1)} | {"sept": 9}


def _trimmed(text: str) -> str:
    lead = _LEADING.match(text)
    text = text[lead.end() :] if lead else text
    end = len(text)
    while end and _LEADING.match(text[end - 1]):
        end -= 1
    return text[:end]


def is_statement_date(text: str) -> bool:
    """Whether ``text.statement_date`` reads it as a day that exists."""
    text = _trimmed(text)
    if m := _NUMERIC.fullmatch(text):
        month = int(m[2])
    elif m := _NAMED.fullmatch(text):
        month = _MONTH.get(m[2].lower(), 0)
    else:
        return False
    year = int(m[3]) if len(m[3]) > 2 else int(m[3]) + (1900 if int(m[3]) >= 70 else 2000)
    return 1 <= month <= 12 and 1 <= int(m[1]) <= monthrange(year or 2000, month)[1]  # year 0 is a leap year


def starts_with_date(text: str | None) -> bool:
    """``text.starts_with_date``: the first token, or the first 10, 9, 8 or 6 characters."""
    if text is None:
        return False
    lead = _LEADING.match(text)
    text = text[lead.end() :] if lead else text
    if not text[:1].isdigit():  # what dates begin with
        return False
    return is_statement_date(_TOKEN.match(text)[0]) or any(len(text) >= n and is_statement_date(text[:n]) for n in (10, 9, 8, 6))
