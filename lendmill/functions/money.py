"""Exact amounts in minor units and tax years out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an amount may hold beside digits, and currency words that do not count.
CURRENCY = r"INR|RS\.|RS|CR|DR"
AMOUNT = r"^[0-9.,()+\- /₹\x{A0}]*$"
PAYSLIP_CURRENCY = r"INR|RS|CR|DR"
PAYSLIP_AMOUNT = r"^[0-9.,()+\- /₹\x{A0}:!\x{FFFD}]*$"


def _paise(digits: Column) -> Column:
    """Minor units of digits with at most one point; one decimal counts tenths, more than two are cut."""
    parts = F.split(digits, r"\.")
    decimals = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")
    cents = F.when(F.length(decimals) == 0, F.lit(0)).when(F.length(decimals) == 1, decimals.try_cast("int") * 10).otherwise(F.substring(decimals, 1, 2).try_cast("int"))
    return F.when(F.size(parts) <= 2, F.try_add(F.try_multiply(F.get(parts, F.lit(0)).try_cast("bigint"), F.lit(100).cast("bigint")), cents.cast("bigint")))


def money(text: Column, currency: str = CURRENCY, allowed: str = AMOUNT) -> Column:
    """Paise of a text that is one amount and nothing else, else null; brackets, a leading minus and DR make it negative."""
    raw = F.trim(text)
    upper = F.upper(raw)
    whole = F.regexp_replace(upper, currency, " ").rlike(allowed) & raw.rlike("[0-9]")
    negative = (raw.startswith("(") & raw.endswith(")")) | raw.startswith("-") | upper.endswith("DR")
    paise = _paise(F.regexp_replace(raw, "[^0-9.]", ""))
    return F.when(whole, F.when(negative, -paise).otherwise(paise))


def _amounts(text: Column, pattern: str) -> Column:
    """Paise of the amounts inside a text: with a separator, or of four digits at least."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    likely = F.filter(found, lambda c: c.rlike("[,.]") | (F.length(c) >= 4))
    return F.filter(F.transform(likely, lambda c: _paise(F.regexp_replace(c, ",", ""))), lambda x: x.isNotNull())


def first_money(text: Column, after: Column | int = 0) -> Column:
    """The first amount from a place on."""
    rest = F.substr(text, F.lit(after) + 1) if isinstance(after, int) else F.substr(text, after + 1)
    return F.get(_amounts(rest, r"[0-9](?:[0-9,.]*[0-9])?"), F.lit(0))


def last_money(text: Column) -> Column:
    found = _amounts(text, r"[0-9,.]*[0-9]")
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def year_range(text: Column) -> Column:
    """The first pair of neighbouring numbers that is a year and the next one (two digits count in its century)."""
    groups = F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(groups) - 2, F.lit(0))), lambda i: F.struct(F.get(groups, i).alias("a"), F.get(groups, i + 1).alias("b")))
    start = lambda p: F.when(F.length(p["a"]) == 4, p["a"].try_cast("int"))
    short = lambda p: F.floor(start(p) / 100).cast("int") * 100 + p["b"].try_cast("int")
    end = lambda p: F.when(F.length(p["b"]) == 4, p["b"].try_cast("int")).when(F.length(p["b"]) == 2, F.when(short(p) < start(p), short(p) + 100).otherwise(short(p)))
    good = F.filter(pairs, lambda p: start(p).between(1990, 2100) & (end(p) == start(p) + 1))
    return F.get(F.transform(good, lambda p: start(p)), F.lit(0))


def year_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))
