"""Coercions of bureau cells and amounts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean a clean month.
CLEAN_TOKENS = ("STD", "XXX", "*", "-", "")
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"


def number_of(token: Column) -> Column:
    """The token as a double where it is a plain number, else null."""
    return F.when(token.rlike(NUMBER), token.try_cast("double"))


def dpd_strict(token: Column) -> Column:
    """Days past due of a cell: clean tokens are 0, numbers lose their fraction, all else is null (an error)."""
    plain = F.upper(F.trim(token))
    return F.when(plain.isin(*CLEAN_TOKENS), F.lit(0)).otherwise(number_of(plain).cast("int"))


def dpd_lenient(token: Column) -> Column:
    """The same for reports: ``SMA`` is clean, what cannot be read is 0, and nothing is below 0."""
    plain = F.upper(F.trim(token))
    return F.when(plain.isin(*CLEAN_TOKENS, "SMA"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.coalesce(number_of(plain).cast("int"), F.lit(0))))


def dpd_token(token: Column) -> Column:
    """A printed cell cleaned for storage: known status codes in capitals, digits as they stand, else null."""
    plain = F.trim(token)
    # The status codes that a report prints.
    return F.when(F.upper(plain).isin("STD", "SUB", "DBT", "LSS", "SMA", "XXX", "NA", "*"), F.upper(plain)).when(plain.rlike(r"^\d+$"), plain)


def amount_digits(text: Column) -> Column:
    """All digits of a text as one whole number; signs and decimal points do not count."""
    return F.regexp_replace(text, r"[^0-9]", "").try_cast("bigint")


def amount_or_zero(text: Column) -> Column:
    """An amount with commas; ``NIL``, ``NONE``, ``NOT AVAILABLE``, nothing and unreadable text are 0."""
    plain = F.upper(F.trim(F.regexp_replace(text, ",", "")))
    return F.when(plain.isin("NIL", "NONE", "NOT AVAILABLE", ""), F.lit(0.0)).otherwise(F.coalesce(number_of(plain), F.lit(0.0)))


def code_point(code: Column) -> Column:
    """The character of a code point; null for surrogates and beyond the last one."""
    whole = (code >= 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(whole, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))
