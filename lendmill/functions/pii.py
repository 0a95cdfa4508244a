"""Masking and checking of personal identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of identifiers.
PAN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
PINCODE = r"^[1-9][0-9]{5}$"
PHONE = r"^[6-9][0-9]{9}$"
DOB = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
UDYAM = r"^UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7}$"
ENTITY_CODES = "ABCFGHJLPTK"
# The two tables of the checksum, row by row: products of the group, and the permutation by place.
GROUP = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9,
    1, 2, 3, 4, 0, 6, 7, 8, 9, 5,
    2, 3, 4, 0, 1, 7, 8, 9, 5, 6,
    3, 4, 0, 1, 2, 8, 9, 5, 6, 7,
    4, 0, 1, 2, 3, 9, 5, 6, 7, 8,
    5, 9, 8, 7, 6, 0, 4, 3, 2, 1,
    6, 5, 9, 8, 7, 1, 0, 4, 3, 2,
    7, 6, 5, 9, 8, 2, 1, 0, 4, 3,
    8, 7, 6, 5, 9, 3, 2, 1, 0, 4,
    9, 8, 7, 6, 5, 4, 3, 2, 1, 0,
)
PLACES = (
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9,
    1, 5, 7, 6, 2, 8, 3, 0, 9, 4,
    5, 8, 0, 3, 7, 9, 6, 1, 4, 2,
    8, 9, 1, 6, 0, 4, 3, 5, 2, 7,
    9, 4, 5, 3, 1, 2, 6, 8, 7, 0,
    4, 2, 8, 6, 5, 7, 3, 9, 0, 1,
    2, 7, 9, 3, 8, 0, 6, 4, 1, 5,
    7, 0, 4, 6, 9, 1, 3, 2, 5, 8,
)


def mask_pan(value: Column) -> Column:
    return F.when(F.length(value) >= 10, F.concat(F.left(value, F.lit(2)), F.lit("******"), F.right(value, F.lit(2)))).otherwise("****")


def mask_dob(value: Column) -> Column:
    return F.when(F.length(value) >= 10, F.concat(F.lit("****-**-"), F.right(value, F.lit(2)))).otherwise("****-**-**")


def mask_aadhaar(value: Column) -> Column:
    return F.when(F.length(value) >= 4, F.concat(F.lit("****-****-"), F.right(value, F.lit(4)))).otherwise("****")


def mask_text(text: Column) -> Column:
    """Identifiers inside free text, in a fixed order."""
    # Shapes of identifiers in free text and what masks them.
    text = F.regexp_replace(text, r"(?i)\b([A-Z]{2})[A-Z]{3}[0-9]{3}([0-9][A-Z])\b", "$1******$2")
    text = F.regexp_replace(text, r"\b([0-9]{4}-[0-9]{2}-)([0-9]{2})\b", "****-**-$2")
    return F.regexp_replace(text, r"\b[0-9]{4}[-\s]?[0-9]{4}[-\s]?([0-9]{4})\b", "****-****-$1")


def mask_fields(columns: list[str]) -> list[Column]:
    """A projection that masks columns by what their names hold (a name with ``pan`` in it counts, ``company`` too)."""
    out = []
    for name in columns:
        low, value = name.lower(), F.col(name)
        masked = mask_pan(value) if "pan" in low else mask_dob(value) if "dob" in low else mask_aadhaar(value) if "aadhaar" in low else value
        out.append(F.when(value.isNotNull(), masked).alias(name))
    return out


def redact_text(text: Column, aadhaar: str = "************") -> Column:
    """Identifiers with their neighbours looked at: numbers inside longer numbers stay."""
    # Shapes of identifiers in free text and what masks them.
    return redact_other(F.regexp_replace(text, r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)", aadhaar))


def redact_other(text: Column) -> Column:
    """Tax numbers, mail addresses and telephone numbers in a text."""
    # Shapes of identifiers in free text and what masks them.
    text = F.regexp_replace(text, r"(?<![A-Z0-9])[A-Z]{5}(\d{4}[A-Z])(?![A-Z0-9])", "*****$1")
    text = F.regexp_replace(text, r"[\w.+-]+@([\w-]+\.[\w.]+)", "***@$1")
    return F.regexp_replace(text, r"(?<!\d)(?:\+91[- ]?)?[6-9]\d{6}(\d{3})(?!\d)", "*******$1")


def redact_simple(text: Column) -> Column:
    # Shape and mask.
    return F.regexp_replace(text, r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "[Aadhaar Redacted]")


def leaks(text: Column) -> Column:
    """How many numbers of twelve digits stand alone in a text, the first digit 2 to 9."""
    # Fixed value: the shape.
    return F.regexp_count(text, F.lit(r"(?<![\d.])[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}(?![\d.])"))


def verhoeff_valid(digits: Column) -> Column:
    """Twelve digits, the first 2 to 9, whose checksum holds."""
    group, turns = F.array(*map(F.lit, GROUP)), F.array(*map(F.lit, PLACES))
    places = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.element_at(turns, (i % 8) * 10 + F.substr(digits, 12 - i, F.lit(1)).cast("int") + 1))
    check = F.aggregate(places, F.lit(0), lambda c, p: F.element_at(group, c * 10 + p + 1))
    return F.when(digits.rlike(r"^[2-9][0-9]{11}$"), check == 0).otherwise(False)


def redact_strict(text: Column) -> Column:
    """Only numbers of twelve digits whose checksum holds are masked."""
    # Fixed value: the shape.
    pattern = r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    valid = F.filter(F.array_distinct(found), lambda m: verhoeff_valid(F.regexp_replace(m, "[ -]", "")))
    return F.aggregate(valid, text, lambda t, m: F.replace(t, m, F.lit("************")))


def pan_verdict(pan: Column) -> Column:
    upper = F.upper(F.trim(pan))
    known = F.substring(upper, 4, 1).isin(*ENTITY_CODES)
    return F.when(upper.rlike(PAN), F.when(known, "Valid").otherwise("UnknownEntityCode")).otherwise("BadShape")


def mask_target(channel: Column, target: Column) -> Column:
    """A phone's or mail address's short form for display."""
    at = F.instr(target, "@")
    phone = F.when(F.length(target) >= 4, F.concat(F.lit("******"), F.right(target, F.lit(4)))).otherwise("******")
    mail = F.when((at > 0) & (at < F.length(target)), F.concat(F.left(F.substr(target, F.lit(1), at - 1), F.lit(2)), F.lit("***@"), F.substr(target, at + 1))).otherwise("***")
    return F.when(channel == "mobile", phone).otherwise(mail)


def missing_identifiers(name: Column, pan: Column, control: Column, score: Column) -> Column:
    """Which of the four identifiers of a report are missing."""
    blank = F.trim(F.coalesce(name, F.lit("")))
    number = F.trim(F.coalesce(control, F.lit("")))
    return F.array_compact(
        F.array(
            F.when((blank == "") | (F.lower(blank) == "unknown"), "name"), F.when(F.length(F.trim(F.coalesce(pan, F.lit("")))) < 10, "PAN"), F.when(number.rlike(r"^0*$"), "control number"), F.when(F.coalesce(score, F.lit(0)) == 0, "CIBIL score")
        )
    )
