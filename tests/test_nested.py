"""Masking of nested records against plain recursion over parsed JSON."""

import json
import random
import re

from lendmill.operators import nested
from lendmill.plans import marked

# Shapes and masks as plain patterns.
SCRUBS = [(r"(?i)\b([A-Z]{2})[A-Z]{3}[0-9]{3}([0-9][A-Z])\b", r"\1******\2"), (r"\b([0-9]{4}-[0-9]{2}-)([0-9]{2})\b", r"****-**-\2"), (r"(?a)\b[0-9]{4}[-\s]?[0-9]{4}[-\s]?([0-9]{4})\b", r"****-****-\1")]
REDACTS = [(r"(?a)(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)", "************"), (r"(?a)(?<![A-Z0-9])[A-Z]{5}(\d{4}[A-Z])(?![A-Z0-9])", r"*****\1"), (r"(?a)[\w.+-]+@([\w-]+\.[\w.]+)", r"***@\1"), (r"(?a)(?<!\d)(?:\+91[- ]?)?[6-9]\d{6}(\d{3})(?!\d)", r"*******\1")]


def scrub(text: str, patterns: list) -> str:
    for pattern, mask in patterns:
        text = re.sub(pattern, mask, text)
    return text


def member(name: str, value: str) -> str:
    low = name.lower()
    if "pan" in low:
        return f"{value[:2]}******{value[-2:]}" if len(value) >= 10 else "****"
    if "dob" in low:
        return f"****-**-{value[-2:]}" if len(value) >= 10 else "****-**-**"
    if "aadhaar" in low:
        return f"****-****-{value[-4:]}" if len(value) >= 4 else "****"
    return value


def by_name(node):
    if isinstance(node, str):
        return scrub(node, SCRUBS)
    if isinstance(node, dict):
        return {k: member(k, v) if isinstance(v, str) else by_name(v) if isinstance(v, (dict, list)) else v for k, v in node.items()}
    return [by_name(v) for v in node] if isinstance(node, list) else node


def everywhere(node):
    if isinstance(node, str):
        return scrub(node, REDACTS)
    if isinstance(node, dict):
        return {scrub(k, REDACTS): everywhere(v) for k, v in node.items()}
    return [everywhere(v) for v in node] if isinstance(node, list) else node


WORDS = ["ABCPK1234F", "abcpk1234f", "1990-05-11", "2345 6789 0123", "234567890123", "a@b.cd", "+91 9876543210", 'q"\\/', "line\nfeed\t", "é日本", "", "x", "1234", "99999-1990-05-11"]
NAMES = ["pan", "companyName", "DOB", "my_aadhaar", "note", "", 'q"x', "ABCPK1234F", "a:b", "[", "dob,{"]


def grown(own: random.Random, depth: int):
    kind = own.random()
    if depth == 0 or kind < 0.4:
        return own.choice([" ".join(own.choice(WORDS) for _ in range(own.randint(1, 3))), own.choice(WORDS), 5, -1.5, None, True, 123456789012])
    if kind < 0.7:
        return {own.choice(NAMES) + str(i): grown(own, depth - 1) for i in range(own.randint(0, 4))}
    return [grown(own, depth - 1) for _ in range(own.randint(0, 4))]


def test_random_records(spark):
    own = random.Random(2)
    records = [grown(own, own.randint(0, 6)) for _ in range(300)]
    deep = "x ABCPK1234F"
    for i in range(200):
        deep = {"pan": deep} if i % 2 else [deep, "ABCPK1234F"]
    records += [deep, {"note": "line\n" * 20_000, "pan": "A\\" * 20_000}]
    rows = [(i, json.dumps(r, ensure_ascii=i % 3 == 0, indent=i % 4 or None)) for i, r in enumerate(records)] + [(9000, None), (9001, "")]
    frame = spark.createDataFrame(rows, "id long, json string")
    for mask, plain in ((nested.by_name, by_name), (nested.everywhere, everywhere)):
        got = {r.id: r.json for r in nested.masked(frame, mask).collect()}
        assert len(got) == len(rows) and got[9000] is None and got[9001] == ""
        wrong = [(r, got[i], plain(r)) for i, r in enumerate(records) if json.loads(got[i]) != plain(r)]
        assert not wrong, (len(wrong), wrong[0])
    # Marks outside of strings stay as they were.
    (one,) = nested.masked(spark.createDataFrame([(1, ' { "n" : 1.50e3 , "pan" :"ABCPK1234F"}')], "id long, json string"), nested.by_name).collect()
    assert one.json == ' { "n" : 1.50e3 , "pan" :"AB******4F"}'


def test_strict_masks_valid_numbers_only(spark):
    rows = spark.createDataFrame([(1, '["2341 2341 2346 and 234123412345"]')], "id long, json string")
    (got,) = nested.masked(rows, nested.everywhere_strict).collect()
    assert got.json == '["************ and 234123412345"]'


def test_redacted_query_as_by_recursion(spark, sf):
    source = {r.id: json.loads(r.json) for r in marked._records(spark, sf).collect()}
    got = marked.pii_redact_nested(spark, sf).collect()
    assert len(got) == len(source) and all(json.loads(r.redacted) == everywhere(source[r.doc_id]) for r in got)
    assert max(map(len, map(str, source.values()))) > 1000
