"""Findings of JSON records against a schema: a schema is compiled once to one SQL expression over a parsed record.

Keywords: type, enum, required, properties, additionalProperties, items, prefixItems, minItems, maxItems, minLength, minimum,
maximum, pattern and $ref into $defs. A keyword speaks of values of its own type only; an array's elements are checked by
a function over the array, so a record of any size is one row until its findings are exploded. No shuffle, no UDF.

Cases: null is no record and has no finding; text that is no JSON has the one finding (``''``, ``json``), what follows a first whole value is not looked at; every finding is
returned, also several of one value; a missing member is a finding of its object for each name, members that the schema
does not know are one finding of theirs; numbers with a fraction of zero are integers.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTHING = "cast(array() as array<struct<path: string, keyword: string>>)"


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else '"' + text.replace("\\", "\\\\") + '"'


def _as(value: str, kind: str) -> str:
    return f"try_variant_get({value}, '$', '{kind}')"


def _kind(v: str) -> str:
    """object, array, string, boolean, number or null."""
    plain = f"case schema_of_variant({v}) when 'STRING' then 'string' when 'BOOLEAN' then 'boolean' else 'number' end"
    return f"case when is_variant_null({v}) then 'null' when {_as(v, 'map<string, variant>')} is not null then 'object' when {_as(v, 'array<variant>')} is not null then 'array' else {plain} end"


def compiled(schema: dict, value: str, path: str) -> str:
    """The findings of a value (an expression of type variant) as an expression."""
    names = count()

    def bound(inner: str, body: Callable[[str], str]) -> str:
        """The body over a value that is computed once."""
        x = f"x{next(names)}"
        return f"get(transform(array({inner}), {x} -> {body(x)}), 0)"

    def check(node: dict, v: str, at: str) -> str:
        while "$ref" in node:
            found = schema
            for part in node["$ref"].removeprefix("#/").split("/"):
                found = found[part]
            node = found
        return bound(f"struct({v} as v, {_kind(v)} as kind)", lambda b: body(node, f"{b}.v", f"{b}.kind", at))

    def body(node: dict, v: str, kind: str, at: str) -> str:
        wrong: dict[str, str] = {}
        if "type" in node:
            types, number = [node["type"]] if isinstance(node["type"], str) else node["type"], _as(v, "double")
            fits = [f"({kind} = 'number' and {number} = floor({number}))" if t == "integer" else f"{kind} = '{t}'" for t in types]
            wrong["type"] = f"not coalesce({' or '.join(fits)}, false)"
        if "enum" in node:
            known = ", ".join(_quoted(x) for x in node["enum"] if x is not None)
            null = f" or {kind} = 'null'" if None in node["enum"] else ""
            wrong["enum"] = f"not (({kind} = 'string' and {_as(v, 'string')} in ({known})){null})"
        for name, sign in (("minimum", "<"), ("maximum", ">")):
            if name in node:
                wrong[name] = f"{kind} = 'number' and {_as(v, 'double')} {sign} {node[name]}"
        for name, sign in (("minItems", "<"), ("maxItems", ">")):
            if name in node:
                wrong[name] = f"{kind} = 'array' and size({_as(v, 'array<variant>')}) {sign} {node[name]}"
        if "minLength" in node:
            wrong["minLength"] = f"{kind} = 'string' and length({_as(v, 'string')}) < {node['minLength']}"
        if "pattern" in node:
            wrong["pattern"] = f"{kind} = 'string' and not {_as(v, 'string')} rlike {_quoted(node['pattern'])}"
        properties, required, members = node.get("properties", {}), node.get("required", []), _as(v, "map<string, variant>")
        if node.get("additionalProperties") is False:
            known = f"array({', '.join(map(_quoted, properties))})" if properties else "cast(array() as array<string>)"
            wrong["additionalProperties"] = f"{kind} = 'object' and size(array_except(map_keys({members}), {known})) > 0"
        entry = lambda bad, keyword: f"case when {bad} then struct({at} as path, '{keyword}' as keyword) end"
        parts = [f"array_compact(array({', '.join(entry(bad, keyword) for keyword, bad in wrong.items())}))"] if wrong else []
        if required or properties:

            def of_members(m: str) -> str:
                absent = [entry(f"not map_contains_key({m}, {_quoted(name)})", "required") for name in required]
                below = [f"array_compact(array({', '.join(absent)}))"] if absent else []
                # Members of one kind are checked by one function, which keeps the expression small.
                kinds: dict[str, list[str]] = {}
                for name, sub in properties.items():
                    kinds.setdefault(json.dumps(sub), []).append(name)
                for sub, some in kinds.items():
                    e, x = f"x{next(names)}", f"x{next(names)}"
                    inner = check(json.loads(sub), f"{e}.value", f"concat({at}, '/', {e}.key)")
                    below.append(f"flatten(transform(filter(map_entries({m}), {x} -> {x}.key in ({', '.join(map(_quoted, some))})), {e} -> {inner}))")
                return f"concat({', '.join([*below, NOTHING])})"

            parts.append(f"case when {kind} = 'object' then {bound(members, of_members)} else {NOTHING} end")
        if "prefixItems" in node or "items" in node:
            x, i = f"x{next(names)}", f"x{next(names)}"
            rest = check(node["items"], x, f"concat({at}, '/', {i})") if "items" in node else NOTHING
            first = "".join(f" when {i} = {k} then {check(sub, x, f'concat({at}, {chr(39)}/{k}{chr(39)})')}" for k, sub in enumerate(node.get("prefixItems", [])))
            inner = f"case{first} else {rest} end" if first else rest
            parts.append(f"case when {kind} = 'array' then flatten(transform({_as(v, 'array<variant>')}, ({x}, {i}) -> {inner})) else {NOTHING} end")
        return f"concat({', '.join([*parts, NOTHING])})"

    return check(schema, value, path)


def findings(records: DataFrame, schema: dict) -> DataFrame:
    """(id, path, keyword) of records (id, json): a row for everything that breaks the schema."""
    broken = f"case when v is null then array(struct('' as path, 'json' as keyword)) else {compiled(schema, 'v', chr(39) * 2)} end"
    return records.filter("json is not null").select("id", F.try_parse_json("json").alias("v")).select("id", F.expr(f"inline({broken})"))


def _object(properties: dict, required: tuple[str, ...] = ()) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": properties, **({"required": list(required)} if required else {})}


def _all_of(kind: dict, *names: str) -> dict:
    return {name: kind for name in names}


# The schema of a flat computation, as records of other systems are written by it.
_TEXT, _MONEY, _BOX = {"type": ["string", "null"]}, {"$ref": "#/$defs/money"}, {"$ref": "#/$defs/bbox"}
COMPUTATION = _object(
    {
        "source": {"type": "string", "minLength": 1},
        "format": {"type": "string", "enum": ["Pdf", "Rtf"]},
        "regime": _TEXT,
        **_all_of({"$ref": "#/$defs/yearRange"}, "assessment_year", "financial_year"),
        "financial_year_source": {"type": ["string", "null"], "enum": ["stated", "derived", None]},
        "assessee": _object(
            _all_of(_TEXT, "name", "fathers_name", "address", "email", "status", "date_of_birth", "residential_status", "gender", "ward", "nature_of_business", "filing_status", "bank")
            | {"pan": _TEXT | {"pattern": "^[A-Z]{5}[0-9]{4}[A-Z]$"}, "aadhaar": _TEXT | {"enum": ["[Aadhaar Redacted]", None]}}
        ),
        "heads": _object(_all_of(_MONEY, "salary", "house_property", "business_profession", "capital_gains", "other_sources")),
        **_all_of(_MONEY, "gross_total_income", "total_income", "rounded_total_income"),
        "deductions": _object(
            {
                "items": {
                    "type": "array",
                    "items": _object({"section": {"type": "string", "minLength": 2}, "label": {"type": "string"}, "amount": _MONEY, "raw_line": {"type": "string"}}, ("section", "label", "raw_line")),
                },
                "total": _MONEY,
            },
            ("items",),
        ),
        "tax": _object(_all_of(_MONEY, "tax_due", "surcharge", "health_education_cess", "rebate_87a", "relief", "interest_234a", "interest_234b", "interest_234c", "total_tax", "net_tax_payable")),
        "credits": _object(_all_of(_MONEY, "tds", "tcs", "advance_tax", "self_assessment_140a")),
        "raw": _object(
            {"page_count": {"type": "integer", "minimum": 0}, "lines": {"type": "array", "items": {"$ref": "#/$defs/line"}}, "table": {"$ref": "#/$defs/table"}},
            ("page_count", "lines", "table"),
        ),
    },
    ("source", "format", "assessee", "heads", "deductions", "tax", "credits", "raw"),
) | {
    "$defs": {
        "money": _object({"paise": {"type": "integer"}, "raw": {"type": "string"}}, ("paise", "raw")) | {"type": ["object", "null"]},
        "yearRange": _object({"start": {"type": "integer", "minimum": 1990, "maximum": 2100}, "end": {"type": "integer", "minimum": 1991, "maximum": 2101}}, ("start", "end"))
        | {"type": ["object", "null"]},
        "bbox": _object(_all_of({"type": "number"}, "x", "y") | _all_of({"type": "number", "minimum": 0}, "width", "height"), ("x", "y", "width", "height")),
        "table": _object(
            {
                "columns": {"type": "array", "items": {"type": "array", "prefixItems": [{"type": "number"}, {"type": "number"}], "minItems": 2, "maxItems": 2}},
                "rows": {"type": "array", "items": {"$ref": "#/$defs/row"}},
            },
            ("columns", "rows"),
        ),
        "row": _object({"page": {"type": "integer", "minimum": 1}, "cells": {"type": "array", "items": {"$ref": "#/$defs/cell"}}}, ("page", "cells")),
        "cell": _object({"text": {"type": "string"}, "bbox": _BOX, "column": {"type": ["integer", "null"], "minimum": 0}}, ("text", "bbox")),
        "line": _object(
            {"page": {"type": "integer", "minimum": 1}, "bbox": _BOX, "segments": {"type": "array", "items": {"type": "string"}}, "segment_boxes": {"type": "array", "items": _BOX}},
            ("page", "bbox", "segments", "segment_boxes"),
        ),
    }
}
