"""Schema findings against a plain validator on records that are broken at random places."""

import copy
import json
import random
import re

from lendmill.operators import schema
from lendmill.plans import marked

NAMES = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def plain(value, node: dict, path: str = "") -> list[tuple[str, str]]:
    while "$ref" in node:
        found = schema.COMPUTATION
        for part in node["$ref"][2:].split("/"):
            found = found[part]
        node = found
    out, kind = [], NAMES[type(value)]
    types = node.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and not any(t == kind or t == "integer" and kind == "number" and value == int(value) for t in types):
        out.append((path, "type"))
    if "enum" in node and value not in node["enum"]:
        out.append((path, "enum"))
    if kind == "number":
        out += [(path, k) for k, bad in (("minimum", value < node.get("minimum", value)), ("maximum", value > node.get("maximum", value))) if bad]
    if kind == "string":
        out += [(path, k) for k, bad in (("minLength", len(value) < node.get("minLength", 0)), ("pattern", "pattern" in node and not re.search(node["pattern"], value))) if bad]
    if kind == "object":
        known = node.get("properties", {})
        out += [(path, "required") for n in node.get("required", []) if n not in value]
        if node.get("additionalProperties") is False and set(value) - set(known):
            out.append((path, "additionalProperties"))
        out += [f for n, v in value.items() if n in known for f in plain(v, known[n], f"{path}/{n}")]
    if kind == "array":
        out += [(path, k) for k, bad in (("minItems", len(value) < node.get("minItems", 0)), ("maxItems", len(value) > node.get("maxItems", len(value)))) if bad]
        first = node.get("prefixItems", [])
        for i, v in enumerate(value):
            sub = first[i] if i < len(first) else node.get("items")
            out += plain(v, sub, f"{path}/{i}") if sub else []
    return out


def places(value, at: tuple = ()):
    yield at
    for key, below in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from places(below, (*at, key))


def test_records_broken_at_random(spark):
    own = random.Random(11)
    whole = json.loads('["one","two"]'.join(marked._COMPUTED))
    assert plain(whole, schema.COMPUTATION) == []
    records = [whole, {}, [], None, 5, "x"]
    for _ in range(250):
        one = copy.deepcopy(whole)
        for _ in range(own.randint(1, 4)):
            *way, last = own.choice([p for p in places(one) if p])
            holder = one
            for key in way:
                holder = holder[key]
            act = own.random()
            if act < 0.3:
                del holder[last]
            elif act < 0.5 and isinstance(holder, dict):
                holder["other"] = 1
            else:
                holder[last] = own.choice([None, True, -1, 0, 2.5, 3.0, "", "x", [], {}, {"paise": 1, "raw": "r"}, [1, "a", {}]])
        records.append(one)
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(9000, None), (9001, "{"), (9002, "")]
    got: dict[int, list] = {}
    for r in schema.findings(spark.createDataFrame(rows, "id long, json string"), schema.COMPUTATION).collect():
        got.setdefault(r.id, []).append((r.path, r.keyword))
    wrong = [(i, sorted(got.get(i, [])), sorted(plain(r, schema.COMPUTATION))) for i, r in enumerate(records) if sorted(got.get(i, [])) != sorted(plain(r, schema.COMPUTATION))]
    assert not wrong, (len(wrong), wrong[0], records[wrong[0][0]])
    assert 9000 not in got and got[9001] == got[9002] == [("", "json")]
    assert sum(map(len, got.values())) > 300
