"""Structure trees and code maps against plain readers on random input."""

import random

from lendmill.operators import codemaps, structure

SCHEMA = "doc long, node string, parent string, ordinal int, tag string, page int, text string"
TAGS = ["Table", "TR", "TR", "TD", "TD", "TH", "Sect", "P", "Tabelle", None]


def plain_tables(nodes: list[tuple]) -> list[tuple]:
    """Walk a tree by recursion: (table, page, row, cell, text)."""
    kids: dict = {}
    for node, parent, ordinal, tag, page, text in nodes:
        kids.setdefault(parent, []).append((ordinal or 0, node, "Table" if tag == "Tabelle" else tag, page, text))

    def grow(node: str, tag, page, text, depth: int) -> dict:
        below = [] if depth == structure.DEEPEST else [grow(n, t, p, x, depth + 1) for _, n, t, p, x in sorted(kids.get(node, []), key=lambda k: k[:2])]
        return {"tag": tag, "page": page, "text": text, "kids": below}

    def every(tree: dict):
        yield tree
        for kid in tree["kids"]:
            yield from every(kid)

    def cells(row: dict):
        for kid in row["kids"]:
            if kid["tag"] in structure.CELLS:
                yield kid
            else:
                yield from cells(kid)

    out, found = [], []
    for _, node, tag, page, text in sorted(kids.get(None, []), key=lambda k: k[:2]):
        found += [t for t in every(grow(node, tag, page, text, 0)) if t["tag"] == "Table"]
    for number, table in enumerate(found, 1):
        page = next((n["page"] for n in every(table) if n["page"] is not None), None)
        rows = [list(cells(r)) for r in every(table) if r["tag"] == "TR"]
        for i, row in enumerate((r for r in rows if r), 1):
            out += [(number, page, i, j, " ".join(x for n in every(c) if (x := (n["text"] or "").strip()))) for j, c in enumerate(row, 1)]
    return sorted(out, key=str)


def test_random_trees(spark):
    own, rows = random.Random(3), []
    for doc in range(30):
        names = ["a"]
        rows.append((doc, "a", None, 0, "Root", None, None))
        for i in range(own.choice([0, 3, 60])):
            parent = own.choice(names[-8:])
            names.append(f"n{i}")
            rows.append((doc, f"n{i}", parent, own.randint(0, 3), own.choice(TAGS), own.choice([None, None, 1, 2]), own.choice([None, "", " x ", f"t{i}"])))
        rows += [(doc, "x", "y", 0, "Table", 1, "x"), (doc, "y", "x", 0, "TR", 1, "y"), (doc, "z", "z", 0, "Table", 1, "z")]
    # A chain deeper than the walk: the table at level 61 is met, and what is beyond level 64 is not.
    for depth in range(80):
        tag = {61: "Table", 62: "TR", 63: "TD", 70: "Table"}.get(depth, "Div")
        rows.append((99, f"d{depth}", f"d{depth - 1}" if depth else None, 0, tag, None, f"level {depth}"))
    nodes = spark.createDataFrame(rows, SCHEMA)
    roles = spark.createDataFrame([(doc, "Tabelle", "Table") for doc in range(30)], "doc long, tag string, role string")
    got: dict[int, list] = {}
    for r in structure.tables(structure.walked(nodes, roles), nodes).collect():
        got.setdefault(r.doc, []).append((r.table_no, r.page, r.row_no, r.cell_no, r.text))
    for doc in {r[0] for r in rows}:
        assert sorted(got.get(doc, []), key=str) == plain_tables([r[1:] for r in rows if r[0] == doc]), doc
    assert got[99] == [(1, None, 1, 1, "level 63 level 64")]
    assert structure.tables(structure.walked(nodes.limit(0)), nodes).count() == 0


def plain_map(text: str) -> dict[int, str]:
    """Entries of a map in their order, the later one over the earlier."""
    import re

    number = lambda s: int(s, 16) if re.fullmatch("0*[0-9A-Fa-f]{1,8}", s) else None
    char = lambda n: chr(n) if n is not None and n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else ""
    word = lambda s: "".join(char(number(s[i : i + 4])) for i in range(0, len(s), 4)) or None
    token = re.compile(r"\[((?:<[^>]*>|[^\]<])*)\]|<([^>]*)>")
    out: dict[int, str] = {}
    for body in re.findall("(?s)beginbfchar(.*?)endbfchar", text):
        tokens = [(m[1], m[2]) for m in token.finditer(body)]
        for (_, a), (_, b) in zip(tokens[::2], tokens[1::2], strict=False):
            if a is not None and b is not None and number(a) is not None and word(b):
                out[number(a)] = word(b)
    for body in re.findall("(?s)beginbfrange(.*?)endbfrange", text):
        tokens = [(m[1], m[2]) for m in token.finditer(body)]
        for (_, a), (_, b), (many, one) in zip(tokens[::3], tokens[1::3], tokens[2::3], strict=False):
            low, high = (number(x) if x is not None else None for x in (a, b))
            if low is None or high is None:
                break
            if one is not None and number(one) is not None and low <= high < low + 65536:
                out |= {c: x for c in range(low, high + 1) if (x := char(number(one) + c - low))}
            elif one is None:
                out |= {low + i: x for i, s in enumerate(re.findall("<([^>]*)>", many)) if (x := word(s))}
    return out


def plain_text(data: bytes, known: dict[int, str]) -> str:
    if not known:
        return data.decode("utf-8", "replace")
    text, i = "", 0
    while i < len(data):
        two = known.get(data[i] << 8 | data[i + 1]) if i + 1 < len(data) else None
        text += two or known.get(data[i], chr(data[i]))
        i += 2 if two else 1
    return text


def test_random_code_maps(spark):
    own = random.Random(8)
    code = lambda: f"<{own.choice(['%02x', '%04X', '%04x']) % own.choice([own.randint(0, 6), own.randint(0, 0x0606)])}>"
    dst = lambda: own.choice([f"<{own.randint(65, 90):04x}>", "<00410042>", "<D83D>", "<>", "<D83D0041>", f"<{own.randint(0x3B1, 0x3C9):04X}>"])
    maps = []
    for font in range(12):
        text = " beginbfchar " + " ".join(code() + dst() for _ in range(own.randint(0, 5))) + " endbfchar beginbfrange"
        for _ in range(own.randint(0, 5)):
            low = own.randint(0, 5)
            text += f" <{low:02x}> <{low + own.randint(-1, 300):04x}> " + own.choice([dst(), f"[{dst()}{dst()} {dst()}]", "<D7FE>"])
        maps.append((font, text + own.choice([" endbfrange", " <q> <00> <0041> <00> <02> <0041> endbfrange", ""])))
    maps.append((50, "nothing"))
    strings = [(i, own.choice([f for f, _ in maps] + [77]), bytes(own.randint(0, 7) for _ in range(own.choice([0, 1, 9, 200])))) for i in range(150)] + [(900, 1, None), (901, 50, b"\xff a")]
    got = codemaps.decoded(spark.createDataFrame(strings, "id long, font long, data binary"), spark.createDataFrame(maps, "font long, map string"))
    known = {f: plain_map(t) for f, t in maps}
    want = {i: plain_text(bytes(d), known.get(f, {})) if d is not None else None for i, f, d in strings}
    found = {r.id: r.text for r in got.collect()}
    wrong = [(i, found.get(i), want[i]) for i in want if found.get(i) != want[i]]
    assert not wrong and len(found) == len(want), wrong[:3]


def test_walk_of_shared_nodes_and_many_siblings(spark):
    """paths are sibling numbers, so order holds beyond a byte of them, below several parents and for equal ordinals."""
    own, rows = random.Random(9), []
    for doc in range(8):
        names = ["a", "b"]
        rows += [(doc, "b", None, 1, "Table", None, "b"), (doc, "a", None, -1, "TR", 7, " a ")]
        for i in range(60):
            tag, page, text = own.choice(TAGS), own.choice([None, 3, 4]), own.choice([None, f" t{i}", "  "])
            for parent in own.sample(names[-12:], min(own.choice([1, 1, 1, 1, 2]), len(names[-12:]))):
                rows.append((doc, f"n{i}", parent, own.choice([None, -5, 0, 2]), tag, page, text))
            names.append(f"n{i}")
    rows += [(8, "t", None, 0, "Table", None, None)] + [(8, f"r{i}", "t", -i, "TR", i, None) for i in range(700)] + [(8, f"c{i}", f"r{i}", 0, "TD", None, f"{i}") for i in range(700)]
    nodes = spark.createDataFrame(rows, SCHEMA)
    roles = spark.createDataFrame([(doc, "Tabelle", "Table") for doc in range(9)] + [(0, None, "TR"), (0, "TD", None)], "doc long, tag string, role string")
    got: dict[int, list] = {}
    for r in structure.tables(structure.walked(nodes, roles, pieces=3), nodes, 3).collect():
        got.setdefault(r.doc, []).append((r.table_no, r.page, r.row_no, r.cell_no, r.text))
    for doc in range(9):
        assert sorted(got.get(doc, []), key=str) == plain_tables([r[1:] for r in rows if r[0] == doc]), doc
    assert len(got) == 9 and (1, 699, 1, 1, "699") in got[8]


def test_tables_are_made_without_a_join(spark, sf):
    """below the walk documents are read once, for their texts, and dealt once; nothing is joined."""
    import __spark_entry__ as entry

    plan = entry.queries()["src_tagged_tables"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("documents.parquet") == 1 and plan.count("hashpartitioning") == 1
    assert "ENSURE_REQUIREMENTS" not in plan
