"""Rich text against a plain reader that keeps its state in a stack, on random tokens."""

import random

import pytest
from pyspark.sql import functions as F

from lendmill.operators import chains, rtf


def control(text: str, i: int) -> tuple[str, int | None, int]:
    """The control at a backslash: its word or symbol, its number, where it ends."""
    j = i + 1
    if j >= len(text):
        return "", None, j
    if not (text[j].isascii() and text[j].isalpha()):
        return text[j], None, j + 1
    while j < len(text) and text[j].isascii() and text[j].isalpha():
        j += 1
    word, k = text[i + 1 : j], j
    if k < len(text) and text[k] == "-":
        k += 1
    while k < len(text) and text[k] in "0123456789":
        k += 1
    number = text[j:k]
    param = int(number) if number not in ("", "-") and -(2**31) <= int(number) < 2**31 else None
    return word, param, k + (text[k : k + 1] == " ")


def plain(text: str) -> list[tuple[int, int, str]]:
    """(row, column, text) of the cells that are not empty."""
    stack, cells, current, rows, i, fallback = [False], [], "", [], 0, 1
    while i < len(text):
        ch, hidden = text[i], stack[-1]
        i += 1
        if ch == "{":
            stack.append(hidden)
        elif ch == "}":
            stack[1:] = stack[1:-1] if len(stack) > 1 else []
        elif ch == "\\":
            word, param, i = control(text, i - 1)
            if word == "*" or word in rtf.DESTINATIONS:
                stack[-1] = True
            elif word in ("\\", "{", "}") and not hidden:
                current += word
            elif word in rtf.ROW_ENDS + rtf.CELL_ENDS and not hidden:
                cells.append(current)
                current = ""
                if word in rtf.ROW_ENDS:
                    rows.append(cells)
                    cells = []
            elif word == "uc":
                fallback = max(1 if param is None else param, 0)
            elif word == "u":
                code = None if param is None else param + 65536 if param < 0 else param
                if not hidden and code is not None and 0 <= code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
                    current += chr(code)
                for _ in range(fallback):
                    if i < len(text):
                        i = control(text, i)[2] if text[i] == "\\" else i + 1
            elif word == "'" and len(text) >= i + 2 and all(c in "0123456789abcdefABCDEF" for c in text[i : i + 2]):
                if not hidden:
                    current += chr(int(text[i : i + 2], 16))
                i += 2
        elif ch not in "\r\n" and not hidden:
            current += ch
    rows.append([*cells, current])
    shown = [[(c, x.strip()) for c, x in enumerate(row) if x.strip()] for row in rows]
    return [(n, c, x) for n, row in enumerate((r for r in shown if r), 1) for c, x in row]


PARTS = ["{", "}", "{", "}", "\\par ", "\\cell", "\\tab x", "word ", "a", "é", "\n", "\\'e9", "\\'zz", "\\*", "\\" + "u233?", "\\" + "u945", "\\" + "u-8704ab", "\\" + "u55296 ", "\\info ", "\\pict", "\\b0 ", "\\\\", "\\{", "\\~", "\\row", "\\" + "u128512 z", "  ", "\\"]


@pytest.mark.parametrize("seed", range(3))
def test_random_tokens(spark, seed):
    own = random.Random(seed)
    texts = ["", None, "\\", "{{{\\*a}b", "}}}x\\cell y", "\\" + "u1" * 1 + ("\\" + "u2") * 300 + " end"]
    texts += [("\\uc%d " % own.randint(0, 4) if own.random() < 0.5 else "") + "".join(own.choice(PARTS) for _ in range(own.randint(1, 60))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    runs = rtf.text_runs(rows)
    got: dict[int, list] = {}
    for r in runs.collect():
        got.setdefault(r.doc, []).append((r.row_no, r.column, r.text))
        assert (r.x, r.y, r.height) == (40 + 90 * r.column, 40 + 14 * (r.row_no - 1), 12) and r.width == max(8, 5 * len(r.text))
    wrong = [(t, sorted(got.get(i, [])), plain(t or "")) for i, t in enumerate(texts) if sorted(got.get(i, [])) != plain(t or "")]
    assert not wrong, (len(wrong), wrong[0])
    assert {r.doc for r in rtf.without_text(rows, runs).collect()} == {i for i, t in enumerate(texts) if not plain(t or "")}


def test_picks_along_a_line(spark):
    own = random.Random(4)
    rows = [(k, i, own.randint(0, 300)) for k in range(20) for i in range(own.choice([1, 5, 80]))]
    rows = [(k, i, at, at + own.randint(1, 40)) for k, i, at in rows]
    got = {(r.key, r.place) for r in chains.picked(spark.createDataFrame(rows, "key long, place long, at long, upto long"), ["key"], "at", "upto").collect()}
    want, end = set(), {}
    for k, i, at, upto in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if at >= end.get(k, -1):
            want.add((k, i))
            end[k] = upto
    assert got == want
    assert chains.picked(spark.createDataFrame([], "key long, place long, at long, upto long"), ["key"], "at", "upto").count() == 0


def test_depth_of_many_groups(spark):
    deep = "{" * 20_000 + "x" + "}" * 20_000 + "{\\*" + "{y}" * 1000 + "}z"
    assert [r.text for r in rtf.text_runs(spark.createDataFrame([(1, deep)], "doc long, text string")).select(F.col("text")).collect()] == ["xz"]
