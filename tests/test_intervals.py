"""Joins of intervals by grid cells against all pairs, and one document of very many elements."""

import random
import time

from lendmill.operators import extract, layout, runs

SCHEMA = "doc_id long, page long, seq long, x0 double, x1 double, y0 double, y1 double, text string"


def boxes(own: random.Random, docs: int, many: int) -> list[tuple]:
    out = []
    for doc in range(docs):
        for seq in range(many):
            x, y = own.choice([own.uniform(-50, 600), own.randint(0, 20) * 32.0]), own.choice([own.uniform(-50, 900), own.randint(0, 20) * 32.0])
            out.append((doc, seq % 2, seq, x, x + own.choice([0, 5, 90]), y, y + own.choice([0, 8, 32, 300]), own.choice(["2021", " 2022 ", "STD", "030", ""])))
    return out


def test_pairs_as_of_all_pairs(spark):
    rows = boxes(random.Random(1), 4, 70)
    elements = spark.createDataFrame(rows, SCHEMA)
    labels = elements.filter("seq % 5 = 0")
    got = sorted(map(tuple, layout.overlapping_right(labels, elements).collect()))
    want = sorted((a[0], a[1], a[2], b[2]) for a in rows if a[2] % 5 == 0 for b in rows if a[:2] == b[:2] and a[5] < b[6] and a[6] > b[5] and b[3] >= a[4])
    assert got == want and len(set(got)) == len(got) > 50
    edges = elements.filter("seq % 7 = 0").select("doc_id", "x0").distinct()
    known = {(r[0], r[3]) for r in rows if r[2] % 7 == 0}
    near = {(r[0], r[2]): min(((abs(r[3] - x), x) for d, x in known if d == r[0] and abs(r[3] - x) <= 6), default=None) for r in rows}
    assert {(r.doc_id, r.seq): r.edge for r in extract.cells_to_bands(elements, edges).collect()} == {k: v[1] for k, v in near.items() if v}


def test_years_and_months_as_of_all_pairs(spark):
    own = random.Random(2)
    rows = boxes(own, 3, 60)
    header = [(d, m, 250.0 + 30 * m, 270.0 + 30 * m) for d in range(3) for m in range(1, 13)]
    elements = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.year, r.month): r.token for r in runs.year_grid(elements, spark.createDataFrame(header, "doc_id long, month_no int, x0 double, x1 double")).collect()}
    best: dict = {}
    for d, _, _, x0, x1, y0, y1, text in rows:
        if text.strip()[:2] == "20" and x0 < 280:
            for e in rows:
                if e[0] == d and e[5] < y1 and e[6] > y0 and e[3] > x1:
                    _, month = min((abs((e[3] + e[4]) / 2 - (a + b) / 2), m) for dd, m, a, b in header if dd == d)
                    key = (d, int(text), month)
                    best[key] = max(best.get(key, (-1e9, -1, "")), (e[3], e[2], e[7]))
    assert {k[:2] for k in got} == {k[:2] for k in best} and len(got) == len(best)


def test_one_document_of_very_many_elements(spark):
    """100,000 elements of one document: rows of it meet within a grid cell, so this ends in seconds."""
    elements = spark.range(100_000).selectExpr("1L AS doc_id", "1L AS page", "id AS seq", "cast(id % 10 * 50 AS double) AS x0", "cast(id % 10 * 50 + 20 AS double) AS x1", "cast(id div 10 * 12 AS double) AS y0", "cast(id div 10 * 12 + 8 AS double) AS y1", "cast(id AS string) AS text")
    began = time.perf_counter()
    assert layout.overlapping_right(elements.filter("x0 = 0"), elements).count() == 90_000
    assert extract.cells_to_bands(elements.withColumn("x0", elements.seq * 7.0), elements.select("doc_id", (elements.seq * 7.0 + 1).alias("x0"))).count() == 100_000
    assert time.perf_counter() - began < 30
