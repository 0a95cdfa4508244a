"""Queries of text runs, account starts and month grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators import runs
from lendmill.registry import fold_sql, query
from lendmill.sources import layout as s
from lendmill.sources.tables import select_sql, table

CELL = {
    "doc_id": "l_suppkey",
    "row_no": "l_orderkey % 40",
    "seq": s.SEQ,
    "x0": "CAST((l_partkey * 13) % 600 AS DOUBLE)",
    "x1": "CAST((l_partkey * 13) % 600 + 20 AS DOUBLE)",
    "text": "CASE WHEN l_orderkey % 40 % 3 = 1 THEN concat(lpad(CAST(l_partkey % 14 AS STRING), 2, '0'), '-', lpad(CAST(l_partkey % 30 AS STRING), 2, '0')) WHEN l_partkey % 4 = 0 THEN '030' WHEN l_partkey % 4 = 1 THEN 'std' ELSE 'x1' END",
}
GRID_SQL = f"""WITH cells AS ({select_sql(CELL, 'lineitem')}), m AS (SELECT *, regexp_matches(trim(text), '^[0-9]{{2}}-[0-9]{{2}}$') AS label, (x0 + x1) / 2 AS c FROM cells),
r AS (SELECT doc_id, row_no, count(*) FILTER (WHERE label) >= 3 AS labels FROM m GROUP BY doc_id, row_no), a AS (SELECT *, lag(row_no) OVER w AS value_row, lag(labels) OVER w AS above FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY row_no)),
j AS (SELECT l.doc_id, l.seq AS label_seq, l.text AS name, v.text, v.seq, abs(l.c - v.c) AS gap FROM a JOIN m l ON l.doc_id = a.doc_id AND l.row_no = a.row_no JOIN m v ON v.doc_id = a.doc_id AND v.row_no = a.value_row
    WHERE a.labels AND NOT a.above AND l.label AND CAST(left(l.text, 2) AS INT) BETWEEN 1 AND 12 AND abs(l.c - v.c) <= 20),
b AS (SELECT doc_id, label_seq, 2000 + CAST(right(name, 2) AS INT) AS year, ['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC'][CAST(left(name, 2) AS INT)] AS month, (min((gap, seq, text)))[3] AS text FROM j GROUP BY doc_id, label_seq, name)
SELECT doc_id, label_seq, year, month, CASE WHEN upper(text) IN ('STD', 'SUB', 'DBT', 'LSS', 'SMA', 'XXX', 'NA', '*') THEN upper(text) WHEN regexp_matches(text, '^[0-9]+$') THEN text END AS token FROM b"""


@query("grid_mmyy", GRID_SQL)
def grid_mmyy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.month_grid(table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in CELL.items())))


_NEAR = """r.page = g.page AND abs(g.baseline - r.baseline) <= least(g.size, r.size) * 0.5 AND greatest(g.size, r.size) / greatest(least(g.size, r.size), 0.01) <= 1.6
AND r.x0 - g.reach <= greatest(r.size, 1) AND r.x0 >= g.x0 - r.size"""


@query(
    "layout_run_assembly",
    f"""{s.WITH}, {fold_sql("SELECT *, x1 AS reach, y1 AS baseline, y1 - y0 AS size FROM elements", "page, seq", _NEAR, "page, x0, baseline, size", {"reach": "greatest(g.reach, r.x1)"})}
SELECT r.doc_id, r.page, grp AS run, min(r.x0) AS x0, max(r.x1) AS x1, arg_min(r.y1, r.seq) AS baseline, string_agg(r.text, ' ' ORDER BY r.seq) AS text FROM g JOIN r ON r.doc_id = g.doc_id AND r.k = g.k GROUP BY r.doc_id, r.page, grp""",
)
def layout_run_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of fragments."""
    found = s.elements(spark, sf_dir)
    return runs.assemble_runs(found.select("doc_id", "page", "seq", "x0", "x1", F.col("y1").alias("baseline"), (F.col("y1") - F.col("y0")).alias("size"), "text"))


_LINE = "r.page = g.page AND abs(r.center - g.center) <= greatest(least(r.height, g.height), 1) * 0.6"


@query(
    "layout_line_groups",
    f"""{s.WITH}, {fold_sql("SELECT *, (y0 + y1) / 2 AS center, y1 - y0 AS height FROM elements", "page, (y0 + y1) / 2, x0, seq", _LINE, "page, center, height")}
SELECT r.doc_id, r.page, grp AS line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, r.center, r.seq) AS text FROM g JOIN r ON r.doc_id = g.doc_id AND r.k = g.k GROUP BY r.doc_id, r.page, grp""",
)
def layout_line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sheets and pay slips, anchored at the center of their first element."""
    return runs.line_groups(s.elements(spark, sf_dir))


_SAME = "r.page = g.page AND r.y0 - g.y0 < 100 OR r.page = g.page + 1 AND abs(r.seq - g.own) < 20"


@query("layout_account_starts", f"{s.WITH}, {fold_sql('SELECT *, seq AS own FROM elements WHERE is_label', 'page, y0, seq', _SAME, 'page, y0, own')} SELECT doc_id, page, y0, seq FROM g WHERE own = seq")
def layout_account_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.account_starts(s.elements(spark, sf_dir).filter("is_label"))


YEAR_CELL = {
    "doc_id": "l_orderkey",
    "seq": s.SEQ,
    "x0": "CASE WHEN l_partkey % 5 = 0 THEN 10.0 ELSE CAST((l_partkey * 13) % 600 AS DOUBLE) END",
    "x1": "CASE WHEN l_partkey % 5 = 0 THEN 40.0 ELSE CAST((l_partkey * 13) % 600 + 18 AS DOUBLE) END",
    "y0": "CAST(l_suppkey % 4 * 20 AS DOUBLE)",
    "y1": "CAST(l_suppkey % 4 * 20 + 12 AS DOUBLE)",
    "text": "CASE WHEN l_partkey % 5 = 0 THEN CAST(2010 + l_suppkey % 4 AS STRING) WHEN l_partkey % 4 = 1 THEN 'std' WHEN l_partkey % 4 = 2 THEN '2024-01' ELSE '030' END",
}
_HEAD = "SELECT o_orderkey AS doc_id, m AS month_no, CAST(40 + m * 45 AS DOUBLE) AS x0, CAST(60 + m * 45 AS DOUBLE) AS x1 FROM orders, (SELECT unnest(range(1, 13))::INT AS m)"


@query(
    "grid_year_rows",
    f"""WITH e AS ({select_sql(YEAR_CELL, 'lineitem')}), h AS ({_HEAD}), b AS (SELECT doc_id, min(x0) AS begins FROM h GROUP BY doc_id), y AS (SELECT e.*, CAST(text AS INT) AS year FROM e JOIN b USING (doc_id) WHERE regexp_full_match(trim(text), '20[0-9]{{2}}') AND x0 < begins),
v AS (SELECT e.doc_id, y.year, e.seq, e.x0, (e.x0 + e.x1) / 2 AS c, e.text FROM e JOIN y ON y.doc_id = e.doc_id AND e.y0 < y.y1 AND e.y1 > y.y0 AND e.x0 > y.x1),
n AS (SELECT v.doc_id, year, seq, v.x0, text, (min((abs(c - (h.x0 + h.x1) / 2), month_no)))[2] AS month_no FROM v JOIN h ON h.doc_id = v.doc_id GROUP BY v.doc_id, year, seq, v.x0, text),
t AS (SELECT doc_id, year, month_no, (max((x0, seq, text)))[3] AS text FROM n GROUP BY doc_id, year, month_no)
SELECT doc_id, year, ['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC'][month_no] AS month, CASE WHEN upper(text) IN ('STD', 'SUB', 'DBT', 'LSS', 'SMA', 'XXX', 'NA', '*') THEN upper(text) WHEN regexp_matches(text, '^[0-9]+$') THEN text END AS token FROM t""",
)
def grid_year_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_no"))
    header = months.select("doc_id", "month_no", (40.0 + F.col("month_no") * 45).alias("x0"), (60.0 + F.col("month_no") * 45).alias("x1"))
    return runs.year_grid(table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in YEAR_CELL.items())), header)
