"""Positioned elements and labelled lines derived from line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.sources.tables import dealt, select_sql, table

#: A number for each line item that its own values give, so that both engines number alike.
SEQ = "(l_partkey * 1000003 + l_suppkey * 10007 + CAST(floor(l_extendedprice * 100) AS BIGINT)) % 1000000007"
ELEMENT = {
    "doc_id": "l_orderkey",
    "seq": SEQ,
    "page": "CAST(l_linenumber % 3 + 1 AS INT)",
    "row": "CAST(l_suppkey % 3 AS INT)",
    "x0": "CAST((l_partkey * 13) % 600 AS DOUBLE)",
    "x1": "CAST((l_partkey * 13) % 600 + 20 + l_suppkey % 30 AS DOUBLE)",
    "y0": "CAST((l_partkey * 17 + l_suppkey) % 780 AS DOUBLE)",
    "y1": "CAST((l_partkey * 17 + l_suppkey) % 780 + 8 + l_partkey % 6 AS DOUBLE)",
    "text": "CASE l_suppkey % 4 WHEN 0 THEN concat('Page ', CAST(l_linenumber AS STRING), ' of 3') WHEN 1 THEN 'Member Copy' WHEN 2 THEN 'JAN' ELSE 'DEC' END",
    "is_label": "l_partkey % 4 = 0",
}
_LABELS = ("Income from Salaries", "Income from House Property", "Profits of Business", "Capital Gains", "Income from Other Sources", "Gross Total Income", "Basic pay", "Rent received", "Interest", "Dividend", "EARNINGS", "DEDUCTIONS")
LINE = {
    "doc_id": "l_orderkey",
    "line_no": SEQ,
    "label": f"CASE (l_partkey + l_suppkey) % {len(_LABELS)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_LABELS)) + " END",
    "paise": "CASE WHEN l_partkey % 5 <> 0 THEN CAST(floor(l_extendedprice) AS BIGINT) * 100 + l_partkey % 100 END",
}
_A = "CAST(floor(o_totalprice) AS BIGINT) * 100"
SHEET = {
    "sheet_id": "o_orderkey",
    "ay_start": "CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END",
    "fy_start": "CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) - CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END END",
    "fy_source": "CASE WHEN o_orderkey % 3 = 0 THEN 'derived' ELSE 'stated' END",
    "salary": f"CASE WHEN o_orderkey % 4 <> 0 THEN {_A} END",
    "house_property": "CASE WHEN o_orderkey % 4 = 1 THEN -2000000 END",
    "business": "CASE WHEN o_orderkey % 4 = 2 THEN o_orderkey % 1000 * 100 END",
    "capital_gains": "CAST(NULL AS BIGINT)",
    "other_sources": "CASE WHEN o_orderkey % 6 = 0 THEN 5000 END",
    "gross_total": f"CASE WHEN o_orderkey % 9 <> 0 THEN CASE WHEN o_orderkey % 4 <> 0 THEN {_A} ELSE 0 END + CASE o_orderkey % 4 WHEN 1 THEN -2000000 WHEN 2 THEN o_orderkey % 1000 * 100 ELSE 0 END + CASE WHEN o_orderkey % 6 = 0 THEN 5000 ELSE 0 END + o_orderkey % 4 * 50 END",
    "deductions_total": "CASE WHEN o_orderkey % 8 <> 0 THEN 15000000 END",
    "deduction_items": "CASE WHEN o_orderkey % 10 = 0 THEN 15000000 + o_orderkey % 30 * 10 WHEN o_orderkey % 10 = 1 THEN 15000000 END",
    "total_income": f"CASE WHEN o_orderkey % 13 <> 0 THEN ({_A} - 15000000 + o_orderkey % 17 * 60) - CASE WHEN o_orderkey % 2 = 0 THEN ({_A} - 15000000 + o_orderkey % 17 * 60) % 1000 ELSE 0 END END",
    "tax_due": "CASE WHEN o_orderkey % 15 <> 0 THEN o_orderkey * 100 END",
    "surcharge": "CASE WHEN o_orderkey % 3 = 0 THEN 1000 END",
    "cess": "CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey * 4 END",
    "interest": "CAST(NULL AS BIGINT)",
    "rebate": "CASE WHEN o_orderkey % 4 = 0 THEN 700 END",
    "relief": "CAST(NULL AS BIGINT)",
    "credits": "CASE WHEN o_orderkey % 5 = 0 THEN 5000 END",
    "net_tax": "CASE WHEN o_orderkey % 16 <> 0 THEN o_orderkey * 100 + CASE o_orderkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN o_orderkey * 4 ELSE 0 END - o_orderkey % 7 * 40 END",
}


_READ = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in ELEMENT.items()))


def dealt_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, dealt by document before they are made."""
    return dealt(table(spark, sf_dir, "lineitem").select(*_READ), "l_orderkey").selectExpr(*(f"{e} AS {n}" for n, e in ELEMENT.items()))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in LINE.items()))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in SHEET.items()))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "explode(sequence(1, 3)) AS page").selectExpr("doc_id", "page", "CAST(760 + (doc_id + page) % 90 AS DOUBLE) AS height")


WITH = f"""WITH RECURSIVE elements AS ({select_sql(ELEMENT, "lineitem")}), lines AS ({select_sql(LINE, "lineitem")}), sheets AS ({select_sql(SHEET, "orders")}),
pages AS (SELECT doc_id, page, CAST(760 + (doc_id + page) % 90 AS DOUBLE) AS height FROM (SELECT o_orderkey AS doc_id, CAST(unnest([1, 2, 3]) AS INT) AS page FROM orders))"""


def block_json(text: Column) -> Column:
    """A struct (text, x0, y0, x1, y1, page, page_height) of a text block's JSON; a page without a height has 842 points."""
    b = F.from_json(text, "raw_text string, bounding_box array<double>, page_number int, page_height double")
    corners = (F.get(b["bounding_box"], F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))
    return F.struct(b["raw_text"].alias("text"), *corners, b["page_number"].alias("page"), F.coalesce(b["page_height"], F.lit(842.0)).alias("page_height"))
