"""Queries of labelled fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators import fields
from lendmill.registry import query
from lendmill.sources import layout as s
from lendmill.sources.tables import table

_N = "CAST(l_partkey % 9000 + 1000 AS STRING)"
#: kind -> cells of the line.
_CELLS = [
    ("'Gross  Total Income'", "'as per sheet'", f"concat('1,', {_N}, '.50')"),
    (f"concat('Gross Total Income : ', {_N})", "''", "''"),
    ("'TOTAL INCOME'", f"concat('(', {_N}, ')')", "'x'"),
    ("'Refund due'", f"concat('-', {_N})", "''"),
    ("'Tax Refundable'", "'none'", f"{_N}"),
    ("'Assessment Year 2024-25'", "''", "''"),
    ("'Financial Year'", "'2023-2024'", "''"),
    (f"concat('Employee Name: E', {_N})", "'z'", "''"),
    ("'Employee Name'", "' '", f"concat('F', {_N})"),
    ("'Paid Days'", "'28'", "''"),
    ("'Net Pay'", "''", f"concat('Rs ', {_N})"),
    ("'Amount in words'", "''", "'Rupees some'"),
    ("'nothing'", "'here'", f"{_N}"),
]
_KIND = f"(l_partkey + l_suppkey * 5) % {len(_CELLS)}"


def _cell(i: int) -> str:
    return f"CASE {_KIND} " + " ".join(f"WHEN {k} THEN {cells[i]}" for k, cells in enumerate(_CELLS)) + " END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", f"{s.SEQ} AS line_no", *(f"{_cell(i)} AS s{i}" for i in range(3)))
    return rows.select("doc_id", "line_no", F.array("s0", "s1", "s2").alias("segs"))


_FROM = f"FROM (SELECT l_orderkey AS doc_id, {s.SEQ} AS line_no, {_KIND} AS kind, l_partkey % 9000 + 1000 AS n FROM lineitem) GROUP BY doc_id"


def _first(value: str, kinds: str) -> str:
    return f"arg_min({value}, line_no) FILTER (WHERE kind IN ({kinds}))"


@query(
    "income_fields_first_hit",
    f"""SELECT doc_id, {_first("CASE kind WHEN 0 THEN 1000000 + n * 100 + 50 + 0 * n ELSE n * 100 END", "0, 1").replace("1000000 + n * 100 + 50 + 0 * n", "(10000 + n) * 100 + 50")} AS gross_total, {_first("-n * 100", "2")} AS total_income,
{_first("n * 100", "3, 4")} AS refund, {_first("2024", "5")} AS assessment_year, {_first("2023", "6")} AS financial_year {_FROM}""",
)
def income_fields_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.income_fields(_lines(spark, sf_dir))


@query(
    "payslip_fields_first_hit",
    f"""SELECT doc_id, {_first("CASE kind WHEN 7 THEN 'E' || n ELSE 'F' || n END", "7, 8")} AS employee, {_first("'28'", "9")} AS paid_days, {_first("n * 100", "10")} AS net_pay, {_first("'Rupees some'", "11")} AS in_words {_FROM}""",
)
def payslip_fields_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.payslip_fields(_lines(spark, sf_dir))


_SLIP = "CASE (l_partkey + l_suppkey) % 40 WHEN 0 THEN 'made by Quess' WHEN 1 THEN 'Zoho Payroll' WHEN 2 THEN 'Salary Slip' WHEN 3 THEN 'Payslip' WHEN 4 THEN 'pay slip' ELSE 'line' END"


@query(
    "payslip_vendor",
    f"""WITH n AS (SELECT l_orderkey AS doc_id, upper({_SLIP}) AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY {s.SEQ}) AS r FROM lineitem)
SELECT doc_id, CASE WHEN bool_or(t = 'ZOHO PAYROLL') THEN 'zoho-payroll' WHEN bool_or(t = 'MADE BY QUESS') THEN 'quess' WHEN bool_or(t = 'SALARY SLIP') THEN 'generic-salary-slip' WHEN bool_or(t IN ('PAY SLIP', 'PAYSLIP')) THEN 'generic-payslip' ELSE 'unknown' END AS vendor
FROM n WHERE r <= 15 GROUP BY doc_id""",
)
def payslip_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", f"{s.SEQ} AS line_no", f"{_SLIP} AS t")
    return fields.vendors(rows.select("doc_id", "line_no", F.array("t").alias("segs")))
