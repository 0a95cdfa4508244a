"""Bureau reports derived from the trade tables: a report a customer, an account an order, a payment cell a line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendmill.sources.tables import pieces, select_sql, table

_TYPES = ("Credit Card", "Used Car Loan", "Housing Loan", "Kisan Credit Card", "Tractor Loan", "Business Loan - Secured", "Consumer Loan", "Personal Loan", "AUTO LOAN (PERSONAL)", "Gold Loan", "  ", "Two-wheeler Loan")
_PRICE = "CAST(floor(o_totalprice) AS BIGINT)"
ACCOUNT = {
    "report_id": "o_custkey",
    "account_no": "o_orderkey",
    "account_type": "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END",
    "status": "CASE WHEN o_orderkey % 13 = 0 THEN 'WrittenOff' WHEN o_orderkey % 13 = 1 THEN 'SuitFiled' WHEN o_orderkey % 13 = 2 THEN 'Repossessed' WHEN o_orderstatus = 'F' THEN 'Inactive' WHEN o_orderstatus = 'O' THEN 'Active' ELSE 'Unknown' END",
    "facility": "CASE o_orderkey % 7 WHEN 0 THEN ' settled-partly ' WHEN 1 THEN 'Active' WHEN 2 THEN '' END",
    "card_text": "CASE o_orderkey % 8 WHEN 0 THEN 'Account inactive since' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'closed by member' WHEN 3 THEN 'Written-off, active' WHEN 4 THEN 'suit filed' WHEN 5 THEN 'Repossessed' ELSE 'none' END",
    "opened": "concat(CAST(year(o_orderdate) AS STRING), '-01-01')",
    "sanctioned": f"{_PRICE} % 4 * 1000",
    "balance": f"CASE WHEN o_orderkey % 4 <> 0 THEN {_PRICE} % 50000 END",
    "overdue": "CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 700 END",
    "written_off": f"CASE WHEN o_orderkey % 17 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE {_PRICE} END END",
    "written_off_principal": f"CASE WHEN o_orderkey % 17 < 2 THEN {_PRICE} % 9000 END",
}
_D = "concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '{s}', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '{s}', CAST(year(o_orderdate) AS STRING))"
ENQUIRY = {
    "report_id": "o_custkey",
    "enquiry_no": "o_orderkey",
    "date_text": f"CASE WHEN o_orderkey % 11 = 0 THEN 'not known' WHEN o_orderkey % 10 = 0 THEN concat('31/02/', CAST(year(o_orderdate) AS STRING)) WHEN o_orderkey % 2 = 0 THEN {_D.format(s='-')} ELSE {_D.format(s='/')} END",
    "amount": _PRICE,
}
ENQUIRIES = "orders WHERE o_orderkey % 3 = 0"
REPORT = {
    "report_id": "c_custkey",
    "report_date_text": "CASE WHEN c_custkey % 20 = 0 THEN 'n/a' ELSE concat(lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), '/', lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'), '/', CAST(1993 + c_custkey % 6 AS STRING)) END",
    "score": "CASE c_custkey % 18 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 560 + (c_custkey * 37) % 301 END",
    "pl_score": "CASE c_custkey % 6 WHEN 0 THEN '300' WHEN 1 THEN '901' WHEN 2 THEN ' 712 ' WHEN 3 THEN 'NOT AVAILABLE' WHEN 4 THEN '71.5' END",
}
_TOKENS = ("120", "089", "030", "sub", "SMA", " std", "45.9", "abc", "-5", "091", "*", "")
CELL = {
    "report_id": "o_custkey",
    "account_no": "o_orderkey",
    "year": "year(l_shipdate)",
    "month": "month(l_shipdate)",
    "token": "CASE (o_orderkey * 31 + l_linenumber * 7 + l_partkey) % 131 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TOKENS)) + " WHEN 20 THEN NULL WHEN 21 THEN '000' ELSE 'STD' END",
}


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in ACCOUNT.items()))


def enquiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").selectExpr(*(f"{e} AS {n}" for n, e in ENQUIRY.items()))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {n}" for n, e in REPORT.items()))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment cell for each line; both sides are dealt by account, which windows and aggregates by account share."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    many = pieces(lines)
    lines, orders = lines.repartition(many, "l_orderkey"), orders.repartition(many, "o_orderkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(*(f"{e} AS {n}" for n, e in CELL.items()))


WITH = f"""WITH accounts AS ({select_sql(ACCOUNT, "orders")}), enquiries AS ({select_sql(ENQUIRY, ENQUIRIES)}), reports AS ({select_sql(REPORT, "customer")}),
cells AS ({select_sql(CELL, "lineitem JOIN orders ON l_orderkey = o_orderkey")})"""
