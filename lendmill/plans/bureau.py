"""Queries of bureau reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.functions.coerce import dpd_lenient
from lendmill.operators import bureau as b
from lendmill.registry import query
from lendmill.sources import bureau as s
from lendmill.sources.tables import table

CLASS_SQL = """CASE WHEN contains(upper(account_type), 'CREDIT CARD') OR contains(upper(account_type), 'CHARGE CARD') OR contains(upper(account_type), 'KISAN CREDIT') AND contains(upper(account_type), 'CARD') THEN 'CC'
WHEN regexp_matches(upper(account_type), 'AUTO|CAR LOAN|USED CAR|TWO[- ]WHEELER') THEN 'AUTO' WHEN regexp_matches(upper(account_type), 'HOME LOAN|HOUSING|PROPERTY LOAN|MORTGAGE') THEN 'HOME'
WHEN regexp_matches(upper(account_type), 'AGRI|KISAN|TRACTOR|CROP') THEN 'AGRI' WHEN regexp_matches(upper(account_type), 'MSME|BUSINESS|COMMERCIAL') THEN 'MSME'
WHEN regexp_matches(upper(account_type), 'CONSUMER (LOAN|DURABLE)') THEN 'CONSUMER' WHEN contains(upper(account_type), 'PERSONAL') THEN 'PL' ELSE 'OTHER' END"""
_SUMS = ", ".join(f"sum(amount) FILTER (WHERE kind = '{c}' AND amount > 0)::BIGINT AS {c.lower()}" for c, _ in b.CLASSES)
WRITE_OFF_SQL = f"SELECT report_id, {_SUMS} FROM (SELECT report_id, {CLASS_SQL} AS kind, coalesce(written_off, written_off_principal, 0) AS amount FROM accounts) GROUP BY report_id"


def civil_sql(text: str) -> str:
    part = lambda i: f"TRY_CAST(split_part(replace({text}, '-', '/'), '/', {i}) AS INT)"
    return f"""CASE WHEN len(string_split(replace({text}, '-', '/'), '/')) = 3 AND {part(1)} BETWEEN 1 AND 31 AND {part(2)} BETWEEN 1 AND 12 AND {part(3)} IS NOT NULL
THEN make_date({part(3)}, {part(2)}, 1) + ({part(1)} - 1) END"""


DATED_SQL = f"dated AS (SELECT e.*, {civil_sql('date_text')} AS d FROM enquiries e), asked AS (SELECT report_id, {civil_sql('report_date_text')} AS today FROM reports)"
BANDS_SQL = """SELECT asked.report_id, count(enquiry_no) AS total, count(*) FILTER (WHERE today - d BETWEEN 0 AND 30) AS past_30_days,
count(*) FILTER (WHERE today - d BETWEEN 31 AND 365) AS past_12_months, count(*) FILTER (WHERE today - d BETWEEN 366 AND 730) AS past_24_months
FROM asked LEFT JOIN dated USING (report_id) GROUP BY asked.report_id"""
DAYS_SQL = """CASE WHEN upper(trim(token)) IN ('STD', 'XXX', 'SMA', '*', '-', '') THEN 0 WHEN token IS NULL THEN 0
WHEN regexp_matches(trim(token), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$') THEN greatest(0, CAST(trunc(CAST(trim(token) AS DOUBLE)) AS INT)) ELSE 0 END"""
REPORT_WINDOW_SQL = f"""SELECT report_id, coalesce(max(days) FILTER (WHERE year >= last - 1), 0) AS recent, max(days) AS lifetime FROM
(SELECT report_id, year, {DAYS_SQL} AS days, max(year) OVER (PARTITION BY report_id) AS last FROM cells) GROUP BY report_id"""
ACCOUNT_WINDOW_SQL = """SELECT report_id, coalesce(max(CASE WHEN regexp_matches(token, '^[0-9]+$') THEN CAST(token AS INT) END), 0) AS recent FROM
(SELECT report_id, token, dense_rank() OVER (PARTITION BY report_id, account_no ORDER BY year DESC) AS r FROM cells) WHERE r <= 2 GROUP BY report_id"""
SIGNALS_SQL = f"""{s.WITH}, {DATED_SQL}, bands AS ({BANDS_SQL}), written AS ({WRITE_OFF_SQL}), worst AS ({ACCOUNT_WINDOW_SQL}),
due AS (SELECT report_id, sum(overdue) AS due FROM accounts GROUP BY report_id),
known AS (SELECT r.report_id, coalesce(score, 0) AS score, {" + ".join(f"coalesce({c.lower()}, 0)" for c, _ in b.CLASSES)} AS lost, coalesce(due, 0) AS due, coalesce(recent, 0) AS recent, coalesce(past_30_days, 0) AS asked30
    FROM reports r LEFT JOIN bands USING (report_id) LEFT JOIN written USING (report_id) LEFT JOIN worst USING (report_id) LEFT JOIN due USING (report_id)),
fired AS (SELECT report_id, 'WO_PRESENT' AS code, 'DECLINE' AS decision FROM known WHERE lost > 0 UNION ALL SELECT report_id, 'DPD_SEVERE', 'DECLINE' FROM known WHERE recent > 90
    UNION ALL SELECT report_id, 'SCORE_LOW', 'DECLINE' FROM known WHERE score > 0 AND score < 650 UNION ALL SELECT report_id, 'OVERDUE_OPEN', 'REFER' FROM known WHERE due > 0
    UNION ALL SELECT report_id, 'DPD_MILD', 'REFER' FROM known WHERE recent >= 30 AND recent <= 90 UNION ALL SELECT report_id, 'SCORE_THIN', 'REFER' FROM known WHERE score = 0
    UNION ALL SELECT report_id, 'ENQUIRY_BURST', 'REFER' FROM known WHERE asked30 >= 4)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.signals(s.reports(spark, sf_dir), s.accounts(spark, sf_dir), s.cells(spark, sf_dir), s.enquiries(spark, sf_dir))


@query("bureau_writeoff_by_class", f"{s.WITH} {WRITE_OFF_SQL}")
def bureau_writeoff_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.write_offs(s.accounts(spark, sf_dir))


@query(
    "bureau_largest_writeoff",
    f"""{s.WITH} SELECT report_id, account_no, account_type, total, principal FROM (SELECT report_id, account_no, account_type, written_off AS total, written_off_principal AS principal,
row_number() OVER (PARTITION BY report_id ORDER BY coalesce(written_off, 0) DESC, account_no DESC) AS r FROM accounts WHERE written_off > 0 OR written_off_principal > 0) WHERE r = 1""",
)
def bureau_largest_writeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.largest_write_off(s.accounts(spark, sf_dir))


@query("bureau_enquiry_bands", f"{s.WITH}, {DATED_SQL} {BANDS_SQL}")
def bureau_enquiry_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.enquiry_bands(s.enquiries(spark, sf_dir), s.reports(spark, sf_dir))


@query("bureau_enquiry_list", f"{s.WITH}, {DATED_SQL} SELECT report_id, enquiry_no, date_text, amount, row_number() OVER (PARTITION BY report_id ORDER BY d DESC NULLS LAST, enquiry_no) AS place FROM dated")
def bureau_enquiry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.enquiry_list(s.enquiries(spark, sf_dir))


@query("bureau_outstanding", f"{s.WITH} SELECT report_id, coalesce(sum(balance), 0)::BIGINT AS total_balance, coalesce(sum(overdue), 0)::BIGINT AS total_overdue, count(*) AS accounts FROM accounts GROUP BY report_id")
def bureau_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.outstanding(s.accounts(spark, sf_dir))


@query("bureau_worst_dpd_report_window", f"{s.WITH} SELECT *, recent > 0 AS missed, recent > 90 AS severe FROM ({REPORT_WINDOW_SQL})")
def bureau_worst_dpd_report_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.worst_in_report_window(s.cells(spark, sf_dir))


@query("bureau_worst_dpd_account_window", f"{s.WITH} {ACCOUNT_WINDOW_SQL}")
def bureau_worst_dpd_account_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.worst_in_account_window(s.cells(spark, sf_dir))


@query(
    "bureau_payment_grid_long",
    f"""{s.WITH}, clean AS (SELECT report_id, account_no, year, month, CASE WHEN upper(trim(token)) IN ('STD', 'SUB', 'DBT', 'LSS', 'SMA', 'XXX', 'NA', '*') THEN upper(trim(token)) WHEN regexp_matches(trim(token), '^[0-9]+$') THEN trim(token) END AS token FROM cells)
SELECT report_id, account_no, year, month, min(token) AS low, max(token) AS high, count(*) AS cells FROM clean WHERE token IS NOT NULL GROUP BY ALL""",
)
def bureau_payment_grid_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = b.payment_grid(s.cells(spark, sf_dir))
    return grid.groupBy("report_id", "account_no", "year", "month").agg(F.min("token").alias("low"), F.max("token").alias("high"), F.count("*").alias("cells"))


@query("bureau_triage_rules_long", f"{SIGNALS_SQL} SELECT report_id, code, decision FROM fired")
def bureau_triage_rules_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.triage_rules(_signals(spark, sf_dir)).select("report_id", F.inline("fired"))


@query(
    "bureau_triage_decision",
    f"""{SIGNALS_SQL} SELECT known.report_id, CASE WHEN bool_or(decision = 'DECLINE') THEN 'DECLINE' WHEN bool_or(decision = 'REFER') THEN 'REFER' ELSE 'APPROVE' END AS decision, count(code)::INT AS fired
FROM known LEFT JOIN fired USING (report_id) GROUP BY known.report_id""",
)
def bureau_triage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.triage_decision(_signals(spark, sf_dir))


@query(
    "bureau_wizard_fields",
    f"""{s.WITH}, {DATED_SQL}, bands AS ({BANDS_SQL}), written AS ({WRITE_OFF_SQL}), worst AS ({REPORT_WINDOW_SQL}),
top AS (SELECT report_id, max(coalesce(written_off, 0)) AS most FROM accounts WHERE written_off > 0 OR written_off_principal > 0 GROUP BY report_id),
money AS (SELECT report_id, coalesce(sum(overdue), 0) AS due, coalesce(sum(balance), 0) AS held FROM accounts GROUP BY report_id)
SELECT r.report_id, coalesce(score, 0) AS score, CASE WHEN regexp_matches(trim(pl_score), '^[0-9]+$') AND TRY_CAST(trim(pl_score) AS INT) BETWEEN 300 AND 900 THEN TRY_CAST(trim(pl_score) AS INT) END AS pl_score,
coalesce(recent, 0) AS dpd, coalesce(lifetime, 0) AS worst_ever, coalesce(recent, 0) > 0 AS missed, coalesce(recent, 0) > 90 AS over90, coalesce(past_30_days, 0) > 0 AS enquired, coalesce(due, 0)::BIGINT AS outstanding, coalesce(held, 0)::BIGINT AS balance,
coalesce(cc, auto, home, agri, msme, consumer, pl) IS NOT NULL AS has_write_off, (CASE WHEN coalesce(cc, 0) > 0 THEN cc ELSE coalesce(most, 0) END)::BIGINT AS write_off_amount
FROM reports r LEFT JOIN bands USING (report_id) LEFT JOIN written USING (report_id) LEFT JOIN worst USING (report_id) LEFT JOIN top USING (report_id) LEFT JOIN money USING (report_id)""",
)
def bureau_wizard_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report fills into an application form."""
    reports, accounts = s.reports(spark, sf_dir), s.accounts(spark, sf_dir)
    joined = reports.withColumn("pl", F.trim("pl_score")).drop("pl_score")
    for part in (
        b.enquiry_bands(s.enquiries(spark, sf_dir), reports).select("report_id", "past_30_days"),
        b.write_offs(accounts).withColumnRenamed("pl", "personal"),
        b.worst_in_report_window(s.cells(spark, sf_dir)),
        b.largest_write_off(accounts).select("report_id", "total"),
        b.outstanding(accounts).select("report_id", "total_overdue", "total_balance"),
    ):
        joined = joined.join(part, "report_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    pl = F.when(F.col("pl").rlike(r"^\d+$"), F.col("pl").try_cast("int"))
    kinds = [c.lower() if c != "PL" else "personal" for c, _ in b.CLASSES]
    return joined.select(
        "report_id", zero("score").alias("score"), F.when(pl.between(300, 900), pl).alias("pl_score"), zero("recent").alias("dpd"), zero("lifetime").alias("worst_ever"), (zero("recent") > 0).alias("missed"),
        (zero("recent") > 90).alias("over90"), (zero("past_30_days") > 0).alias("enquired"), zero("total_overdue").alias("outstanding"), zero("total_balance").alias("balance"),
        F.coalesce(*kinds).isNotNull().alias("has_write_off"), F.when(zero("cc") > 0, F.col("cc")).otherwise(zero("total")).alias("write_off_amount"),
    )


@query(
    "bureau_account_summary",
    f"""{s.WITH}, numbered AS (SELECT *, row_number() OVER (PARTITION BY report_id, account_type, opened, sanctioned ORDER BY account_no) > 1 AS again FROM accounts)
SELECT report_id, count(*) AS total, count(*) FILTER (WHERE status = 'Active') AS active, count(*) FILTER (WHERE status = 'Inactive') AS closed, coalesce(sum(balance), 0)::BIGINT AS balance,
coalesce(sum(sanctioned), 0)::BIGINT AS sanctioned, count(*) FILTER (WHERE again) AS repeated FROM numbered GROUP BY report_id""",
)
def bureau_account_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.account_summary(s.accounts(spark, sf_dir))


@query("bureau_duplicate_accounts", f"{s.WITH} SELECT report_id, account_type, opened, sanctioned, count(*) - 1 AS repeats FROM accounts GROUP BY ALL HAVING count(*) > 1")
def bureau_duplicate_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = s.accounts(spark, sf_dir).groupBy("report_id", "account_type", "opened", "sanctioned").agg((F.count("*") - 1).alias("repeats"))
    return grouped.filter("repeats > 0")


@query(
    "account_labels",
    f"""{s.WITH} SELECT account_no, {CLASS_SQL} AS kind, CASE WHEN trim(regexp_replace(account_type, '[^A-Za-z0-9]', ' ', 'g')) = '' THEN 'Unknown'
ELSE array_to_string(list_transform(list_filter(string_split(regexp_replace(account_type, '[^A-Za-z0-9]', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), '_') END AS title,
CASE WHEN regexp_matches(upper(card_text), 'WRITTEN[- ]?OFF') THEN 'WrittenOff' WHEN regexp_matches(upper(card_text), 'SUIT[- ]?FILED') THEN 'SuitFiled' WHEN contains(upper(card_text), 'REPOSSESSED') THEN 'Repossessed'
     WHEN regexp_matches(upper(card_text), 'INACTIVE|CLOSED') THEN 'Inactive' WHEN contains(upper(card_text), 'ACTIVE') THEN 'Active' ELSE 'Unknown' END AS card_status,
CASE WHEN status = 'Inactive' THEN 'INACTIVE' WHEN trim(coalesce(facility, '')) <> '' AND upper(trim(facility)) <> 'ACTIVE' THEN 'ACTIVE - ' || replace(upper(trim(facility)), '-', ' ')
     WHEN status = 'WrittenOff' THEN 'ACTIVE - WRITTEN OFF' WHEN status = 'SuitFiled' THEN 'ACTIVE - SUIT FILED' WHEN status = 'Repossessed' THEN 'ACTIVE - REPOSSESSED' ELSE 'ACTIVE' END AS label FROM accounts""",
)
def account_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return s.accounts(spark, sf_dir).select(
        "account_no", b.write_off_class(c("account_type")).alias("kind"), b.title_key(c("account_type")).alias("title"), b.status_of_card(c("card_text")).alias("card_status"), b.status_label(c("status"), c("facility")).alias("label")
    )


@query("dpd_cell_tokens", f"{s.WITH} SELECT token, {DAYS_SQL} AS days, count(*) AS cells FROM cells GROUP BY ALL")
def dpd_cell_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every printed token with the days that the lenient reading gives it."""
    counted = s.cells(spark, sf_dir).groupBy("token").agg(F.count("*").alias("cells"))
    return counted.select("token", F.coalesce(dpd_lenient(F.col("token")), F.lit(0)).alias("days"), "cells")


@query(
    "report_summary_graph",
    f"""{s.WITH} SELECT r.report_id, count(a.account_no) AS accounts, count(a.account_no) FILTER (WHERE status = 'Active') AS active, count(a.account_no) - count(a.account_no) FILTER (WHERE status = 'Active') AS closed, min(a.account_no) AS first_account
FROM reports r LEFT JOIN accounts a USING (report_id) GROUP BY r.report_id""",
)
def report_summary_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports rebuilt from their children: all that is not active counts as closed."""
    joined = s.reports(spark, sf_dir).select("report_id").join(s.accounts(spark, sf_dir), "report_id", "left")
    active = F.count_if((F.col("status") == "Active") & F.col("account_no").isNotNull())
    return joined.groupBy("report_id").agg(F.count("account_no").alias("accounts"), active.alias("active"), (F.count("account_no") - active).alias("closed"), F.min("account_no").alias("first_account"))


@query("report_orphans", "SELECT l_orderkey AS account_no, count(*) AS cells FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def report_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment cells whose account is missing."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left_anti").groupBy(F.col("l_orderkey").alias("account_no")).agg(F.count("*").alias("cells"))
