"""Queries of fields out of positioned bureau reports; their SQL knows what each report holds by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators import bureau, reports
from lendmill.registry import query
from lendmill.sources import bureau as bs
from lendmill.sources import reports as s


def _reports(spark: SparkSession, sf_dir: str, elements: tuple) -> DataFrame:
    return reports.with_elements(s.report_elements(spark, sf_dir, elements), "doc_id")


@query(
    "bureau_metadata_identity",
    """WITH c AS (SELECT c_custkey AS n FROM customer),
d AS (SELECT n, CASE n % 4 WHEN 0 THEN '05/06/2025' WHEN 1 THEN '07-08-2024' WHEN 3 THEN CASE WHEN n % 3 = 1 THEN '01/02/1980' END END AS report_date,
CASE n % 5 WHEN 0 THEN '12345678' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN CAST(10000 + n % 90000 AS VARCHAR) WHEN 2 THEN '1234567890' WHEN 4 THEN '9' || lpad(CAST(n % 1000000 AS VARCHAR), 6, '0') END AS control FROM c)
SELECT n AS doc_id, coalesce(report_date, '01/01/2026') AS report_date, report_date IS NULL AS date_is_placeholder, coalesce(control, '00000000000') AS control_number, control IS NULL AS control_is_placeholder,
CASE n % 7 WHEN 0 THEN 'Person ' || n WHEN 1 THEN 'Holder ' || n WHEN 2 THEN 'AC [Aadhaar Redacted] x' WHEN 4 THEN 'Split ' || n ELSE 'UNKNOWN CONSUMER' END AS consumer_name, CASE WHEN n % 11 = 0 THEN 'ABCDE1234F' END AS pan,
CASE n % 3 WHEN 0 THEN '03/04/1970' WHEN 1 THEN '01/02/1980' ELSE CASE n % 4 WHEN 0 THEN '05/06/2025' WHEN 1 THEN '07-08-2024' WHEN 2 THEN 'none' END END AS date_of_birth, CASE WHEN n % 2 = 0 THEN 'Male' END AS gender FROM d""",
)
def bureau_metadata_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and identity of each report; a label that is missing takes the value of the one most like it."""
    return reports.metadata_and_identity(_reports(spark, sf_dir, s.IDENTITY))


@query(
    "bureau_scores",
    """SELECT n AS doc_id, CASE n % 7 WHEN 0 THEN 700 + n % 100 WHEN 1 THEN 300 WHEN 2 THEN 812 WHEN 3 THEN CASE WHEN n % 4 = 3 THEN 641 ELSE 777 END WHEN 4 THEN 0 WHEN 5 THEN 655 ELSE 900 END AS score,
CASE WHEN n % 3 = 0 THEN -2 END AS rural_score, CASE n % 4 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN 42 END AS pl_score FROM (SELECT c_custkey AS n FROM customer)""",
)
def bureau_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each report by their headers, positions and order."""
    return reports.scores(_reports(spark, sf_dir, s.SCORES))


@query(
    "layout_enquiry_table",
    """WITH c AS (SELECT c_custkey AS n FROM customer WHERE c_custkey % 6 <> 0)
SELECT n AS doc_id, 1 AS entry, 'Bank ' || n AS member, '01/02/2024' AS date_text, 'Loan continued' || CASE WHEN n % 3 = 0 THEN ' tail ' || n ELSE '' END AS purpose, 1000 AS amount FROM c
UNION ALL SELECT n, 2, 'NOT DISCLOSED', '03-04-2023', ' tail ' || n, 0 FROM c WHERE n % 3 <> 0 UNION ALL SELECT n, CASE WHEN n % 3 = 0 THEN 2 ELSE 3 END, 'Late', '09/09/2022', 'X', 77 FROM c WHERE n % 5 = 0""",
)
def layout_enquiry_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enquiries of each report's table, cells by the nearest column."""
    return reports.enquiries(_reports(spark, sf_dir, s.ENQUIRIES))


@query(
    "bureau_addresses",
    """WITH c AS (SELECT c_custkey AS n FROM customer WHERE c_custkey % 4 <> 0) SELECT n AS doc_id, 1 AS row_no, 'Street ' || n AS address, 'Home' AS category, '01-02-2024' AS date_reported FROM c
UNION ALL SELECT n, 4, 'Flat [Aadhaar Redacted]', 'Old', '3/4/2020' FROM c""",
)
def bureau_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.addresses(_reports(spark, sf_dir, s.PLACES))


@query(
    "bureau_employment",
    "SELECT c_custkey AS doc_id, 2 AS row_no, '0' || c_custkey % 9 AS occupation_code, 5000 + c_custkey % 1000 AS income, CASE WHEN c_custkey % 2 = 0 THEN 'Monthly' END AS income_indicator FROM customer",
)
def bureau_employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.employment(_reports(spark, sf_dir, s.PLACES))


@query(
    "bureau_card_fields",
    f"""WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
SELECT doc_id, CASE WHEN n % 3 = 0 THEN n % 50 ELSE place END AS card_no, CASE n % 4 WHEN 0 THEN 'Gold Loan' WHEN 1 THEN 'Card' WHEN 2 THEN 'Car' ELSE 'UNKNOWN TYPE' END AS account_type,
CASE WHEN n % 7 = 0 THEN 'WrittenOff' WHEN n % 5 = 0 THEN 'Inactive' ELSE 'Unknown' END AS status, CASE n % 3 WHEN 0 THEN '01-02-2020' WHEN 1 THEN '03/04/2019' END AS date_opened,
CASE WHEN n % 5 = 0 THEN '05-06-2021' WHEN n % 3 = 1 THEN '03/04/2019' END AS date_closed, CASE n % 4 WHEN 0 THEN 5000 WHEN 1 THEN 7500 WHEN 3 THEN 9100 END AS sanctioned, CASE n % 3 WHEN 0 THEN 1234 WHEN 1 THEN 88 END AS balance,
CASE WHEN n % 2 = 0 THEN 'Single' END AS ownership, CASE WHEN n % 8 = 0 THEN 'Car' END AS collateral_type, CAST(NULL AS BIGINT) AS collateral_value, CASE WHEN n % 7 = 1 THEN 'Settled' END AS facility,
CASE WHEN n % 7 = 0 THEN 80404 END AS written_off, CASE WHEN n % 7 = 0 THEN 70101 END AS written_off_principal, CAST(NULL AS BIGINT) AS settlement, CASE WHEN n % 9 = 0 THEN 450 END AS overdue,
CASE WHEN n % 4 = 1 THEN '07/08/2022' END AS last_payment, CASE WHEN n % 6 = 0 THEN '01-01-2020' END AS history_start, CASE WHEN n % 6 = 0 THEN '01-12-2021' END AS history_end, CAST(n % 3 + 1 AS VARCHAR) AS source_pages FROM c""",
)
def bureau_card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 fields of each account card; an amount without a digit does not hide a later one."""
    elements = s.card_elements(spark, sf_dir)
    starts = s.card_elements(spark, sf_dir, s.CARD[:1]).select("doc_id", F.col("n").alias("start_no"), "y0", "text")
    return reports.account_cards(elements.drop("n"), starts).drop("confidence").withColumn("source_pages", F.array_join(F.col("source_pages").cast("array<string>"), ","))


@query("bureau_profile_flags", "SELECT c_custkey AS report_id, false AS no_name, c_custkey % 11 = 5 AS bad_pan, c_custkey % 3 = 2 AND c_custkey % 4 = 2 AS bad_birth FROM customer")
def bureau_profile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema of the people that reports are about."""
    people = reports.metadata_and_identity(_reports(spark, sf_dir, s.IDENTITY))
    pan = F.when(F.col("doc_id") % 11 == 5, "ABCDE12345").otherwise(F.col("pan"))
    return bureau.profile_flags(people.select(F.col("doc_id").alias("report_id"), F.col("consumer_name").alias("name"), pan.alias("pan"), "date_of_birth"))


@query("bureau_enquiry_flags", f"{bs.WITH} SELECT report_id, count(*) FILTER (WHERE enquiry_no % 7 = 0) AS no_member, count(*) FILTER (WHERE enquiry_no % 11 = 0) AS bad_date, count(*) FILTER (WHERE amount > 300000) AS negative FROM enquiries GROUP BY report_id")
def bureau_enquiry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema of enquiries; a date has the shape of one, real or not."""
    found = bs.enquiries(spark, sf_dir)
    return bureau.enquiry_flags(found.select("report_id", F.when(F.col("enquiry_no") % 7 != 0, "m").alias("member"), "date_text", F.when(F.col("amount") > 300000, -1).otherwise(F.col("amount")).alias("amount")))
