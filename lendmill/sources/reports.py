"""Positioned elements of bureau reports: what each report or card holds follows from its key.

An element is (text, x0, y0) in Spark SQL; one whose text is null is not there. Widths are 80 and heights 10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendmill.sources.tables import dealt, table

IDENTITY = (
    ("'Bureau'", 20, 900),
    ("CASE n % 4 WHEN 0 THEN 'Report Date: 05/06/2025' WHEN 1 THEN 'DATE' WHEN 2 THEN 'Date : none' END", 20, 10), ("CASE WHEN n % 4 = 1 THEN '07-08-2024' END", 140, 10),
    ("CASE n % 5 WHEN 0 THEN concat('CONTROL NUMBER : 12,34,56,78,', lpad(CAST(n % 1000 AS STRING), 3, '0')) WHEN 1 THEN 'CONTROL NUMBER' WHEN 2 THEN 'Ref 1234567890' WHEN 4 THEN 'Control Number' END", 20, 50),
    ("CASE WHEN n % 5 = 1 THEN concat('AB-', CAST(10000 + n % 90000 AS STRING)) END", 140, 50), ("CASE WHEN n % 5 = 4 THEN concat('9', lpad(CAST(n % 1000000 AS STRING), 6, '0')) END", 20, 62),
    ("CASE n % 3 WHEN 0 THEN 'DOB: 03/04/1970' WHEN 1 THEN 'DATE OF BIRTH' END", 20, 100), ("CASE WHEN n % 3 = 1 THEN '01/02/1980' END", 140, 100),
    ("CASE n % 7 WHEN 0 THEN 'CONSUMER NAME' WHEN 1 THEN concat('Consumer: Holder ', CAST(n AS STRING)) WHEN 2 THEN 'NAME' WHEN 3 THEN 'CONSUMER ACCOUNT' WHEN 4 THEN concat('Report CONSUMER: Split ', CAST(n AS STRING)) END", 20, 130),
    ("CASE n % 7 WHEN 0 THEN concat('Person ', CAST(n AS STRING)) WHEN 2 THEN 'AC 1234 5678 9012 x' END", 140, 130),
    ("CASE n % 11 WHEN 0 THEN 'PAN' WHEN 1 THEN 'PAN: AB12' END", 20, 170), ("CASE WHEN n % 11 = 0 THEN 'ab-cde1234f' END", 140, 170),
    ("CASE WHEN n % 2 = 0 THEN 'GENDER' END", 20, 210), ("CASE WHEN n % 2 = 0 THEN ':' END", 130, 210), ("CASE WHEN n % 2 = 0 THEN ': Male' END", 140, 210),
)
SCORES = (
    ("CASE n % 7 WHEN 0 THEN concat('CREDITVISION Score 7', lpad(CAST(n % 100 AS STRING), 2, '0')) WHEN 6 THEN 'SCORE 900 (low risk) and 850' END", 20, 10), ("CASE WHEN n % 7 = 1 THEN 'SCORE 300 (High Risk)' END", 20, 10),
    ("CASE WHEN n % 7 = 5 THEN 'CreditVision' END", 400, 400), ("CASE WHEN n % 7 IN (2, 5) THEN 'Score' WHEN n % 7 = 3 THEN '641' END", 20, 10), ("CASE WHEN n % 7 IN (1, 2) THEN '655' END", 300, 200),
    ("CASE WHEN n % 7 = 5 THEN '655' END", 300, 380), ("CASE WHEN n % 7 IN (1, 2, 5) THEN '812' END", 60, 40), ("CASE n % 7 WHEN 3 THEN '777' WHEN 4 THEN 'none' END", 20, 60), ("CASE WHEN n % 3 = 0 THEN 'Grameen -2' END", 20, 500),
    ("CASE n % 4 WHEN 0 THEN 'PL Score: -1' WHEN 1 THEN 'Personal Loan Score' WHEN 2 THEN 'personal loan score 42' END", 20, 600), ("CASE WHEN n % 4 = 1 THEN '-1' END", 140, 602), ("CASE WHEN n % 4 = 1 THEN '5' END", 200, 602),
)
ENQUIRIES = (
    ("'Enquiries'", 20, 20), ("'Member Name'", 49, 100), ("'Enquiry Date'", 220, 100), ("CASE WHEN n % 6 <> 0 THEN 'Enquiry Purpose' END", 390, 100), ("CASE WHEN n % 6 <> 0 THEN 'Enquiry Amount' END", 561, 100),
    ("concat('Bank ', CAST(n AS STRING))", 49, 120), ("'01/02/2024'", 225, 121), ("'Loan'", 380, 120), ("'Rs 1,000'", 570, 119), ("'continued'", 395, 140),
    ("CASE WHEN n % 3 = 0 THEN 'Odd' END", 49, 160), ("CASE WHEN n % 3 = 0 THEN 'bad' ELSE '03-04-2023' END", 220, 160), ("CASE WHEN n % 3 <> 0 THEN '-' END", 561, 160), ("concat('tail ', CAST(n AS STRING))", 390, 180),
    ("CASE WHEN n % 5 <> 0 THEN 'Glossary' END", 20, 190), ("'Late'", 49, 200), ("'09/09/2022'", 220, 200), ("'X'", 390, 200), ("'77'", 561, 200),
)
PLACES = (
    ("CASE WHEN n % 4 <> 0 THEN 'Address(es)' END", 20, 100), ("concat('Street ', CAST(n AS STRING))", 20, 120), ("'Home'", 200, 121), ("'01-02-2024'", 400, 119), ("'S2'", 20, 140), ("'Work'", 200, 140), ("'never'", 400, 140),
    ("'two'", 20, 160), ("'cells/'", 200, 160), ("'3/4/2020'", 500, 180), ("'Flat 1234 5678 9012'", 20, 180), ("'Old'", 200, 180), ("'extra'", 400, 180), ("'Employment Information'", 20, 300), ("'Type'", 20, 320),
    ("'Occupation Code'", 200, 320), ("'Income'", 400, 320), ("'Salaried'", 20, 340), ("concat('0', CAST(n % 9 AS STRING))", 200, 340), ("concat('Rs 5,', lpad(CAST(n % 1000 AS STRING), 3, '0'))", 400, 340), ("CASE WHEN n % 2 = 0 THEN 'Monthly' END", 500, 340),
)
CARD = (
    ("CASE WHEN n % 3 = 0 THEN concat(CAST(n % 50 AS STRING), '. Account') ELSE 'Member Name: X' END", 20, 0), ("CASE n % 4 WHEN 1 THEN 'Type: Card' WHEN 3 THEN NULL ELSE 'TYPE' END", 20, 30), ("CASE WHEN n % 4 = 0 THEN ': Gold Loan' END", 120, 30),
    ("CASE WHEN n % 4 = 2 THEN 'Car' END", 20, 42), ("CASE n % 3 WHEN 0 THEN 'Opened : 01-02-2020' WHEN 1 THEN 'DATE OPENED' END", 20, 60), ("CASE WHEN n % 3 = 1 THEN '03/04/2019' END", 120, 60), ("CASE WHEN n % 5 = 0 THEN 'Closed: 05-06-2021' END", 20, 90),
    ("CASE WHEN n % 2 = 0 THEN 'OWNERSHIP: Single' END", 20, 120), ("CASE n % 4 WHEN 0 THEN 'SANCTIONED' WHEN 1 THEN 'SANCTIONED : 7,500' WHEN 3 THEN 'HIGH CREDIT : 9100' END", 260, 30), ("CASE WHEN n % 4 = 0 THEN 'n/a' END", 350, 30),
    ("CASE WHEN n % 4 = 0 THEN 'Credit Limit' END", 260, 70), ("CASE WHEN n % 4 = 0 THEN '5,000' END", 350, 70), ("CASE n % 3 WHEN 0 THEN 'CURRENT BALANCE' WHEN 1 THEN 'Current' END", 260, 110), ("CASE WHEN n % 3 = 1 THEN 'Balance' END", 260, 121),
    ("CASE n % 3 WHEN 0 THEN '1,234' WHEN 1 THEN '88' END", 350, 115), ("CASE WHEN n % 9 = 0 THEN 'Overdue : 450' END", 260, 150), ("CASE WHEN n % 4 = 1 THEN 'Last Payment : 07/08/2022' END", 20, 150),
    ("CASE WHEN n % 6 = 0 THEN 'PMT HIST START: 01-01-2020' END", 20, 180), ("CASE WHEN n % 6 = 0 THEN 'PMT HIST END : 01-12-2021' END", 20, 210), ("CASE WHEN n % 8 = 0 THEN 'COLLATERAL TYPE' END", 410, 180), ("CASE WHEN n % 8 = 0 THEN 'Car' END", 495, 180),
    ("CASE n % 7 WHEN 0 THEN 'WRITTEN OFF (TOTAL)' WHEN 1 THEN 'CREDIT FACILITY STATUS' END", 560, 30), ("CASE n % 7 WHEN 0 THEN ': Rs. 80,404' WHEN 1 THEN ': Settled' END", 645, 30), ("CASE WHEN n % 7 = 0 THEN 'WRITTEN OFF' END", 560, 60),
    ("CASE WHEN n % 7 = 0 THEN '(PRINCIPLE)' END", 560, 71), ("CASE WHEN n % 7 = 0 THEN ': Rs. 70,101' END", 645, 58),
)


def _placed(rows: DataFrame, elements: tuple[tuple[str, int, int], ...], base: str, *columns: str) -> DataFrame:
    """Columns of the rows and their elements.

    Elements are columns of their own before they become rows: an array of all of them made at once is one method of
    generated code that is too long for the JVM to compile, and eight times as slow.
    """
    shown = (f"struct({base} * 100 + {i} AS seq, CAST({x} AS DOUBLE) AS x0, CAST({base} * 1000 + {y} AS DOUBLE) AS y0, CAST({x + 80} AS DOUBLE) AS x1, CAST({base} * 1000 + {y + 10} AS DOUBLE) AS y1, {t} AS text) AS e{i}" for i, (t, x, y) in enumerate(elements))
    return rows.selectExpr(*columns, *shown).selectExpr(*(c.split(" AS ")[-1] for c in columns), f"inline(array({', '.join(f'e{i}' for i in range(len(elements)))}))")


def report_elements(spark: SparkSession, sf_dir: str, elements: tuple[tuple[str, int, int], ...]) -> DataFrame:
    """A report for each customer."""
    return _placed(table(spark, sf_dir, "customer").selectExpr("c_custkey AS n"), elements, "CAST(0 AS BIGINT)", "n AS doc_id")


def card_elements(spark: SparkSession, sf_dir: str, elements: tuple[tuple[str, int, int], ...] = CARD) -> DataFrame:
    """A card for each order, those of a customer below each other; orders are dealt by customer before they become elements."""
    rows = dealt(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", each=1 << 15).selectExpr("o_custkey AS doc_id", "o_orderkey AS n")
    return _placed(rows, elements, "n", "doc_id", "CAST(n % 3 + 1 AS INT) AS page", "n").filter("text is not null")
