"""Tables of a folder, and applicants and bureau records derived from them by key arithmetic.

The expressions are written in the SQL that Spark and DuckDB share, so both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; one in fewer pieces than there are cores is dealt out, as work on texts costs more than moving them."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Rows of a narrow table in a dealt piece, about, and pieces for each that is read (which bounds the bytes of long rows).
PIECE_ROWS, PIECES_A_READ = 1 << 18, 4


def pieces(rows: DataFrame, each: int = PIECE_ROWS, a_read: int = PIECES_A_READ) -> int:
    """Into how many pieces the rows of a plain read are dealt: so many that a piece stays as large however many rows there are."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each), a_read * rows.rdd.getNumPartitions())


def dealt(rows: DataFrame, *keys: str, each: int = PIECE_ROWS) -> DataFrame:
    """Rows of a plain read dealt by keys, before they grow: windows and aggregates by the keys need no other shuffle.

    The number of pieces is stated, as Spark joins pieces by the bytes that it has shuffled, which say little of rows that
    are exploded or widened afterwards.
    """
    return rows.repartition(pieces(rows, each), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``, else one beside its warehouse.

    A warehouse in a local folder is shared only where all run on one machine; elsewhere the setting has to be there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    beside = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if beside.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set, and the warehouse is a folder of one machine")
    return f"{beside}/lendmill-checkpoints"


#: name -> expression over ``customer``; nulls stand for absent fields.
APPLICANT = {
    "app_id": "c_custkey",
    "age": "CASE WHEN c_custkey % 41 <> 0 THEN 18 + (c_custkey * 7) % 60 END",
    "entity_type": "CASE c_custkey % 10 WHEN 0 THEN 'Company' WHEN 1 THEN 'HUF' WHEN 2 THEN NULL ELSE 'Individual' END",
    "business_entity_type": "CASE c_custkey % 13 WHEN 0 THEN 'Agriculture' WHEN 5 THEN 'HUF' END",
    "occupation": "CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Self-Employed' ELSE 'Salaried' END",
    "cibil_score": "CASE WHEN c_custkey % 53 <> 0 THEN 600 + (c_custkey * 37) % 301 END",
    "currently_overdue": "c_custkey % 19 = 0",
    "write_off_amount": "CASE WHEN c_custkey % 11 = 0 THEN CAST((c_custkey * 97) % 12000 AS DOUBLE) END",
    "write_off_type": "CASE c_custkey % 5 WHEN 0 THEN ' cc ' WHEN 1 THEN 'PL' WHEN 2 THEN 'OTHER' END",
    "cc_write_off": "c_custkey % 2 = 0",
    "pl_write_off": "c_custkey % 3 = 0",
    "is_nri": "c_custkey % 7 = 0",
    "nri_years": "CASE WHEN c_custkey % 2 = 0 THEN CAST((c_custkey * 5) % 8 AS DOUBLE) / 2 END",
    "nri_days": "CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 13) % 1500 END",
    "net_monthly_salary": "CASE WHEN c_custkey % 31 <> 0 THEN CAST(20000 + (c_custkey * 911) % 40000 AS DOUBLE) END",
    "salary_payment_mode": "CASE c_custkey % 23 WHEN 0 THEN 'CASH' WHEN 1 THEN 'Salary payment mode-Cash' WHEN 2 THEN 'BANK_TRANSFER' END",
    "prev_company_joining": "CASE WHEN c_custkey % 4 <> 0 THEN CAST(DATE '2010-01-01' + CAST((c_custkey * 37) % 5200 AS INT) AS DATE) END",
    "minimum_work_experience_years": "CASE WHEN c_custkey % 8 = 0 THEN CAST(c_custkey % 6 AS DOUBLE) END",
    "current_company_tenure_months": "CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 12 WHEN 3 THEN 24 END",
    "no_income_proof_segment": "c_custkey % 27 = 0",
    "form_16_years": "CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 4 AS INT) END",
    "income_proof": "CASE c_custkey % 6 WHEN 0 THEN 'ITR' WHEN 1 THEN 'Form 16' END",
    "existing_car_loan_bank": "CASE c_custkey % 14 WHEN 0 THEN 'IOB' WHEN 1 THEN 'BOB' WHEN 2 THEN 'HDFC' WHEN 3 THEN '' END",
    "age_at_last_emi": "CASE WHEN c_custkey % 3 <> 1 THEN 25 + (c_custkey * 11) % 60 END",
    "current_itr": "CASE WHEN c_custkey % 37 <> 0 THEN CAST((c_custkey * 1009) % 600000 AS DOUBLE) END",
    "previous_itr": "CASE WHEN c_custkey % 43 <> 0 THEN CAST((c_custkey * 757) % 600000 AS DOUBLE) END",
    "itr_filed": "CASE c_custkey % 16 WHEN 0 THEN false WHEN 1 THEN true END",
    "business_proof": "CASE c_custkey % 25 WHEN 0 THEN false WHEN 1 THEN true END",
    "business_itr_years": "CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey % 5 AS INT) END",
    "business_experience_years": "CASE WHEN c_custkey % 4 = 2 THEN CAST(c_custkey % 7 AS INT) END",
    "property_status": "CASE c_custkey % 6 WHEN 0 THEN 'resi_cum_office_rented' WHEN 1 THEN 'SEPARATE_BOTH_RENTED' WHEN 2 THEN 'OWNED' END",
    "guarantor_provided": "c_custkey % 12 = 0",
    "has_loan_enquiry": "CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END",
    "loan_enquiry_count": "CASE WHEN c_custkey % 4 = 2 THEN CAST(c_custkey % 3 AS INT) END",
    "existing_account_bank": "CASE c_custkey % 9 WHEN 0 THEN 'IOB' WHEN 1 THEN 'HDFC' WHEN 2 THEN NULL ELSE 'None' END",
    "account_bank_known": "c_custkey % 9 < 6",
    "rental_income_class": "CASE c_custkey % 15 WHEN 0 THEN 'NO_ITR_NOT_IN_BANK' WHEN 1 THEN 'no_itr_in_bank' WHEN 2 THEN 'ITR_NOT_IN_BANK' END",
    "sibling_co_applicant": "c_custkey % 21 = 0",
    "selected_bank": "CASE c_custkey % 11 WHEN 0 THEN 'indian bank' WHEN 1 THEN 'IOB' WHEN 2 THEN 'BOB' WHEN 3 THEN 'BOM' WHEN 4 THEN 'HDFC' WHEN 5 THEN 'AXIS' WHEN 6 THEN 'KOTAK' WHEN 7 THEN 'Elsewhere' WHEN 8 THEN NULL ELSE 'BOI' END",
    "tenant_id": "CASE c_custkey % 3 WHEN 0 THEN 'tenant_alpha' WHEN 1 THEN 'tenant_beta' ELSE 'default' END",
}
#: Payment-status cell of a line item, as a bureau prints it.
CELL = (
    "CASE (o_orderkey * 31 + l_linenumber) % 197 WHEN 0 THEN '120' WHEN 1 THEN '89' WHEN 2 THEN '030' WHEN 3 THEN ' std ' WHEN 4 THEN '*' WHEN 5 THEN '45.9' WHEN 6 THEN NULL "
    "WHEN 7 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'SMA' ELSE '-' END WHEN 8 THEN 'XXX' WHEN 9 THEN '+7' WHEN 10 THEN '' ELSE 'STD' END"
)


def select_sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer, as a flat payload."""
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {n}" for n, e in APPLICANT.items()))


def bureau_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, token) of every payment cell of an applicant's accounts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr("o_custkey AS app_id", f"{CELL} AS token")


def bureau_cells_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, token) of every payment cell."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS account", f"{CELL.replace('o_orderkey', 'l_orderkey')} AS token")


def bureau_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, app_id) of every account."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS account", "o_custkey AS app_id")


APPLICANTS_SQL = select_sql(APPLICANT, "customer")
CELLS_SQL = f"SELECT o_custkey AS app_id, {CELL} AS token FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
