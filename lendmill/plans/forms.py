"""Queries of application forms, of sources and of sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators import forms as f
from lendmill.operators import policy
from lendmill.registry import query
from lendmill.sources.tables import APPLICANT, APPLICANTS_SQL, applicants, select_sql, table

AS_OF = "2025-01-01"
FORM = {
    "form_id": "c_custkey",
    "identity": "CASE c_custkey % 5 WHEN 0 THEN 'NRI' WHEN 1 THEN 'HUF' WHEN 2 THEN 'Company' ELSE 'Individual' END",
    "residence": "CASE c_custkey % 2 WHEN 0 THEN 'Owned' ELSE 'Rented' END",
    "office": "CASE c_custkey % 3 WHEN 0 THEN 'Same' WHEN 1 THEN 'Separate' END",
    "premises": "CASE WHEN c_custkey % 3 = 1 THEN CASE c_custkey % 4 WHEN 0 THEN 'Owned' WHEN 1 THEN 'Rented' END END",
    "pl": "c_custkey % 11 = 0", "home": "c_custkey % 13 = 0", "consumer": "c_custkey % 17 = 0", "agri": "c_custkey % 19 = 0", "msme": "c_custkey % 23 = 0", "auto": "c_custkey % 7 = 0", "cc": "c_custkey % 3 = 0",
    "write_off_amount": "CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 5 * 1000 AS DOUBLE) END",
    "stay_months": "CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey * 5) % 48 END",
    "income_proof": "CASE c_custkey % 3 WHEN 0 THEN 'Form 16' WHEN 1 THEN 'ITR' ELSE 'No Income Proof' END",
    "has_form_16": "CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END",
    "occupation": "CASE WHEN c_custkey % 2 = 0 THEN 'Salaried' ELSE 'Self-Employed' END",
    "tenure": "CASE c_custkey % 5 WHEN 0 THEN 'Upto 6 months' WHEN 1 THEN '6 months to 1 year' WHEN 2 THEN '1 year to 2 years' WHEN 3 THEN '2 years and above' END",
    "previous_employer": "CASE WHEN c_custkey % 6 = 0 THEN 'Earlier Ltd' END",
    "has_pl_score": "c_custkey % 4 = 1",
    "pl_score": "CASE WHEN c_custkey % 8 = 1 THEN 700 END",
    "score": "CASE WHEN c_custkey % 9 <> 0 THEN 280 + (c_custkey * 37) % 640 END",
    "pan": "CASE WHEN c_custkey % 7 <> 0 THEN concat('ABCPK', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), CASE WHEN c_custkey % 5 = 0 THEN '1' ELSE 'Z' END) END",
    "pincode": "CASE WHEN c_custkey % 12 <> 0 THEN lpad(CAST((c_custkey * 7919) % 1000000 AS STRING), 6, '0') END",
    "account_bank": "CASE c_custkey % 10 WHEN 0 THEN 'Bank of Baroda' WHEN 1 THEN 'Indian Bank' WHEN 2 THEN 'Indian Overseas Bank' WHEN 3 THEN 'Bank of India' WHEN 4 THEN 'Bank of Maharashtra' WHEN 5 THEN 'HDFC Bank' WHEN 6 THEN 'Axis Bank' WHEN 7 THEN 'Kotak Mahindra Bank' WHEN 8 THEN 'Others' END",
    "age": "18 + (c_custkey * 7) % 60",
    "missed": "c_custkey % 3 = 0", "over_90": "c_custkey % 2 = 0",
}
FORMS_SQL = f"forms AS ({select_sql(FORM, 'customer')})"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {n}" for n, e in FORM.items()))


@query(
    "form_property_status",
    f"""WITH {FORMS_SQL} SELECT form_id, CASE WHEN residence = 'Owned' AND office = 'Same' THEN 'RESI_CUM_OFFICE_OWNED' WHEN residence = 'Rented' AND office = 'Same' THEN 'RESI_CUM_OFFICE_RENTED' WHEN residence = 'Owned' THEN 'OWNED'
WHEN premises = 'Rented' AND office = 'Separate' THEN 'SEPARATE_BOTH_RENTED' ELSE 'RENTED' END AS property_status FROM forms""",
)
def form_property_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.property_status(_forms(spark, sf_dir)).select("form_id", "property_status")


@query(
    "form_writeoff_precedence",
    f"""WITH {FORMS_SQL}, k AS (SELECT form_id, coalesce(write_off_amount, 0) AS given, CASE WHEN pl THEN 'PL' WHEN home THEN 'HL' WHEN consumer THEN 'CONSUMER' WHEN agri THEN 'AGRI' WHEN msme THEN 'MSME' WHEN auto THEN 'AUTO' WHEN cc THEN 'CC' END AS kind FROM forms)
SELECT form_id, kind, CASE WHEN given > 0 THEN given WHEN kind IS NOT NULL THEN 1 ELSE 0 END::DOUBLE AS amount FROM k""",
)
def form_writeoff_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, amount = f.write_off(F.col("write_off_amount"))
    return _forms(spark, sf_dir).select("form_id", kind.alias("kind"), amount.alias("amount"))


@query(
    "form_experience_years",
    f"""WITH apps AS ({APPLICANTS_SQL}), k AS (SELECT *, coalesce(current_company_tenure_months, 0) / 12.0 AS t FROM apps)
SELECT app_id, round(CASE WHEN prev_company_joining IS NULL THEN coalesce(minimum_work_experience_years, 99) ELSE greatest((DATE '{AS_OF}' - CAST(floor(t * 365.25) AS INT) - prev_company_joining) / 365.25, 0) + t END, 6)::DOUBLE AS years FROM k""",
)
def form_experience_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    years = policy.work_experience(c("prev_company_joining"), c("current_company_tenure_months"), c("minimum_work_experience_years"), F.lit(AS_OF).cast("date"))
    return applicants(spark, sf_dir).select("app_id", F.round(years, 6).alias("years"))


@query("dpd_two_answer_days", f"WITH {FORMS_SQL} SELECT form_id, CASE WHEN NOT missed THEN 0 WHEN over_90 THEN 90 ELSE 30 END AS days FROM forms")
def dpd_two_answer_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir).select("form_id", f.days_of_answers(F.col("missed"), F.col("over_90")).alias("days"))


@query(
    "applicant_derivations",
    f"""WITH {FORMS_SQL} SELECT form_id, CASE tenure WHEN 'Upto 6 months' THEN 0 WHEN '6 months to 1 year' THEN 6 WHEN '1 year to 2 years' THEN 12 WHEN '2 years and above' THEN 24 END AS tenure_months, stay_months / 12.0::DOUBLE AS stay_years,
CASE WHEN identity IN ('Company', 'HUF') THEN 35 ELSE age END AS age_used, CASE WHEN identity IN ('Company', 'HUF') THEN 35 ELSE age END + 7 AS last_age, age + 7 > 60 AS needs_co_applicant,
CASE account_bank WHEN 'Bank of Baroda' THEN 'BOB' WHEN 'Indian Bank' THEN 'INDIAN_BANK' WHEN 'Indian Overseas Bank' THEN 'IOB' WHEN 'Bank of India' THEN 'BOI' WHEN 'Bank of Maharashtra' THEN 'BOM' WHEN 'HDFC Bank' THEN 'HDFC' WHEN 'Axis Bank' THEN 'AXIS' WHEN 'Kotak Mahindra Bank' THEN 'KOTAK' END AS account_code,
coalesce(CASE account_bank WHEN 'Bank of Baroda' THEN 'BOB' WHEN 'Indian Bank' THEN 'INDIAN_BANK' WHEN 'Indian Overseas Bank' THEN 'IOB' WHEN 'Bank of Maharashtra' THEN 'BOM' WHEN 'HDFC Bank' THEN 'HDFC' WHEN 'Axis Bank' THEN 'AXIS' WHEN 'Kotak Mahindra Bank' THEN 'KOTAK' END, 'BOI') AS selected FROM forms""",
)
def applicant_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.when(F.col("identity").isin("Company", "HUF"), f.PROXY_AGE).otherwise(F.col("age"))
    bank = f.lookup(F.col("account_bank"), f.PARTNERS)
    return _forms(spark, sf_dir).select(
        "form_id", f.lookup(F.col("tenure"), f.TENURE).alias("tenure_months"), (F.col("stay_months") / 12.0).alias("stay_years"), age.alias("age_used"), (age + f.LOAN_YEARS).alias("last_age"),
        (F.col("age") + f.LOAN_YEARS > f.LAST_AGE).alias("needs_co_applicant"), bank.alias("account_code"), F.coalesce(bank, F.lit("BOI")).alias("selected"),
    )


_BAD = [
    ("stay_months required", "identity = 'NRI' AND stay_months IS NULL"),
    ("form_16 contradicts income_proof", "income_proof = 'Form 16' AND has_form_16 IS DISTINCT FROM true"),
    ("previous employer required", "occupation = 'Salaried' AND tenure IN ('Upto 6 months', '6 months to 1 year') AND previous_employer IS NULL"),
    ("premises required", "office = 'Separate' AND identity <> 'HUF' AND premises IS NULL"),
    ("pl_score required", "has_pl_score AND pl_score IS NULL"),
    ("write-off amount required", "cc AND coalesce(write_off_amount, 0) <= 0"),
    ("score out of range", "score IS NULL OR score < 300 OR score > 900"),
    ("pan malformed", "pan IS NULL OR NOT regexp_full_match(pan, '[A-Z]{5}[0-9]{4}[A-Z]')"),
    ("pincode malformed", "pincode IS NULL OR NOT regexp_full_match(pincode, '[1-9][0-9]{5}')"),
]
VIOLATIONS_SQL = " UNION ALL ".join(f"SELECT form_id, '{name}' AS violation FROM forms WHERE {bad}" for name, bad in _BAD)


@query("form_violations", f"WITH {FORMS_SQL} {VIOLATIONS_SQL}")
def form_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.violations(_forms(spark, sf_dir)).select("form_id", F.explode("violations").alias("violation"))


@query("src_form_json_violations", f"WITH {FORMS_SQL}, v AS ({VIOLATIONS_SQL}) SELECT forms.form_id, count(violation) AS violations FROM forms LEFT JOIN v USING (form_id) GROUP BY forms.form_id")
def src_form_json_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms as JSON text, read with their schema, and how many violations each has."""
    forms = _forms(spark, sf_dir)
    read = forms.select(F.to_json(F.struct("*")).alias("body")).select(F.from_json("body", forms.schema.simpleString()[7:-1].replace(":", " ")).alias("f")).select("f.*")
    return f.violations(read).select("form_id", F.size("violations").cast("long").alias("violations"))


@query("src_payload_json_defaults", f"WITH apps AS ({APPLICANTS_SQL}) SELECT app_id, coalesce(age, 30) AS age, coalesce(cibil_score, 750) AS cibil, coalesce(occupation, 'Salaried') AS occupation, coalesce(net_monthly_salary, 30000)::DOUBLE AS salary FROM apps")
def src_payload_json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as JSON text without their null fields; what is absent takes its default."""
    bodies = applicants(spark, sf_dir).select(F.to_json(F.struct("app_id", "age", "cibil_score", "occupation", "net_monthly_salary")).alias("body"))
    read = bodies.select(F.from_json("body", "app_id long, age long, cibil_score long, occupation string, net_monthly_salary double").alias("p")).select("p.*")
    default = lambda name, value: F.coalesce(name, F.lit(value))
    return read.select("app_id", default("age", 30).alias("age"), default("cibil_score", 750).alias("cibil"), default("occupation", "Salaried").alias("occupation"), default("net_monthly_salary", 30000.0).alias("salary"))


_HEAD = "CASE doc_id % 4 WHEN 0 THEN concat('%PDF-1.7 ', coalesce(text, '')) WHEN 1 THEN concat('{', chr(92), 'rtf1 ', coalesce(text, '')) ELSE coalesce(text, '') END"


@query("src_format_dispatch", f"SELECT doc_id, CASE WHEN starts_with(h, '%PDF') THEN 'pdf' WHEN starts_with(h, '{{' || chr(92) || 'rtf') THEN 'rtf' ELSE 'unknown' END AS format FROM (SELECT doc_id, {_HEAD} AS h FROM documents)")
def src_format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format by a file's first bytes, never by its name."""
    head = F.expr(_HEAD)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(head.startswith("%PDF"), "pdf").when(head.startswith("{\\rtf"), "rtf").otherwise("unknown").alias("format"))


_FILE = "concat('upload_', CASE WHEN doc_id % 3 = 0 THEN concat('ABCPK', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), 'F') ELSE 'scan' END, '_', CAST(doc_id AS STRING), '.pdf')"


@query("src_filename_identity", f"SELECT doc_id, nullif(regexp_extract(upper({_FILE}), '[A-Z]{{5}}[0-9]{{4}}[A-Z]'), '') AS pan, true AS simulated FROM documents")
def src_filename_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier out of a file's name, marked as such."""
    found = F.regexp_extract(F.upper(F.expr(_FILE)), r"[A-Z]{5}[0-9]{4}[A-Z]", 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(found != "", found).alias("pan"), F.lit(True).alias("simulated"))


@query("sink_batch_status", "SELECT CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'FAILED' ELSE 'OK' END AS status, count(*) AS files FROM documents GROUP BY 1")
def sink_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a batch by outcome; a failure is a row too."""
    failed = F.col("text").isNull() | (F.length(F.trim("text")) == 0)
    return table(spark, sf_dir, "documents").groupBy(F.when(failed, "FAILED").otherwise("OK").alias("status")).agg(F.count("*").alias("files"))


@query("src_payload_columns", f"SELECT {len(APPLICANT)} AS columns, count(*) AS rows FROM customer")
def src_payload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = applicants(spark, sf_dir)
    return apps.agg(F.lit(len(apps.columns)).alias("columns"), F.count("*").alias("rows"))


@query(
    "form_engine_payload",
    f"""WITH {FORMS_SQL}, k AS (SELECT *, CASE WHEN pl THEN 'PL' WHEN home THEN 'HL' WHEN consumer THEN 'CONSUMER' WHEN agri THEN 'AGRI' WHEN msme THEN 'MSME' WHEN auto THEN 'AUTO' WHEN cc THEN 'CC' END AS kind, CASE WHEN identity IN ('Company', 'HUF') THEN 35 ELSE age END AS years FROM forms)
SELECT form_id, CASE WHEN identity IN ('Company', 'HUF') THEN identity ELSE 'Individual' END AS entity_type, identity = 'NRI' AS is_nri, CASE WHEN identity = 'NRI' THEN stay_months / 12.0::DOUBLE END AS nri_years, years AS age, years + 7 AS age_at_last_emi, occupation,
CASE tenure WHEN 'Upto 6 months' THEN 0 WHEN '6 months to 1 year' THEN 6 WHEN '1 year to 2 years' THEN 12 WHEN '2 years and above' THEN 24 END AS current_company_tenure_months, score AS cibil_score, CASE WHEN NOT missed THEN 0 WHEN over_90 THEN 90 ELSE 30 END AS dpd, kind AS write_off_type,
CASE WHEN coalesce(write_off_amount, 0) > 0 THEN write_off_amount WHEN kind IS NOT NULL THEN 1 ELSE 0 END::DOUBLE AS write_off_amount,
coalesce(CASE account_bank WHEN 'Bank of Baroda' THEN 'BOB' WHEN 'Indian Bank' THEN 'INDIAN_BANK' WHEN 'Indian Overseas Bank' THEN 'IOB' WHEN 'Bank of Maharashtra' THEN 'BOM' WHEN 'HDFC Bank' THEN 'HDFC' WHEN 'Axis Bank' THEN 'AXIS' WHEN 'Kotak Mahindra Bank' THEN 'KOTAK' END, 'BOI') AS selected_bank,
CASE account_bank WHEN 'Bank of Baroda' THEN 'BOB' WHEN 'Indian Bank' THEN 'INDIAN_BANK' WHEN 'Indian Overseas Bank' THEN 'IOB' WHEN 'Bank of India' THEN 'BOI' WHEN 'Bank of Maharashtra' THEN 'BOM' WHEN 'HDFC Bank' THEN 'HDFC' WHEN 'Axis Bank' THEN 'AXIS' WHEN 'Kotak Mahindra Bank' THEN 'KOTAK' END AS existing_account_bank,
CASE WHEN residence = 'Owned' AND office = 'Same' THEN 'RESI_CUM_OFFICE_OWNED' WHEN residence = 'Rented' AND office = 'Same' THEN 'RESI_CUM_OFFICE_RENTED' WHEN residence = 'Owned' THEN 'OWNED' WHEN premises = 'Rented' AND office = 'Separate' THEN 'SEPARATE_BOTH_RENTED' ELSE 'RENTED' END AS property_status FROM k""",
)
def form_engine_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.engine_payload(_forms(spark, sf_dir))
