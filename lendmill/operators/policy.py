"""Lender policies over whole tables of applicants.

Policies are rows of a small table (8 lenders x 2 entity scopes), joined to applicants by entity scope with a broadcast
of a fixed size; a null threshold means that the rule does not exist for that scope. Rules are column expressions in
their order of evaluation: a rule whose gate is not true leaves no outcome at all, which is not the same as a pass.
Applicants with unreadable input are marked INVALID and get no outcomes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendmill.functions.coerce import dpd_strict

# Lenders in their order, each threshold's usual value, and where a lender differs.
BANKS = ("BOI", "INDIAN_BANK", "IOB", "BOB", "BOM", "HDFC", "AXIS", "KOTAK")
USUAL = {
    "min_cibil": 701, "allow_pl_write_off": False, "allow_hl_write_off": False, "allow_consumer_write_off": False, "allow_agri_write_off": False, "allow_msme_write_off": False,
    "allow_auto_write_off": False, "allow_cc_write_off": False, "max_cc_write_off_amount": 0.0, "max_dpd": 89, "min_age": 21, "max_age_emi_salaried": 70, "max_age_emi_self_employed": 70,
    "allow_nri": True, "min_nri_stay_years": 2.0, "min_salary": 25000.0, "min_current_company_tenure_years": 2.0, "min_total_experience_years": 2.0, "form16_years_required": 2,
    "se_min_current_itr": 100000.0, "se_min_prev_itr": 100000.0, "se_combined_itr_rule": False, "min_business_itr_years": 2, "allow_no_income_proof": False, "allow_huf": False,
    "allow_sibling_coapplicant": False, "allow_loan_enquiry": True, "allow_agriculture": False, "allow_rental_no_itr_not_in_bank": False, "allow_rental_no_itr_in_bank": False,
    "allow_rental_itr_not_in_bank": False, "allow_itr_not_filed": False, "allow_without_guarantor": False, "allow_with_guarantor": True, "allows_existing_account_holder": True,
    "allow_separate_both_rented": False,
}
PRIVATE = {"min_current_company_tenure_years": 0.5, "allow_no_income_proof": True, "allow_sibling_coapplicant": True, "allow_agriculture": True, "allow_separate_both_rented": True}
DIFFERS = {
    "BOI": {"allow_cc_write_off": True, "max_cc_write_off_amount": 5000.0, "max_dpd": 0, "max_age_emi_salaried": 60, "max_age_emi_self_employed": 65, "allow_nri": False, "min_nri_stay_years": 0.0, "se_min_current_itr": 300000.0, "min_business_itr_years": 3, "allow_sibling_coapplicant": True, "allow_rental_no_itr_in_bank": True, "allow_rental_itr_not_in_bank": True},
    "INDIAN_BANK": {"min_cibil": 730, "max_dpd": 0, "max_age_emi_salaried": 60, "se_min_current_itr": 300000.0, "se_min_prev_itr": 300000.0, "allow_rental_itr_not_in_bank": True},
    "IOB": {"allow_cc_write_off": True, "max_cc_write_off_amount": 5000.0, "max_age_emi_salaried": 75, "max_age_emi_self_employed": 75, "min_current_company_tenure_years": 1.0, "se_min_current_itr": 300000.0, "se_min_prev_itr": 300000.0, "allow_with_guarantor": False, "allows_existing_account_holder": False},
    "BOB": {"min_cibil": 726, "max_age_emi_salaried": 60, "form16_years_required": 1, "se_min_current_itr": 0.0, "se_min_prev_itr": 0.0, "se_combined_itr_rule": True, "allow_sibling_coapplicant": True, "allow_with_guarantor": False, "allow_separate_both_rented": True},
    "BOM": {"min_cibil": 650, "allow_cc_write_off": True, "max_cc_write_off_amount": 10000.0, "max_dpd": 0, "allow_agriculture": True, "allow_without_guarantor": True},
    "HDFC": PRIVATE, "AXIS": PRIVATE, "KOTAK": PRIVATE,
}
COMPANY_KEYS = (
    "min_cibil", "allow_pl_write_off", "allow_hl_write_off", "allow_consumer_write_off", "allow_agri_write_off", "allow_msme_write_off", "allow_auto_write_off", "allow_cc_write_off",
    "max_cc_write_off_amount", "max_dpd", "se_min_current_itr", "se_min_prev_itr", "se_combined_itr_rule", "min_business_itr_years", "allow_loan_enquiry", "allow_itr_not_filed", "allows_existing_account_holder",
)
COMPANY_ITR_NOT_FILED = ("HDFC", "AXIS", "KOTAK")
OWN_CAR_LOAN_REFUSED = ("IOB", "BOB")
COMBINED_ITR_FLOOR = 600_000.0
OVERLAYS = {"tenant_alpha": ("ALPHA-RSK-001", 720)}
WRITE_OFF_FLAGS = {
    "PL": "allow_pl_write_off", "HL": "allow_hl_write_off", "CONSUMER": "allow_consumer_write_off", "AGRI": "allow_agri_write_off", "MSME": "allow_msme_write_off", "AUTO": "allow_auto_write_off", "CC": "allow_cc_write_off",
}
RENTAL_FLAGS = {"NO_ITR_NOT_IN_BANK": "allow_rental_no_itr_not_in_bank", "NO_ITR_IN_BANK": "allow_rental_no_itr_in_bank", "ITR_NOT_IN_BANK": "allow_rental_itr_not_in_bank"}

Rule = tuple[str, Column, Column, Callable[[], tuple[Column, Column, Column]]]


def policy_rows() -> list[dict]:
    """A row for each lender and entity scope; a company's row lacks the thresholds that do not apply to it."""
    rows = []
    for order, bank in enumerate(BANKS):
        own = USUAL | DIFFERS[bank]
        company = {k: own[k] if k in COMPANY_KEYS else None for k in own} | {"allow_itr_not_filed": bank in COMPANY_ITR_NOT_FILED}
        for scope, values in (("INDIVIDUAL", own), ("COMPANY", company)):
            rows.append({"bank_code": bank, "entity_scope": scope, "bank_order": order} | values)
    return rows


def policy_table(spark: SparkSession) -> DataFrame:
    kinds = {bool: T.BooleanType(), int: T.IntegerType(), float: T.DoubleType()}
    fields = [T.StructField("bank_code", T.StringType()), T.StructField("entity_scope", T.StringType()), T.StructField("bank_order", T.IntegerType())]
    schema = T.StructType([*fields, *(T.StructField(k, kinds[type(v)]) for k, v in USUAL.items())])
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in policy_rows()], schema)


def worst_dpd(cells: DataFrame) -> DataFrame:
    """(app_id, max_dpd, bad_cells) of payment cells (app_id, token); null cells are no data, unreadable ones are bad."""
    days = dpd_strict(F.col("token"))
    known = F.col("token").isNotNull()
    return cells.groupBy("app_id").agg(F.coalesce(F.max(days), F.lit(0)).alias("max_dpd"), F.count(F.when(known & days.isNull(), 1)).alias("bad_cells"))


def worst_dpd_of_owners(cells: DataFrame, accounts: DataFrame) -> DataFrame:
    """As ``worst_dpd``, of cells (account, token) by the owners (account, app_id): cells are added up by account before the join,
    so what is joined and shuffled is a row an account."""
    own = worst_dpd(cells.withColumnRenamed("account", "app_id")).withColumnRenamed("app_id", "account")
    return own.join(accounts, "account").groupBy("app_id").agg(F.max("max_dpd").alias("max_dpd"), F.sum("bad_cells").alias("bad_cells"))


def entity_scope(entity_type: Column) -> Column:
    return F.when(F.upper(F.trim(entity_type)) == "COMPANY", "COMPANY").otherwise("INDIVIDUAL")


def work_experience(joined: Column, tenure_months: Column, supplied: Column, as_of: Column) -> Column:
    """Years before the present job plus years in it, where a former job is known; else the supplied years, else 99."""
    tenure = F.coalesce(tenure_months, F.lit(0)) / 12.0
    began = F.date_sub(as_of, F.floor(tenure * 365.25).cast("int"))
    computed = F.greatest(F.datediff(began, joined) / 365.25, F.lit(0.0)) + tenure
    return F.when(joined.isNotNull(), computed).otherwise(F.coalesce(supplied, F.lit(99.0)))


def normalized(apps: DataFrame, dpd: DataFrame, as_of: str) -> DataFrame:
    """Facts that rules read, one row for each applicant; absent fields take values that pass.

    ``errors`` lists what cannot be read.
    """
    c = F.col
    # Dealt by applicant in a number that adaptive execution does not lower, as the rules cost far more than the rows'
    # size tells; joins and aggregates by applicant from here on need no further shuffle.
    dealt = int(apps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = apps.repartition(dealt, "app_id").join(dpd, "app_id", "left")
    written = F.upper(F.trim(F.coalesce("write_off_type", F.lit(""))))
    resolved = F.when(written != "", written).when(c("cc_write_off"), "CC").when(c("pl_write_off"), "PL").otherwise("")
    bank = F.upper(F.translate(F.coalesce("selected_bank", F.lit("BOI")), " ", "_"))
    nri = F.coalesce("is_nri", F.lit(False))
    age = F.coalesce("age", F.lit(30))
    return joined.select(
        "app_id",
        F.when(F.coalesce("bad_cells", F.lit(0)) > 0, F.array(F.lit("dpd_history"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        entity_scope(c("entity_type")).alias("entity_scope"),
        age.alias("age"),
        F.coalesce("occupation", F.lit("Salaried")).alias("occupation"),
        F.coalesce("cibil_score", F.lit(750)).alias("cibil"),
        F.coalesce("max_dpd", F.lit(0)).alias("dpd"),
        nri.alias("is_nri"),
        F.when(nri, F.coalesce(c("nri_years"), c("nri_days") / 365.0, F.lit(0.0))).otherwise(0.0).alias("nri_stay_years"),
        F.coalesce("currently_overdue", F.lit(False)).alias("currently_overdue"),
        F.coalesce("write_off_amount", F.lit(0.0)).alias("write_off_amount"),
        resolved.alias("write_off_class"),
        F.coalesce("net_monthly_salary", F.lit(30000.0)).alias("salary"),
        F.coalesce("salary_payment_mode", F.lit("BANK_TRANSFER")).alias("salary_mode"),
        work_experience(c("prev_company_joining"), c("current_company_tenure_months"), c("minimum_work_experience_years"), F.lit(as_of).cast("date")).alias("work_exp_years"),
        (F.coalesce("current_company_tenure_months", F.lit(99999)) / 12.0).alias("current_company_years"),
        F.coalesce("no_income_proof_segment", F.lit(False)).alias("no_income_proof"),
        F.coalesce("form_16_years", F.lit(2)).alias("form_16_years"),
        F.coalesce("income_proof", F.lit("Form 16")).alias("income_proof"),
        F.when(c("existing_car_loan_bank") != "", c("existing_car_loan_bank")).alias("car_loan_bank"),
        F.coalesce(c("age_at_last_emi"), age).alias("age_emi"),
        F.coalesce("current_itr", F.lit(10_000_000.0)).alias("itr_now"),
        F.coalesce("previous_itr", F.lit(10_000_000.0)).alias("itr_before"),
        F.coalesce("itr_filed", F.lit(True)).alias("itr_filed"),
        F.coalesce("business_proof", F.lit(True)).alias("business_proof"),
        F.coalesce("business_itr_years", "business_experience_years", F.lit(99)).alias("business_itr_years"),
        F.upper(F.coalesce("property_status", F.lit("OWNED"))).alias("property_status"),
        F.coalesce("guarantor_provided", F.lit(False)).alias("guarantor"),
        F.coalesce(c("has_loan_enquiry"), F.coalesce("loan_enquiry_count", F.lit(0)) > 0).alias("has_loan_enquiry"),
        "existing_account_bank",
        F.coalesce("account_bank_known", F.lit(False)).alias("account_bank_known"),
        ((F.upper(F.coalesce("entity_type", F.lit(""))) == "HUF") | (F.upper(F.coalesce("business_entity_type", F.lit(""))) == "HUF")).alias("is_huf"),
        (F.upper(F.coalesce("business_entity_type", F.lit(""))) == "AGRICULTURE").alias("is_agriculture"),
        F.upper(F.coalesce("rental_income_class", F.lit("NONE"))).alias("rental_class"),
        F.coalesce("sibling_co_applicant", F.lit(False)).alias("sibling"),
        F.when(bank.isin(*BANKS), bank).otherwise("BOI").alias("selected_bank"),
        "tenant_id",
    )


def offers(facts: DataFrame, policies: DataFrame) -> DataFrame:
    """Every readable applicant beside every lender's policy for its scope."""
    return facts.filter(F.size("errors") == 0).drop("errors").join(F.broadcast(policies), "entity_scope")


def _plain(value: Column) -> Column:
    """A number as text: whole numbers without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(value.cast("string"))


def _word(flag: Column) -> Column:
    return F.initcap(flag.cast("string"))


def _rupees(value: Column, places: int) -> Column:
    return F.concat(F.lit("Rs "), F.format_number(value, places))


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """(rule_id, gate, passed, details) in order of evaluation; details makes name, value and limit where a report asks for them."""
    c, lit = F.col, F.lit
    at_least = lambda text: F.concat(lit(">= "), text)
    salaried = (c("occupation") == "Salaried") & c("min_salary").isNotNull()
    other = ~salaried
    amount = c("write_off_amount")
    flag = F.coalesce(*(F.when(c("write_off_class") == k, c(v)) for k, v in WRITE_OFF_FLAGS.items()))
    classified = c("write_off_class").isin(*WRITE_OFF_FLAGS)
    rental = F.coalesce(*(F.when(c("rental_class") == k, c(v)) for k, v in RENTAL_FLAGS.items()))
    cum = (c("property_status") == "RESI_CUM_OFFICE_RENTED") & c("allow_with_guarantor").isNotNull()
    nri = c("is_nri") & c("allow_nri").isNotNull()
    filed = other & c("itr_filed")
    both = c("itr_now") + c("itr_before")
    years = lambda x: F.concat(x, lit(" yrs"))
    two = lambda x: F.format_number(x, 2)
    return [
        ("DEM-101", c("min_age").isNotNull(), c("age") >= c("min_age"), lambda: (lit("Minimum Age"), _plain(c("age")), at_least(_plain(c("min_age"))))),
        ("DEM-104", nri, c("allow_nri"), lambda: (lit("NRI/PIO Accepted"), lit("NRI/PIO"), _word(c("allow_nri")))),
        ("DEM-105", nri & c("allow_nri"), c("nri_stay_years") >= c("min_nri_stay_years"), lambda: (lit("NRI Minimum Stay"), years(two(c("nri_stay_years"))), at_least(years(_plain(c("min_nri_stay_years")))))),
        ("BUR-404", lit(True), ~c("currently_overdue"), lambda: (lit("Currently Outstanding"), _word(c("currently_overdue")), lit("False"))),
        ("BUR-405", lit(True), c("cibil") >= c("min_cibil"), lambda: (lit("CIBIL Score"), _plain(c("cibil")), at_least(_plain(c("min_cibil"))))),
        ("BUR-406", lit(True), ~c("has_loan_enquiry") | c("allow_loan_enquiry"), lambda: (lit("Loan Enquiries"), F.when(c("has_loan_enquiry"), "Yes").otherwise("No"), F.when(c("allow_loan_enquiry"), "Any").otherwise("No"))),
        ("BUR-403", c("bank_code") == "INDIAN_BANK", c("dpd") <= 0, lambda: (lit("DPD History"), _plain(c("dpd")), lit("<= 0"))),
        ("BUR-402", c("bank_code") != "INDIAN_BANK", c("dpd") <= c("max_dpd"), lambda: (lit("DPD History"), _plain(c("dpd")), F.concat(lit("<= "), _plain(c("max_dpd"))))),
        ("BUR-401D", (amount > 0) & ~classified, lit(False), lambda: (lit("Unclassified Write-off"), _rupees(amount, 2), lit("classified type required"))),
        ("BUR-401", (amount > 0) & classified, flag, lambda: (F.concat("write_off_class", lit(" Write-off")), c("write_off_class"), _word(flag))),
        ("BUR-401B", (amount > 0) & (c("write_off_class") == "CC") & flag, amount < c("max_cc_write_off_amount"), lambda: (lit("Credit Card Write-off Amount"), _rupees(amount, 2), F.concat(lit("< "), _rupees(c("max_cc_write_off_amount"), 2)))),
        ("ENT-501", c("is_huf") & c("allow_huf").isNotNull(), c("allow_huf"), lambda: (lit("HUF Accepted"), lit("HUF"), _word(c("allow_huf")))),
        ("ENT-502", c("is_agriculture") & c("allow_agriculture").isNotNull(), c("allow_agriculture"), lambda: (lit("Agriculture Sector"), lit("Agriculture"), _word(c("allow_agriculture")))),
        ("INC-601", rental.isNotNull(), rental, lambda: (lit("Rental Income Configuration"), c("rental_class"), _word(rental))),
        ("EMP-SAL-202", salaried, c("salary") >= c("min_salary"), lambda: (lit("Minimum Salary"), _rupees(c("salary"), 2), at_least(_rupees(c("min_salary"), 0)))),
        ("EMP-SAL-203", salaried, ~c("salary_mode").isin("CASH", "Salary payment mode-Cash"), lambda: (lit("Salary Payment Mode"), c("salary_mode"), lit("Bank Credit"))),
        ("EMP-SAL-204", salaried, c("work_exp_years") >= c("min_total_experience_years"), lambda: (lit("Total Work Experience"), two(c("work_exp_years")), at_least(years(_plain(c("min_total_experience_years")))))),
        ("EMP-SAL-205", salaried, c("current_company_years") >= c("min_current_company_tenure_years"), lambda: (lit("Current Company Tenure"), years(two(c("current_company_years"))), at_least(years(_plain(c("min_current_company_tenure_years")))))),
        ("EMP-SAL-207", salaried & c("no_income_proof"), c("allow_no_income_proof"), lambda: (lit("No Income Proof Segment"), lit("No Income Proof"), _word(c("allow_no_income_proof")))),
        ("EMP-SAL-206", salaried & ~c("no_income_proof") & (c("income_proof") != "ITR"), c("form_16_years") >= c("form16_years_required"), lambda: (lit("Form-16 History"), years(_plain(c("form_16_years"))), at_least(years(_plain(c("form16_years_required")))))),
        ("DEM-102", salaried & c("max_age_emi_salaried").isNotNull(), c("age_emi") <= c("max_age_emi_salaried"), lambda: (lit("Age at Last EMI (Salaried)"), _plain(c("age_emi")), F.concat(lit("<= "), _plain(c("max_age_emi_salaried"))))),
        ("EMP-SE-301", other, c("business_itr_years") >= c("min_business_itr_years"), lambda: (lit("Business ITR Years"), years(_plain(c("business_itr_years"))), at_least(years(_plain(c("min_business_itr_years")))))),
        ("EMP-SE-304", other & ~c("itr_filed"), c("allow_itr_not_filed"), lambda: (lit("ITR Filed"), lit("Not Filed"), _word(c("allow_itr_not_filed")))),
        ("EMP-SE-303", filed & c("se_combined_itr_rule"), both >= COMBINED_ITR_FLOOR, lambda: (lit("Combined ITR"), _rupees(both, 0), at_least(_rupees(lit(COMBINED_ITR_FLOOR), 0)))),
        ("EMP-SE-302", filed & ~c("se_combined_itr_rule"), c("itr_now") >= c("se_min_current_itr"), lambda: (lit("Current-Year ITR"), _rupees(c("itr_now"), 0), at_least(_rupees(c("se_min_current_itr"), 0)))),
        ("EMP-SE-303", filed & ~c("se_combined_itr_rule"), c("itr_before") >= c("se_min_prev_itr"), lambda: (lit("Previous-Year ITR"), _rupees(c("itr_before"), 0), at_least(_rupees(c("se_min_prev_itr"), 0)))),
        ("BUS-302", other, c("business_proof"), lambda: (lit("Business Proof"), _word(c("business_proof")), lit("Mandatory"))),
        ("DEM-103", other & c("max_age_emi_self_employed").isNotNull(), c("age_emi") <= c("max_age_emi_self_employed"), lambda: (lit("Age at Last EMI (Self-Employed)"), _plain(c("age_emi")), F.concat(lit("<= "), _plain(c("max_age_emi_self_employed"))))),
        ("RES-206", cum & c("guarantor"), c("allow_with_guarantor"), lambda: (lit("Rented Premises With Guarantor"), lit("With a Guarantor"), _word(c("allow_with_guarantor")))),
        ("RES-205", cum & ~c("guarantor"), c("allow_without_guarantor"), lambda: (lit("Rented Premises Without Guarantor"), lit("Without a Guarantor"), _word(c("allow_without_guarantor")))),
        ("REL-502", (c("property_status") == "SEPARATE_BOTH_RENTED") & c("allow_separate_both_rented").isNotNull(), c("allow_separate_both_rented"), lambda: (lit("Separate Premises Both Rented"), lit("Residence + separate office both rented"), _word(c("allow_separate_both_rented")))),
        ("COA-801", c("sibling") & c("allow_sibling_coapplicant").isNotNull(), c("allow_sibling_coapplicant"), lambda: (lit("Sibling Co-Applicant"), lit("Brother/Sister"), _word(c("allow_sibling_coapplicant")))),
        ("REL-501", ~c("allows_existing_account_holder") & c("account_bank_known"), ~c("existing_account_bank").eqNullSafe(c("bank_code")), lambda: (lit("Existing Account Holder"), F.coalesce("existing_account_bank", lit("None")), F.concat(lit("not "), "bank_code"))),
        ("EXB-702", c("car_loan_bank").isNotNull() & c("bank_code").isin(*OWN_CAR_LOAN_REFUSED), c("car_loan_bank") != c("bank_code"), lambda: (lit("Existing Car Loan"), c("car_loan_bank"), F.concat(lit("not "), "bank_code"))),
    ]


@lru_cache(maxsize=1)
def overlay_rules() -> list[Rule]:
    """A tenant's own floor holds at every lender."""
    c = F.col
    return [(rule, c("tenant_id").eqNullSafe(tenant), c("cibil") >= floor, lambda floor=floor: (F.lit("Tenant CIBIL Floor"), _plain(c("cibil")), F.lit(f">= {floor}"))) for tenant, (rule, floor) in OVERLAYS.items()]


def verdicts(joined: DataFrame) -> DataFrame:
    """(app_id, bank_code, selected_bank, failures, evaluated) of every applicant and lender, without building messages."""
    every = [*rules(), *overlay_rules()]
    # A sum of flags stays in generated code; an array of them would be built for every applicant and lender.
    count = lambda flags: reduce(lambda a, b: a + b, (F.when(f, 1).otherwise(0) for f in flags))
    return joined.select("app_id", "bank_code", "selected_bank", count([g & ~p for _, g, p, _ in every]).alias("failures"), count([g for _, g, *_ in every]).alias("evaluated"))


def outcomes(joined: DataFrame, overlay: bool = True, report: bool = False) -> DataFrame:
    """(app_id, bank_code, rule_no, rule_id, passed[, parameter_name, user_value, limit_value]): a row for each rule that applied."""
    every = [*rules(), *(overlay_rules() if overlay else [])]
    parts = []
    for number, (rule, gate, passed, details) in enumerate(every):
        more = [x.alias(n) for x, n in zip(details(), ("parameter_name", "user_value", "limit_value"), strict=True)] if report else []
        parts.append(F.when(gate, F.struct(F.lit(number).alias("rule_no"), F.lit(rule).alias("rule_id"), passed.alias("passed"), *more)))
    return joined.select("app_id", "bank_code", F.explode(F.array(*parts)).alias("o")).filter("o is not null").select("app_id", "bank_code", "o.*")


def step_of_rule(rule_id: Column) -> Column:
    """Which step of the form a rule speaks of; the more special prefix comes first."""
    has = lambda *prefixes: reduce(lambda a, b: a | b, (rule_id.startswith(p) for p in prefixes))
    return F.when(has("DEM-", "ENT-50"), 1).when(has("RES-", "REL-502"), 2).when(has("EMP-", "INC-"), 3).when(has("BUR-", "EXB-", "REL-"), 4).when(has("COA-"), 5).otherwise(1)
