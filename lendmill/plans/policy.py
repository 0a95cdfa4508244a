"""Queries of the lender policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators import policy as p
from lendmill.registry import query
from lendmill.sources.tables import APPLICANTS_SQL, CELLS_SQL, applicants, bureau_accounts, bureau_cells, bureau_cells_by_account, table

AS_OF = "2025-01-01"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = p.worst_dpd_of_owners(bureau_cells_by_account(spark, sf_dir), bureau_accounts(spark, sf_dir))
    return p.normalized(applicants(spark, sf_dir), worst, AS_OF)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.offers(facts(spark, sf_dir), p.policy_table(spark))


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return f"'{value}'" if isinstance(value, str) else f"{value!r}e0" if isinstance(value, float) else repr(value)


_NAMES = list(p.policy_rows()[0])
POLICY_SQL = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(_literal(r[n]) for n in _NAMES) + ')' for r in p.policy_rows())}) AS v({', '.join(_NAMES)})"
DPD_SQL = r"""SELECT app_id, coalesce(max(days), 0) AS max_dpd, count(*) FILTER (WHERE token IS NOT NULL AND days IS NULL) AS bad_cells FROM (
    SELECT app_id, token, CASE WHEN t IN ('STD', 'XXX', '*', '-', '') THEN 0 WHEN regexp_matches(t, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$') THEN CAST(trunc(CAST(t AS DOUBLE)) AS INT) END AS days
    FROM (SELECT app_id, token, upper(trim(token)) AS t FROM cells)) GROUP BY app_id"""
FACTS_SQL = f"""WITH apps AS ({APPLICANTS_SQL}), cells AS ({CELLS_SQL}), worst AS ({DPD_SQL}), policies AS ({POLICY_SQL}),
known AS (SELECT apps.*, coalesce(max_dpd, 0) AS dpd, coalesce(bad_cells, 0) AS bad, coalesce(current_company_tenure_months, 0) / 12.0 AS tenure FROM apps LEFT JOIN worst USING (app_id)),
facts AS (
    SELECT app_id, dpd, bad, tenant_id, existing_account_bank, account_bank_known,
           CASE WHEN upper(coalesce(entity_type, '')) = 'COMPANY' THEN 'COMPANY' ELSE 'INDIVIDUAL' END AS entity_scope,
           coalesce(age, 30) AS age, coalesce(occupation, 'Salaried') AS occupation, coalesce(cibil_score, 750) AS cibil, is_nri,
           CASE WHEN is_nri THEN coalesce(nri_years, nri_days / 365.0, 0) ELSE 0 END AS stay, currently_overdue, coalesce(write_off_amount, 0) AS amount,
           CASE WHEN trim(coalesce(write_off_type, '')) <> '' THEN upper(trim(write_off_type)) WHEN cc_write_off THEN 'CC' WHEN pl_write_off THEN 'PL' ELSE '' END AS kind,
           coalesce(net_monthly_salary, 30000) AS salary, coalesce(salary_payment_mode, 'BANK_TRANSFER') AS mode,
           CASE WHEN prev_company_joining IS NOT NULL
                THEN greatest(date_diff('day', prev_company_joining, DATE '{AS_OF}' - CAST(floor(tenure * 365.25) AS INT)) / 365.25, 0) + tenure
                ELSE coalesce(minimum_work_experience_years, 99) END AS experience,
           coalesce(current_company_tenure_months, 99999) / 12.0 AS here, no_income_proof_segment AS no_proof, coalesce(form_16_years, 2) AS form16, coalesce(income_proof, 'Form 16') AS proof,
           nullif(existing_car_loan_bank, '') AS car, coalesce(age_at_last_emi, age, 30) AS last_age, coalesce(current_itr, 10000000) AS itr1, coalesce(previous_itr, 10000000) AS itr0,
           coalesce(itr_filed, true) AS filed, coalesce(business_proof, true) AS business, coalesce(business_itr_years, business_experience_years, 99) AS itr_years,
           upper(coalesce(property_status, 'OWNED')) AS property, guarantor_provided AS guarantor, coalesce(has_loan_enquiry, coalesce(loan_enquiry_count, 0) > 0) AS enquiry,
           upper(coalesce(entity_type, '')) = 'HUF' OR upper(coalesce(business_entity_type, '')) = 'HUF' AS huf, upper(coalesce(business_entity_type, '')) = 'AGRICULTURE' AS agri,
           upper(coalesce(rental_income_class, 'NONE')) AS rental, sibling_co_applicant AS sibling,
           CASE WHEN replace(upper(coalesce(selected_bank, 'BOI')), ' ', '_') IN (SELECT bank_code FROM policies) THEN replace(upper(coalesce(selected_bank, 'BOI')), ' ', '_') ELSE 'BOI' END AS selected_bank
    FROM known),
x AS (SELECT * FROM facts JOIN policies USING (entity_scope) WHERE bad = 0),
flagged AS (SELECT *, CASE kind WHEN 'PL' THEN allow_pl_write_off WHEN 'HL' THEN allow_hl_write_off WHEN 'CONSUMER' THEN allow_consumer_write_off WHEN 'AGRI' THEN allow_agri_write_off
                       WHEN 'MSME' THEN allow_msme_write_off WHEN 'AUTO' THEN allow_auto_write_off WHEN 'CC' THEN allow_cc_write_off END AS kind_ok,
                   CASE rental WHEN 'NO_ITR_NOT_IN_BANK' THEN allow_rental_no_itr_not_in_bank WHEN 'NO_ITR_IN_BANK' THEN allow_rental_no_itr_in_bank WHEN 'ITR_NOT_IN_BANK' THEN allow_rental_itr_not_in_bank END AS rental_ok,
                   occupation = 'Salaried' AND min_salary IS NOT NULL AS sal FROM x)"""
#: rule, where it applies, when it passes.
_RULES_SQL = [
    ("DEM-101", "min_age IS NOT NULL", "age >= min_age"),
    ("DEM-104", "is_nri AND allow_nri IS NOT NULL", "allow_nri"),
    ("DEM-105", "is_nri AND allow_nri", "stay >= min_nri_stay_years"),
    ("BUR-404", "true", "NOT currently_overdue"),
    ("BUR-405", "true", "cibil >= min_cibil"),
    ("BUR-406", "true", "allow_loan_enquiry OR NOT enquiry"),
    ("BUR-403", "bank_code = 'INDIAN_BANK'", "dpd = 0"),
    ("BUR-402", "bank_code <> 'INDIAN_BANK'", "dpd <= max_dpd"),
    ("BUR-401D", "amount > 0 AND kind_ok IS NULL", "false"),
    ("BUR-401", "amount > 0 AND kind_ok IS NOT NULL", "kind_ok"),
    ("BUR-401B", "amount > 0 AND kind = 'CC' AND kind_ok", "amount < max_cc_write_off_amount"),
    ("ENT-501", "huf AND allow_huf IS NOT NULL", "allow_huf"),
    ("ENT-502", "agri AND allow_agriculture IS NOT NULL", "allow_agriculture"),
    ("INC-601", "rental_ok IS NOT NULL", "rental_ok"),
    ("EMP-SAL-202", "sal", "salary >= min_salary"),
    ("EMP-SAL-203", "sal", "mode NOT IN ('CASH', 'Salary payment mode-Cash')"),
    ("EMP-SAL-204", "sal", "experience >= min_total_experience_years"),
    ("EMP-SAL-205", "sal", "here >= min_current_company_tenure_years"),
    ("EMP-SAL-207", "sal AND no_proof", "allow_no_income_proof"),
    ("EMP-SAL-206", "sal AND NOT no_proof AND proof <> 'ITR'", "form16 >= form16_years_required"),
    ("DEM-102", "sal", "last_age <= max_age_emi_salaried"),
    ("EMP-SE-301", "NOT sal", "itr_years >= min_business_itr_years"),
    ("EMP-SE-304", "NOT sal AND NOT filed", "allow_itr_not_filed"),
    ("EMP-SE-303", "NOT sal AND filed AND se_combined_itr_rule", "itr1 + itr0 >= 600000"),
    ("EMP-SE-302", "NOT sal AND filed AND NOT se_combined_itr_rule", "itr1 >= se_min_current_itr"),
    ("EMP-SE-303", "NOT sal AND filed AND NOT se_combined_itr_rule", "itr0 >= se_min_prev_itr"),
    ("BUS-302", "NOT sal", "business"),
    ("DEM-103", "NOT sal AND max_age_emi_self_employed IS NOT NULL", "last_age <= max_age_emi_self_employed"),
    ("RES-206", "property = 'RESI_CUM_OFFICE_RENTED' AND allow_with_guarantor IS NOT NULL AND guarantor", "allow_with_guarantor"),
    ("RES-205", "property = 'RESI_CUM_OFFICE_RENTED' AND allow_with_guarantor IS NOT NULL AND NOT guarantor", "allow_without_guarantor"),
    ("REL-502", "property = 'SEPARATE_BOTH_RENTED' AND allow_separate_both_rented IS NOT NULL", "allow_separate_both_rented"),
    ("COA-801", "sibling AND allow_sibling_coapplicant IS NOT NULL", "allow_sibling_coapplicant"),
    ("REL-501", "NOT allows_existing_account_holder AND account_bank_known", "existing_account_bank IS DISTINCT FROM bank_code"),
    ("EXB-702", "car IS NOT NULL AND bank_code IN ('IOB', 'BOB')", "car <> bank_code"),
]
OVERLAY_RULE_SQL = ("ALPHA-RSK-001", "tenant_id = 'tenant_alpha'", "cibil >= 720")


def outcomes_sql(overlay: bool) -> str:
    every = [*_RULES_SQL, *([OVERLAY_RULE_SQL] if overlay else [])]
    rows = " UNION ALL ".join(f"SELECT app_id, bank_code, selected_bank, {i} AS rule_no, '{r}' AS rule_id, CAST({ok} AS BOOLEAN) AS passed FROM flagged WHERE {where}" for i, (r, where, ok) in enumerate(every))
    return f"{FACTS_SQL}, outcomes AS ({rows})"


@query("policy_min_slice", f"{FACTS_SQL} SELECT app_id, bank_code, cibil >= min_cibil AND (CASE WHEN bank_code = 'INDIAN_BANK' THEN dpd <= 0 ELSE dpd <= max_dpd END) AS eligible FROM x")
def policy_min_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and payment history alone."""
    limit = F.when(F.col("bank_code") == "INDIAN_BANK", F.lit(0)).otherwise(F.col("max_dpd"))
    return offers(spark, sf_dir).select("app_id", "bank_code", ((F.col("cibil") >= F.col("min_cibil")) & (F.col("dpd") <= limit)).alias("eligible"))


@query("policy_rule_outcomes", f"{outcomes_sql(False)} SELECT app_id, bank_code, rule_no, rule_id, passed FROM outcomes")
def policy_rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.outcomes(offers(spark, sf_dir), overlay=False)


_BANK_COLUMNS = ", ".join(f"bool_and(passed) FILTER (WHERE bank_code = '{b}') AS {b.lower()}" for b in p.BANKS)


@query("policy_bank_map", f"{outcomes_sql(True)} SELECT app_id, {_BANK_COLUMNS} FROM outcomes GROUP BY app_id")
def policy_bank_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lender would take each applicant."""
    found = p.verdicts(offers(spark, sf_dir))
    return found.groupBy("app_id").agg(*(F.bool_and(F.when(F.col("bank_code") == b, F.col("failures") == 0)).alias(b.lower()) for b in p.BANKS))


@query(
    "policy_selected_verdict",
    f"""{outcomes_sql(True)}, chosen AS (SELECT app_id, bool_and(passed) AS ok, count(*) FILTER (WHERE NOT passed) AS rejections, count(*) AS evaluated FROM outcomes WHERE bank_code = selected_bank GROUP BY app_id)
SELECT app_id, selected_bank, CASE WHEN bad > 0 THEN 'INVALID' WHEN ok THEN 'APPROVED' ELSE 'REJECTED' END AS status, coalesce(rejections, 0) AS rejections,
       CASE WHEN bad = 0 THEN rejections + 62 END AS executed_rules_count, coalesce(evaluated, 0) AS evaluated_rules FROM facts LEFT JOIN chosen USING (app_id)""",
)
def policy_selected_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the selected lender; unreadable applicants are INVALID."""
    known = facts(spark, sf_dir)
    own = p.verdicts(p.offers(known, p.policy_table(spark)).filter("bank_code = selected_bank")).select("app_id", "failures", "evaluated")
    bad = F.size("errors") > 0
    status = F.when(bad, "INVALID").when(F.col("failures") == 0, "APPROVED").otherwise("REJECTED")
    return known.join(own, "app_id", "left").select(
        "app_id", "selected_bank", status.alias("status"), F.coalesce("failures", F.lit(0)).cast("long").alias("rejections"), F.when(~bad, F.col("failures") + 62).cast("long").alias("executed_rules_count"),
        F.coalesce("evaluated", F.lit(0)).cast("long").alias("evaluated_rules"),
    )


@query("policy_rejection_counts", f"{outcomes_sql(True)} SELECT app_id, bank_code, count(*) FILTER (WHERE NOT passed) AS failed, count(*) FILTER (WHERE passed) AS succeeded FROM outcomes GROUP BY app_id, bank_code")
def policy_rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.verdicts(offers(spark, sf_dir))
    return found.select("app_id", "bank_code", F.col("failures").cast("long").alias("failed"), (F.col("evaluated") - F.col("failures")).cast("long").alias("succeeded"))


@query("policy_tenant_overlay", f"{FACTS_SQL} SELECT app_id, bank_code, 'ALPHA-RSK-001' AS rule_id, cibil >= 720 AS passed FROM flagged WHERE tenant_id = 'tenant_alpha'")
def policy_tenant_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule, gate, passed, *_ = p.overlay_rules()[0]
    return offers(spark, sf_dir).filter(gate).select("app_id", "bank_code", F.lit(rule).alias("rule_id"), passed.alias("passed"))


@query("policy_company_scope", f"{outcomes_sql(False)} SELECT bank_code, rule_id, count(*) AS outcomes, count(*) FILTER (WHERE passed) AS passed FROM outcomes WHERE app_id % 10 = 0 GROUP BY bank_code, rule_id")
def policy_company_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that exist for companies, with how often they pass."""
    found = p.outcomes(offers(spark, sf_dir).filter("entity_scope = 'COMPANY'"), overlay=False)
    return found.groupBy("bank_code", "rule_id").agg(F.count("*").alias("outcomes"), F.count_if("passed").alias("passed"))


@query("policy_failed_rule_rollup", f"{outcomes_sql(True)} SELECT bank_code, rule_id, count(*) FILTER (WHERE NOT passed) AS failed, count(*) FILTER (WHERE passed) AS succeeded FROM outcomes GROUP BY bank_code, rule_id")
def policy_failed_rule_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.outcomes(offers(spark, sf_dir))
    return found.groupBy("bank_code", "rule_id").agg(F.count_if(~F.col("passed")).alias("failed"), F.count_if("passed").alias("succeeded"))


_SEED = "min_cibil, max_dpd, min_salary, allow_nri, max_cc_write_off_amount, allow_itr_not_filed"


@query(
    "policy_seed_rows",
    f"""{FACTS_SQL} SELECT p.bank_code, p.entity_scope, {", ".join("any_value(p." + n + ") AS " + n for n in _SEED.split(", "))}, count(f.app_id) AS applicants,
    count(f.app_id) FILTER (WHERE f.selected_bank = p.bank_code) AS selected
FROM policies p LEFT JOIN facts f ON f.entity_scope = p.entity_scope GROUP BY p.bank_code, p.entity_scope""",
)
def policy_seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lender's row for each scope, with the applicants that it holds for and those that selected the lender."""
    held = facts(spark, sf_dir).groupBy("entity_scope", "selected_bank").agg(F.count("*").alias("n"))
    rows = p.policy_table(spark).select("bank_code", "entity_scope", *_SEED.split(", "))
    own = F.coalesce(F.sum(F.when(F.col("selected_bank") == F.col("bank_code"), F.col("n"))), F.lit(0))
    joined = rows.join(held, "entity_scope", "left").groupBy(*rows.columns)
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("applicants"), own.alias("selected"))


@query("rule_to_step", f"""{outcomes_sql(True)} SELECT rule_id, CASE WHEN rule_id LIKE 'DEM-%' OR rule_id LIKE 'ENT-50%' THEN 1 WHEN rule_id LIKE 'RES-%' OR rule_id LIKE 'REL-502%' THEN 2
WHEN rule_id LIKE 'EMP-%' OR rule_id LIKE 'INC-%' THEN 3 WHEN regexp_matches(rule_id, '^(BUR|EXB|REL)-') THEN 4 WHEN rule_id LIKE 'COA-%' THEN 5 ELSE 1 END AS step, count(*) AS failures FROM outcomes WHERE NOT passed GROUP BY rule_id""")
def rule_to_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = p.outcomes(offers(spark, sf_dir)).filter("not passed").groupBy("rule_id").agg(F.count("*").alias("failures"))
    return failed.select("rule_id", p.step_of_rule(F.col("rule_id")).alias("step"), "failures")


@query(
    "report_rows",
    f"""{outcomes_sql(True)} SELECT app_id, bank_code, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status, rule_id,
CASE rule_id WHEN 'BUR-405' THEN cibil::VARCHAR WHEN 'BUR-404' THEN CASE WHEN currently_overdue THEN 'True' ELSE 'False' END WHEN 'EMP-SAL-202' THEN 'Rs ' || format('{{:,.2f}}', salary) ELSE '' END AS user_value,
CASE rule_id WHEN 'BUR-405' THEN '>= ' || min_cibil WHEN 'BUR-404' THEN 'False' WHEN 'EMP-SAL-202' THEN '>= Rs ' || format('{{:,.0f}}', min_salary) ELSE '' END AS limit_value
FROM outcomes JOIN flagged USING (app_id, bank_code) WHERE bank_code = outcomes.selected_bank AND rule_id IN ('BUR-405', 'BUR-404', 'EMP-SAL-202')""",
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of the selected lender for three rules with what they looked at."""
    found = p.outcomes(offers(spark, sf_dir).filter("bank_code = selected_bank"), report=True).filter(F.col("rule_id").isin("BUR-405", "BUR-404", "EMP-SAL-202"))
    return found.select("app_id", "bank_code", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"), "rule_id", "user_value", "limit_value")


def _num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def _word(x: str) -> str:
    return f"CASE {x} WHEN true THEN 'True' WHEN false THEN 'False' END"


def _money(x: str, places: int) -> str:
    return f"'Rs ' || format('{{:,.{places}f}}', CAST({x} AS DOUBLE))"


def _two(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


#: rule number -> what a report calls it, what it looked at, its limit, as in the list of rules above.
_DETAILS_SQL = [
    ("'Minimum Age'", _num("age"), f"'>= ' || {_num('min_age')}"),
    ("'NRI/PIO Accepted'", "'NRI/PIO'", _word("allow_nri")),
    ("'NRI Minimum Stay'", f"{_two('stay')} || ' yrs'", f"'>= ' || {_num('min_nri_stay_years')} || ' yrs'"),
    ("'Currently Outstanding'", _word("currently_overdue"), "'False'"),
    ("'CIBIL Score'", _num("cibil"), f"'>= ' || {_num('min_cibil')}"),
    ("'Loan Enquiries'", "CASE WHEN enquiry THEN 'Yes' ELSE 'No' END", "CASE WHEN allow_loan_enquiry THEN 'Any' ELSE 'No' END"),
    ("'DPD History'", _num("dpd"), "'<= 0'"),
    ("'DPD History'", _num("dpd"), f"'<= ' || {_num('max_dpd')}"),
    ("'Unclassified Write-off'", _money("amount", 2), "'classified type required'"),
    ("kind || ' Write-off'", "kind", _word("kind_ok")),
    ("'Credit Card Write-off Amount'", _money("amount", 2), f"'< ' || {_money('max_cc_write_off_amount', 2)}"),
    ("'HUF Accepted'", "'HUF'", _word("allow_huf")),
    ("'Agriculture Sector'", "'Agriculture'", _word("allow_agriculture")),
    ("'Rental Income Configuration'", "rental", _word("rental_ok")),
    ("'Minimum Salary'", _money("salary", 2), f"'>= ' || {_money('min_salary', 0)}"),
    ("'Salary Payment Mode'", "mode", "'Bank Credit'"),
    ("'Total Work Experience'", _two("experience"), f"'>= ' || {_num('min_total_experience_years')} || ' yrs'"),
    ("'Current Company Tenure'", f"{_two('here')} || ' yrs'", f"'>= ' || {_num('min_current_company_tenure_years')} || ' yrs'"),
    ("'No Income Proof Segment'", "'No Income Proof'", _word("allow_no_income_proof")),
    ("'Form-16 History'", f"{_num('form16')} || ' yrs'", f"'>= ' || {_num('form16_years_required')} || ' yrs'"),
    ("'Age at Last EMI (Salaried)'", _num("last_age"), f"'<= ' || {_num('max_age_emi_salaried')}"),
    ("'Business ITR Years'", f"{_num('itr_years')} || ' yrs'", f"'>= ' || {_num('min_business_itr_years')} || ' yrs'"),
    ("'ITR Filed'", "'Not Filed'", _word("allow_itr_not_filed")),
    ("'Combined ITR'", _money("itr1 + itr0", 0), "'>= Rs 600,000'"),
    ("'Current-Year ITR'", _money("itr1", 0), f"'>= ' || {_money('se_min_current_itr', 0)}"),
    ("'Previous-Year ITR'", _money("itr0", 0), f"'>= ' || {_money('se_min_prev_itr', 0)}"),
    ("'Business Proof'", _word("business"), "'Mandatory'"),
    ("'Age at Last EMI (Self-Employed)'", _num("last_age"), f"'<= ' || {_num('max_age_emi_self_employed')}"),
    ("'Rented Premises With Guarantor'", "'With a Guarantor'", _word("allow_with_guarantor")),
    ("'Rented Premises Without Guarantor'", "'Without a Guarantor'", _word("allow_without_guarantor")),
    ("'Separate Premises Both Rented'", "'Residence + separate office both rented'", _word("allow_separate_both_rented")),
    ("'Sibling Co-Applicant'", "'Brother/Sister'", _word("allow_sibling_coapplicant")),
    ("'Existing Account Holder'", "coalesce(existing_account_bank, 'None')", "'not ' || bank_code"),
    ("'Existing Car Loan'", "car", "'not ' || bank_code"),
    ("'Tenant CIBIL Floor'", _num("cibil"), "'>= 720'"),
]


def _details(place: int) -> str:
    return "CASE rule_no " + " ".join(f"WHEN {i} THEN {d[place]}" for i, d in enumerate(_DETAILS_SQL)) + " END"


@query(
    "report_rows_all",
    f"""{outcomes_sql(True)} SELECT app_id, bank_code, rule_no, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status, rule_id,
       {_details(0)} AS parameter_name, {_details(1)} AS user_value, {_details(2)} AS limit_value
FROM outcomes JOIN flagged USING (app_id, bank_code) WHERE bank_code = outcomes.selected_bank""",
)
def report_rows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of the selected lender for every rule that applied, with what it is called, what it looked at and its limit."""
    found = p.outcomes(offers(spark, sf_dir).filter("bank_code = selected_bank"), report=True)
    return found.select("app_id", "bank_code", "rule_no", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"), "rule_id", "parameter_name", "user_value", "limit_value")


@query(
    "policy_column_coverage",
    f"""{outcomes_sql(True)}, ids AS (SELECT DISTINCT unnest({[r for r, *_ in [*_RULES_SQL, OVERLAY_RULE_SQL]]}) AS rule_id), seen AS (SELECT DISTINCT bank_code, rule_id FROM outcomes)
SELECT bank_code, (SELECT count(*) FROM seen s WHERE s.bank_code = b.bank_code)::INT AS seen,
       coalesce((SELECT string_agg(rule_id, ',' ORDER BY rule_id) FROM ids WHERE rule_id NOT IN (SELECT rule_id FROM seen s WHERE s.bank_code = b.bank_code)), '') AS unseen
FROM (SELECT DISTINCT bank_code FROM seen) b""",
)
def policy_column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each lender the rules that applied to some applicant, and those that never did: a difference of sets."""
    every = F.array(*(F.lit(r) for r in sorted({r for r, *_ in [*p.rules(), *p.overlay_rules()]})))
    seen = p.outcomes(offers(spark, sf_dir)).groupBy("bank_code").agg(F.collect_set("rule_id").alias("found"))
    return seen.select("bank_code", F.size("found").alias("seen"), F.array_join(F.array_sort(F.array_except(every, "found")), ",").alias("unseen"))


@query("dpd_history_coerce", f"WITH cells AS ({CELLS_SQL}) {DPD_SQL}")
def dpd_history_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.worst_dpd(bureau_cells(spark, sf_dir))


@query("sink_point_lookup", f"WITH apps AS ({APPLICANTS_SQL}) SELECT app_id, tenant_id, entity_type FROM apps WHERE app_id = 7")
def sink_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One applicant by id: the filter reaches the scan of the base table."""
    return applicants(spark, sf_dir).filter("app_id = 7").select("app_id", "tenant_id", "entity_type")


@query("sink_app_exec_join", f"{outcomes_sql(True)} SELECT facts.app_id, tenant_id, count(*) AS rows, count(*) FILTER (WHERE NOT passed) AS failed FROM facts JOIN outcomes USING (app_id) GROUP BY facts.app_id, tenant_id")
def sink_app_exec_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored applications beside their stored rule rows."""
    rows = p.outcomes(offers(spark, sf_dir)).groupBy("app_id").agg(F.count("*").alias("rows"), F.count_if(~F.col("passed")).alias("failed"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("app_id")).join(facts(spark, sf_dir).select("app_id", "tenant_id"), "app_id").join(rows, "app_id")
