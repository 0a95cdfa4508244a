"""Queries of what a scoring run stores, and of views over sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators import income, policy
from lendmill.plans.policy import facts, offers, outcomes_sql
from lendmill.registry import query
from lendmill.sources import bureau as bs
from lendmill.sources import layout as ls
from lendmill.sources import sinks
from lendmill.sources.tables import table


@query(
    "sink_application_rows",
    f"""{outcomes_sql(True)}, banks AS (SELECT app_id, bank_code, bool_and(passed) AS ok FROM outcomes GROUP BY app_id, bank_code)
SELECT f.app_id, tenant_id, f.entity_scope, selected_bank, count(*) FILTER (WHERE ok) AS lenders, CASE WHEN bad > 0 THEN 'INVALID' WHEN bool_or(ok AND b.bank_code = selected_bank) THEN 'APPROVED' ELSE 'REJECTED' END AS status
FROM facts f LEFT JOIN banks b USING (app_id) GROUP BY f.app_id, tenant_id, f.entity_scope, selected_bank, bad""",
)
def sink_application_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = facts(spark, sf_dir)
    return sinks.application_rows(known, policy.offers(known, policy.policy_table(spark)))


@query("sink_rule_rows", f"{outcomes_sql(True)} SELECT app_id, bank_code, rule_id, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status FROM outcomes WHERE bank_code = selected_bank")
def sink_rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rule_rows(offers(spark, sf_dir)).select("app_id", "bank_code", "rule_id", "status")


@query("sink_audit_rows", """SELECT c_custkey AS app_id, 'EVALUATE_STORED' AS action, '{"pan":"AB******' || CAST(c_custkey % 10 AS VARCHAR) || 'F","segment":"' || c_mktsegment || '"}' AS details FROM customer""")
def sink_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    applications = customers.select(F.col("c_custkey").alias("app_id"), F.lit("t").alias("tenant_id"), F.lit("STORED").alias("status"))
    pan = F.concat(F.lit("ABCPK"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("F"))
    return sinks.audit_rows(applications, customers.select(F.col("c_custkey").alias("app_id"), pan.alias("pan"), F.col("c_mktsegment").alias("segment"))).select("app_id", "action", "details")


@query("report_summary_sheet", f"{outcomes_sql(True)} SELECT bank_code, count(DISTINCT app_id) AS applicants, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM outcomes GROUP BY bank_code")
def report_summary_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each lender: what a report's first sheet holds."""
    found = policy.verdicts(offers(spark, sf_dir))
    return found.groupBy("bank_code").agg(F.count("*").alias("applicants"), F.sum(F.col("evaluated") - F.col("failures")).alias("passed"), F.sum("failures").alias("failed"))


_LONG = " UNION ALL ".join(f"SELECT sheet_id, '{h}' AS head, {h} AS paise FROM sheets WHERE {h} IS NOT NULL" for h in income.HEADS)


@query("income_relational_view", f"{ls.WITH} {_LONG}")
def income_relational_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated heads as rows."""
    heads = F.array(*(F.struct(F.lit(h).alias("head"), F.col(h).cast("bigint").alias("paise")) for h in income.HEADS))
    return ls.sheets(spark, sf_dir).select("sheet_id", F.inline(F.filter(heads, lambda h: h["paise"].isNotNull())))


@query(
    "income_head_detail",
    f"""{ls.WITH}, h AS ({_LONG}) SELECT sheet_id, count(*) AS heads, max(paise) FILTER (WHERE head = 'salary') AS salary, sum(paise) FILTER (WHERE head <> 'salary')::BIGINT AS other, arg_max(head, (paise, head)) AS largest FROM h GROUP BY sheet_id""",
)
def income_head_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named fields picked from rows of heads."""
    rows = income_relational_view(spark, sf_dir)
    return rows.groupBy("sheet_id").agg(
        F.count("*").alias("heads"), F.max(F.when(F.col("head") == "salary", F.col("paise"))).alias("salary"), F.sum(F.when(F.col("head") != "salary", F.col("paise"))).alias("other"), F.max_by("head", F.struct("paise", "head")).alias("largest")
    )


@query(
    "bureau_schema_flags",
    f"""{bs.WITH} SELECT a.report_id, count(*) FILTER (WHERE trim(account_type) = '') AS no_type, count(*) FILTER (WHERE status NOT IN ('Active', 'Inactive', 'WrittenOff', 'SuitFiled', 'Repossessed')) AS odd_status, count(*) FILTER (WHERE balance < 0) AS negative,
any_value(score IS NULL OR score NOT BETWEEN 300 AND 900) AS bad_score FROM accounts a JOIN reports r USING (report_id) GROUP BY a.report_id""",
)
def bureau_schema_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What in a report breaks its schema."""
    accounts = bs.accounts(spark, sf_dir).groupBy("report_id").agg(
        F.count_if(F.trim("account_type") == "").alias("no_type"), F.count_if(~F.col("status").isin("Active", "Inactive", "WrittenOff", "SuitFiled", "Repossessed")).alias("odd_status"), F.count_if(F.col("balance") < 0).alias("negative")
    )
    return accounts.join(bs.reports(spark, sf_dir).select("report_id", (~F.coalesce(F.col("score").between(300, 900), F.lit(False))).alias("bad_score")), "report_id")


@query("bureau_outstanding_breakdown", f"{bs.WITH} SELECT report_id, account_no, coalesce(balance, 0) AS balance, row_number() OVER (PARTITION BY report_id ORDER BY account_no) AS place FROM accounts")
def bureau_outstanding_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's balance with its place in the report."""
    from pyspark.sql import Window

    order = Window.partitionBy("report_id").orderBy("account_no")
    return bs.accounts(spark, sf_dir).select("report_id", "account_no", F.coalesce("balance", F.lit(0)).alias("balance"), F.row_number().over(order).alias("place"))
