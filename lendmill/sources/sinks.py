"""Tables that a scoring run leaves behind: applications, rule rows and audit rows, and files with their failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendmill.functions import pii
from lendmill.operators import policy


def application_rows(facts: DataFrame, offers: DataFrame) -> DataFrame:
    """One stored row an applicant: facts, the selected lender's verdict and how many lenders would take it."""
    found = policy.verdicts(offers).groupBy("app_id").agg(
        F.count_if(F.col("failures") == 0).alias("lenders"), F.bool_and(F.when(F.col("bank_code") == F.col("selected_bank"), F.col("failures") == 0)).alias("ok")
    )
    status = F.when(F.size("errors") > 0, "INVALID").when(F.col("ok"), "APPROVED").otherwise("REJECTED")
    return facts.join(found, "app_id", "left").select("app_id", "tenant_id", "entity_scope", "selected_bank", F.coalesce("lenders", F.lit(0)).alias("lenders"), status.alias("status"))


def rule_rows(offers: DataFrame) -> DataFrame:
    """One stored row for each rule of the selected lender."""
    found = policy.outcomes(offers.filter("bank_code = selected_bank"), report=True)
    return found.select("app_id", "bank_code", "rule_id", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"), "parameter_name", "user_value", "limit_value")


def audit_rows(applications: DataFrame, details: DataFrame) -> DataFrame:
    """One stored row an application with its details as JSON, identifiers masked."""
    masked = details.select("app_id", *pii.mask_fields([c for c in details.columns if c != "app_id"]))
    body = F.to_json(F.struct(*(c for c in masked.columns if c != "app_id")))
    return applications.select("app_id", "tenant_id", F.concat(F.lit("EVALUATE_"), "status").alias("action")).join(masked.select("app_id", body.alias("details")), "app_id", "left")


def write_audit(applications: DataFrame, rules: DataFrame, audit: DataFrame, folder: str, run: str) -> None:
    """The three tables of a run, by tenant where there is one; a run that is repeated replaces its own files only."""
    applications.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{folder}/application/run={run}")
    rules.write.mode("overwrite").parquet(f"{folder}/rule_execution/run={run}")
    audit.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{folder}/audit_log/run={run}")


def batch_status(files: DataFrame, readable) -> tuple[DataFrame, DataFrame]:
    """Files that can be read, and a row for each that cannot; none is dropped."""
    return files.filter(readable), files.filter(~F.coalesce(readable, F.lit(False))).select("file_id", F.lit("FAILED").alias("status"))
