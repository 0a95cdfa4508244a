"""Reconciliation of income sheets and payslips: amounts in paise, one row a sheet.

A check that holds is recorded with the severity ``skipped`` as well as one that cannot be made; there is no level for
a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendmill.functions import pii
from lendmill.operators.extract import block_boundary
from lendmill.operators.labels import component_slot

TOLERANCE, ROUNDING = 100, 1000
HEADS = ("salary", "house_property", "business", "capital_gains", "other_sources")


def finding(rule: str, severity: Column, expected: Column | None = None, actual: Column | None = None) -> Column:
    nothing = F.lit(None).cast("bigint")
    failed = severity != "skipped"
    return F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), F.when(failed, expected if expected is not None else nothing).alias("expected"), F.when(failed, actual if actual is not None else nothing).alias("actual"))


def stated_heads(row: str = "") -> tuple[Column, Column]:
    """Sum of the heads that a sheet states, and how many it states."""
    total = sum((F.coalesce(h, F.lit(0)) for h in HEADS), F.lit(0).cast("bigint"))
    count = sum((F.col(h).isNotNull().cast("int") for h in HEADS), F.lit(0))
    return total, count


def reconcile(sheets: DataFrame) -> DataFrame:
    """(sheet_id, rule, severity, expected, actual) of all checks on all sheets."""
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0))
    total, count = stated_heads()
    years_known = c("ay_start").isNotNull() & c("fy_start").isNotNull()
    years = F.when(years_known & (c("fy_source") == "stated") & (c("ay_start") != c("fy_start") + 1), "error").otherwise("skipped")
    gross_known = c("gross_total").isNotNull() & (count > 0)
    gross = F.when(gross_known & (F.abs(total - c("gross_total")) > TOLERANCE), "error").otherwise("skipped")
    expected = c("gross_total") - zero(c("deductions_total"))
    gap = F.abs(expected - c("total_income"))
    rounded = (gap < ROUNDING) & (c("total_income") % ROUNDING == 0)
    income = F.when(c("gross_total").isNotNull() & c("total_income").isNotNull() & (gap > TOLERANCE) & ~rounded, "error").otherwise("skipped")
    items_off = c("deductions_total").isNotNull() & c("gross_total").isNotNull() & c("total_income").isNotNull() & (zero(c("deduction_items")) > 0) & (F.abs(c("deduction_items") - c("deductions_total")) > TOLERANCE)
    due = c("tax_due") + zero(c("surcharge")) + zero(c("cess")) + zero(c("interest")) - zero(c("rebate")) - zero(c("relief")) - zero(c("credits"))
    net = F.when(c("tax_due").isNotNull() & c("net_tax").isNotNull() & (F.abs(due - c("net_tax")) > TOLERANCE), "warning").otherwise("skipped")
    found = F.array(
        finding("AY_FY_CONSISTENCY", years), finding("GTI_EQUALS_HEADS", gross, total, c("gross_total")), finding("TTI_EQUALS_GTI_MINUS_VIA", income, expected, c("total_income")),
        F.when(items_off, finding("VIA_ITEMS_SUM_TO_TOTAL", F.lit("warning"))), finding("NET_TAX_RECONCILES", net, due, c("net_tax")),
    )
    return sheets.select("sheet_id", F.inline(F.array_compact(found)))


def identifier_findings(sheets: DataFrame) -> DataFrame:
    """(sheet_id, rule, severity, message) of sheets (sheet_id, pan, aadhaar, serialized): the tax number's form, and whether
    a number of twelve digits is left anywhere in the document as it is written out."""
    c = F.col
    verdict, code = pii.pan_verdict(c("pan")), F.substring(F.upper(F.trim("pan")), 4, 1)
    severity = F.when(c("pan").isNull() | (verdict == "Valid"), "skipped").when(verdict == "BadShape", "error").otherwise("warning")
    formed = F.concat(F.lit("PAN well-formed, entity code '"), code, F.lit("'"))
    unknown = F.concat(F.lit("PAN 4th character '"), code, F.lit("' is not a known entity code"))
    said = F.when(c("pan").isNull(), "no PAN found").when(verdict == "Valid", formed).when(verdict == "BadShape", "PAN does not match AAAAA9999A").otherwise(unknown)
    left = pii.leaks(c("serialized"))
    clean = F.when(c("aadhaar") == "[Aadhaar Redacted]", "Aadhaar present and redacted").otherwise("no Aadhaar present")
    leaked = F.concat(left.cast("string"), F.lit(" Aadhaar-shaped value(s) survived redaction in the output"))
    found = F.array(
        F.struct(F.lit("PAN_STRUCTURE").alias("rule"), severity.alias("severity"), said.alias("message")),
        F.struct(F.lit("AADHAAR_REDACTED").alias("rule"), F.when(left > 0, "error").otherwise("skipped").alias("severity"), F.when(left > 0, leaked).otherwise(clean).alias("message")),
    )
    return sheets.select("sheet_id", F.inline(found))


def payslip_totals(lines: DataFrame) -> DataFrame:
    """Sums of a slip's lines by section (earning, deduction) and whether gross less deductions is the net pay (null: not stated)."""
    amount = lambda kind: F.sum(F.when(F.col("section") == kind, F.col("paise")))
    first = lambda kind: F.min_by(F.when(F.col("section") == kind, F.col("paise")), F.when(F.col("section") == kind, F.col("line_no")))
    out = lines.groupBy("slip_id").agg(
        F.coalesce(amount("earning"), F.lit(0)).alias("earnings"), F.coalesce(amount("deduction"), F.lit(0)).alias("deductions"), first("gross").alias("gross"), first("total_deductions").alias("total_deductions"), first("net").alias("net")
    )
    return out.withColumn("balances", F.col("gross") - F.col("total_deductions") == F.col("net"))


def sections(lines: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Each line with the section that the last marker line before it opened; marker lines themselves are left out.

    The order within a document is by line_no; documents are the partitions of the window.
    """
    marker = F.lit(None).cast("string")
    for word, name in markers.items():
        marker = F.coalesce(marker, F.when(F.contains(F.upper("label"), F.lit(word)), name))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = lines.withColumn("marker", marker).withColumn("section", F.last("marker", ignorenulls=True).over(order))
    return opened.filter(F.col("marker").isNull() & F.col("section").isNotNull()).drop("marker")


# Words that name a head of income, spaces aside, first match first.
HEAD_WORDS = {
    "salary": ("INCOMEFROMSALAR", "SALARYINCOME"), "house_property": ("HOUSEPROPERTY",), "business": ("BUSINESS", "PROFESSION"), "capital_gains": ("CAPITALGAIN",), "other_sources": ("OTHERSOURCE",),
}


def head_of(label: Column) -> Column:
    """The head of income that a label names, or null."""
    squashed = F.replace(F.upper(label), F.lit(" "), F.lit(""))
    out = F.lit(None).cast("string")
    for name, words in HEAD_WORDS.items():
        for word in words:
            out = F.coalesce(out, F.when(F.contains(squashed, F.lit(word)), name))
    return out


def head_totals(lines: DataFrame) -> DataFrame:
    """The first stated amount of each head, by line: the first hit wins."""
    named = lines.select("doc_id", "line_no", head_of(F.col("label")).alias("head"), "paise").filter("head is not null and paise is not null")
    return named.groupBy("doc_id").agg(*(F.min_by(F.when(F.col("head") == h, F.col("paise")), F.when(F.col("head") == h, F.col("line_no"))).alias(h) for h in HEADS))


def components(lines: DataFrame, most: int = 40) -> DataFrame:
    """Lines under a head of income until a boundary or another head, at most so many lines on; equal lines count once.

    A line without an amount counts where its words name a slot of the head.
    """
    head = head_of(F.col("label"))
    boundary = block_boundary(F.col("label"), F.col("paise").isNotNull())
    order = Window.partitionBy("doc_id").orderBy("line_no")
    event = F.when(head.isNotNull(), F.struct(head.alias("head"), F.col("place").alias("start"))).when(boundary, F.struct(F.lit(None).cast("string").alias("head"), F.col("place").alias("start")))
    placed = lines.withColumn("place", F.row_number().over(order)).withColumn("own", head.isNotNull() | boundary)
    under = placed.withColumn("open", F.last(event, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = under.filter(~F.col("own") & F.col("open.head").isNotNull() & (F.col("place") - F.col("open.start") <= most))
    kept = kept.filter(F.col("paise").isNotNull() | component_slot(F.col("open.head"), F.col("label")).isNotNull())
    return kept.groupBy("doc_id", F.col("open.head").alias("head"), "label").agg(F.min(F.struct("line_no", "paise")).alias("m")).select("doc_id", "head", "label", "m.line_no", "m.paise")
