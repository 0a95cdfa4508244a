"""Labelled fields of documents: lines (doc_id, line_no, segs) with segs the text cells of a line, left to right.

Of all lines that hold a label the first with a value counts; on a line the options of a label are tried in their order.
Everything is an aggregate by document, so a field costs no shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmill.functions import money


def squashed(text: Column) -> Column:
    return F.replace(F.upper(text), F.lit(" "), F.lit(""))


def line_text(segs: Column) -> Column:
    return F.array_join(segs, " ")


def value_on_line(segs: Column, label: Column) -> Column:
    """What stands after a colon in the label's own cell, else the next cell that is not empty."""
    place = F.array_position(F.transform(segs, lambda c: F.contains(F.upper(c), label)), True).cast("int")
    own = F.get(segs, place - 1)
    after = F.trim(F.when(F.contains(own, F.lit(":")), F.substring_index(own, ":", -1)).otherwise(""))
    rest = F.filter(F.slice(segs, place + 1, F.size(segs)), lambda c: F.trim(c) != "")
    return F.when(place > 0, F.when(after != "", after).otherwise(F.trim(F.get(rest, F.lit(0)))))


# Fields of a sheet and of a pay slip, how each is read (a figure, a year, a value), and its labels.
INCOME_FIELDS = {
    "gross_total": ("figure", ("GROSS TOTAL INCOME",)), "total_income": ("figure", ("TOTAL INCOME",)), "refund": ("figure", ("REFUND DUE", "TAX REFUNDABLE")),
    "assessment_year": ("year", ("ASSESSMENT YEAR",)), "financial_year": ("year", ("FINANCIAL YEAR",)),
}
PAYSLIP_FIELDS = {"employee": ("value", ("EMPLOYEE NAME",)), "paid_days": ("value", ("PAID DAYS",)), "net_pay": ("figure", ("NET PAY", "TAKE HOME")), "in_words": ("value", ("IN WORDS",))}


def first_hits(lines: DataFrame, fields: dict[str, tuple[str, tuple[str, ...]]], unless: dict[str, str]) -> DataFrame:
    """One row for each document with the fields: each of the first line that holds one of its labels and has a value.

    The labels are one array; a line is repeated for those that it holds, so each way of reading is written once however
    many fields there are. Spaces do not matter for figures and years; ``unless`` names what a field's line must not hold.
    """
    c = F.col
    every = [(name, kind, no, word) for name, (kind, words) in fields.items() for no, word in enumerate(words)]
    options = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.lit(n).alias("no"), F.lit(w.replace(" ", "")).alias("key"), F.lit(w).alias("word"), F.lit(unless.get(f)).cast("string").alias("unless")) for f, k, n, w in every))
    rows = lines.select("doc_id", "line_no", "segs", line_text(c("segs")).alias("text")).withColumn("upper", F.upper("text")).withColumn("squashed", F.replace("upper", F.lit(" "), F.lit("")))
    held = F.filter(options, lambda o: F.when(o["kind"] == "value", F.contains(F.col("upper"), o["word"])).otherwise(F.contains(F.col("squashed"), o["key"])) & ~F.coalesce(F.contains(F.col("squashed"), o["unless"]), F.lit(False)))
    rows = rows.withColumn("o", F.explode_outer(held))
    cells = F.filter(F.transform(F.slice("segs", F.lit(2), F.greatest(F.size("segs"), F.lit(1))), lambda x: money.money(x)), lambda x: x.isNotNull())
    at = F.instr(c("upper"), c("o.word"))  # 0 where the label is spaced otherwise: then the whole text is searched
    behind = money.first_money(c("text"), F.when(at > 0, at + F.length("o.word") - 1).otherwise(0))
    rows = rows.withColumns({
        "figure": F.when(c("o.kind") == "figure", F.coalesce(F.element_at(F.when(F.size(cells) > 0, cells), -1), behind)),
        "year": F.when(c("o.kind") == "year", money.year_range(c("text"))),
        "value": F.when(c("o.kind") == "value", value_on_line(c("segs"), c("o.word"))),
    })
    first = lambda f, k: F.min_by(k, F.when((c("o.field") == f) & c(k).isNotNull(), F.struct("line_no", "o.no"))).alias(f)
    return rows.groupBy("doc_id").agg(*(first(f, k) for f, (k, _) in fields.items()))


def income_fields(lines: DataFrame) -> DataFrame:
    """Figures and years of an income sheet."""
    return first_hits(lines, INCOME_FIELDS, {"total_income": "GROSSTOTALINCOME"}).withColumn("refund", F.abs("refund"))


def payslip_fields(lines: DataFrame) -> DataFrame:
    """Names and figures of a pay slip."""
    return first_hits(lines, PAYSLIP_FIELDS, {})


# Words of a pay slip's first lines by vendor, first match first.
VENDORS = {
    "ZOHO": "zoho-payroll", "RAZORPAY": "razorpayx", "KEKA": "keka", "DARWINBOX": "darwinbox", "GREYTHR": "greythr", "QUESS": "quess", "SALARY SLIP": "generic-salary-slip", "PAY SLIP": "generic-payslip", "PAYSLIP": "generic-payslip",
}


def vendors(lines: DataFrame, most: int = 15) -> DataFrame:
    """(doc_id, vendor) told from each document's first lines."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("line_no")
    head = lines.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    text = F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line_text(F.col("segs")).alias("t")))), lambda x: x["t"]), " "))
    found = F.coalesce(*(F.when(F.contains(F.col("text"), F.lit(word)), name) for word, name in VENDORS.items()), F.lit("unknown"))
    return head.groupBy("doc_id").agg(text.alias("text")).select("doc_id", found.alias("vendor"))
