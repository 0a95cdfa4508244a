"""Labelled blocks of income sheets and pay slips: lines (doc_id, line_no, segs) with segs the text cells of a line.

Words that name a field are rows of a table, longest first, so that a short one never takes a more special one's cell.
A field is the first hit by line: one aggregate by document for all fields of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendmill.functions import money
from lendmill.operators.extract import first_line_wins, occupancy, section_code, slab_working
from lendmill.operators.fields import line_text, squashed

# Words of a sheet by the field that they name.
ASSESSEE = {
    "NAME OF ASSESSEE": "name", "ASSESSEE NAME": "name", "FATHER'S NAME": "fathers_name", "FATHERS NAME": "fathers_name", "ADDRESS": "address", "E-MAIL": "email", "EMAIL": "email", "STATUS": "status", "PAN": "pan",
    "DATE OF BIRTH": "date_of_birth", "RESIDENTIAL STATUS": "residential_status", "GENDER": "gender", "WARD": "ward", "NATURE OF BUSINESS": "nature_of_business", "FILING STATUS": "filing_status", "BANK NAME": "bank",
}
EMPLOYEE = {
    "EMPLOYEE NAME": "name", "EMP NAME": "name", "NAME OF EMPLOYEE": "name", "NAME/PSNO": "name", "NAME": "name", "EMPLOYEE CODE": "employee_id", "EMPLOYEE ID": "employee_id", "EMPLOYEE NO": "employee_id",
    "EMP CODE": "employee_id", "EMP ID": "employee_id", "EMP NO": "employee_id", "DESIGNATION": "designation", "GRADE": "designation", "DEPARTMENT": "department", "DIVISION": "department", "PAN NO": "pan",
    "PAN NUMBER": "pan", "PAN": "pan", "UAN NO": "uan", "UAN NUMBER": "uan", "UAN": "uan", "PF NO": "pf_number", "PF NUMBER": "pf_number", "PF ACCOUNT": "pf_number", "ESI NO": "esi_number", "ESI NUMBER": "esi_number",
    "BANK ACCOUNT": "bank_account", "ACCOUNT NO": "bank_account", "A/C NO": "bank_account", "DATE OF JOINING": "date_of_joining", "DOJ": "date_of_joining",
}
HEAD_LABELS = {
    "salary": ("INCOME FROM SALARY", "SALARIES (CHAPTER IV A)", "INCOME FROM SALARIES", "SALARY (CHAPTER IV A)", "CHAPTER IV A", "SALARIES"),
    "house_property": ("INCOME FROM HOUSE PROPERTY", "HOUSE PROPERTY (CHAPTER IV C)", "CHAPTER IV C"),
    "business": ("INCOME FROM BUSINESS OR PROFESSION", "PROFITS AND GAINS FROM BUSINESS OR PROFESSION", "INCOME FROM BUSINESS", "PROFITS AND GAINS OF BUSINESS OR PROFESSION", "CHAPTER IV D", "BUSINESS AND PROFESSION"),
    "capital_gains": ("INCOME FROM CAPITAL GAIN", "CAPITAL GAINS", "CAPITAL GAIN (CHAPTER IV E)", "CHAPTER IV E"),
    "other_sources": ("INCOME FROM OTHER SOURCES", "INCOME FROM OTHER SOURCE", "OTHER SOURCES (CHAPTER IV F)", "CHAPTER IV F", "OTHER SOURCES"),
}
TAX_LABELS = {
    "tax_due": ("TAX DUE", "TAX ON TOTAL INCOME", "TOTAL TAX"), "surcharge": ("SURCHARGE",), "cess": ("HEALTH & EDUCATION CESS", "HEALTH AND EDUCATION CESS", "EDUCATION CESS", "HEC"), "rebate": ("REBATE U/S 87A", "REBATE"),
    "relief": ("RELIEF U/S 89", "RELIEF"), "net_tax": ("TAX PAYABLE", "NET TAX PAYABLE", "NET TAX"), "tds": ("T.D.S./T.C.S", "TDS/TCS", "T.D.S.", "TDS"), "tcs": ("T.C.S.", "TCS"), "advance_tax": ("ADVANCE TAX",),
    "self_assessment": ("DEPOSIT U/S 140A", "SELF ASSESSMENT TAX", "U/S 140A"),
}
INTEREST = {"interest_234a": "234 A", "interest_234b": "234B", "interest_234c": "234C"}
DEDUCTIONS = ("LESS: DEDUCTIONS (CHAPTER VI-A)", "DEDUCTIONS UNDER CHAPTER VI-A", "LESS : DEDUCTION UNDER CHAPTER VI-A", "DEDUCTION UNDER CHAPTER VI A", "TOTAL DEDUCTIONS", "CHAPTER VI-A")
#: Slots of a head's components by keyword; the first that fits classifies.
SLOTS = {
    "salary": {
        "standard_deduction_16ia": ("16(IA)", "STANDARD DEDUCTION"), "professional_tax_16iii": ("PROFESSIONAL TAX", "16(III)"), "gross_salary": ("GROSS SALARY",), "taxable_salary": ("TAXABLE SALARY", "NET SALARY"),
        "perquisites": ("PERQUISITE",), "hra": ("H.R.A", "HOUSE RENT ALLOWANCE", "HRA"), "allowances": ("ALLOWANCE",), "basic": ("BASIC",),
    },
    "house_property": {
        "interest_24b": ("24(B)", "INTEREST ON BORROWED", "INTEREST ON HOUSING", "HOUSING LOAN"), "standard_deduction_24a": ("24(A)", "STANDARD DEDUCTION", "30%"), "municipal_tax": ("MUNICIPAL TAX", "MUNICIPAL"),
        "annual_value": ("ANNUAL VALUE", "ANNUAL LETTABLE"),
    },
    "business": {
        "presumptive_44ada": ("44ADA",), "presumptive_44ae": ("44AE",), "deemed_profit": ("DEEMED PROFIT", "PROFIT DEEMED"), "assessable_profit": ("HIGHER OF THE ABOVE",),
        "book_profit": ("BOOK PROFIT", "PROFIT AND LOSS", "PROFIT & LOSS"), "net_profit": ("NET PROFIT", "PROFIT DECLARED"), "gross_receipts": ("GROSS RECEIPT", "TURNOVER"), "depreciation": ("DEPRECIATION",),
        "presumptive_44ad": ("44AD",),
    },
    "capital_gains": {
        "brought_forward_loss": ("BROUGHT FORWARD", "B/F LOSS"), "long_term_112a": ("112A",), "short_term_111a": ("111A", "@ 15%", "@15%"), "long_term": ("LONG TERM",), "short_term": ("SHORT TERM",),
    },
    "other_sources": {
        "income_tax_refund_interest": ("INCOME TAX REFUND", "IT REFUND", "I.T. REFUND"), "savings_bank_interest": ("SAVING BANK", "SAVINGS BANK", "SAVING A/C"),
        "fixed_deposit_interest": ("F.D.R", "FDR", "FIXED DEPOSIT", "TIME-DEPOSIT", "TIME DEPOSIT"), "dividend": ("DIVIDEND",), "family_pension": ("FAMILY PENSION",),
        "agricultural_income": ("AGRICULTURE", "AGRICULTURAL"), "other": ("OTHER ITEM",),
    },
}
# Shapes of identifiers and of amounts in running text.
PAN = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
UAN = r"(?i)\bUAN\s*(?:no\.?|number)?\s*[:\-]?\s*(\d{12})\b"
AMOUNT = r"(?:\(|-)?\s*(?:INR|Rs\.?|₹)?\s*\d{1,3}(?:,\d{2,3})*(?:\.\d{1,2})?\s*\)?"


def longest_first(labels: dict[str, str]) -> list[str]:
    return sorted(labels, key=len, reverse=True)


def label_of(cell: Column, labels: dict[str, str]) -> Column:
    """The longest label that a cell is or begins with, colons and case aside."""
    return label_at(plain_cell(cell), labels)


def plain_cell(cell: Column) -> Column:
    """A cell in capitals without spaces and colons at its ends."""
    return F.trim(F.rtrim(F.trim(F.upper(cell)), F.lit(":")))


def label_at(plain: Column, labels: dict[str, str]) -> Column:
    """The longest label that a plain cell begins with; a column of a row, so that it is made once and not once a label."""
    return F.coalesce(*(F.when(plain.startswith(label), label) for label in longest_first(labels)))


def _field(label: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(label == word, name) for word, name in labels.items()))


def _found(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", hit)


def assessee(lines: DataFrame) -> DataFrame:
    """One row for each document: the fields of label and value pairs (a line's first two cells), PAN of a valid shape.

    Without a labelled PAN the first one anywhere in the document counts.
    """
    value = F.trim(F.get("segs", F.lit(1)))
    pairs = lines.select("doc_id", "line_no", F.upper(line_text(F.col("segs"))).alias("text"), _field(label_of(F.get("segs", F.lit(0)), ASSESSEE), ASSESSEE).alias("field"), F.when(value != "", value).alias("value"))
    first = lambda name: F.min_by("value", F.when((F.col("field") == name) & F.col("value").isNotNull(), F.col("line_no")))
    any_pan = _found(F.col("text"), PAN)
    names = list(dict.fromkeys(ASSESSEE.values()))
    found = pairs.groupBy("doc_id").agg(*(first(n).alias(n) for n in names), F.min_by(any_pan, F.when(any_pan.isNotNull(), F.col("line_no"))).alias("other_pan"))
    return found.withColumn("pan", _found(F.upper(F.coalesce("pan", "other_pan")), PAN)).drop("other_pan")


def employee(lines: DataFrame) -> DataFrame:
    """One row for each document: the fields of cells that begin with a label, on the label's own line or below it.

    The value stands after a colon in the same cell, else it is the next cell that is not empty. Where a line has neither
    for a label, and lines come with ``page`` and ``boxes`` (x, width of each cell), it is the first filled cell of the next
    line that overlaps the first cell that is just this label, on the same page. On a line the longest label comes first.
    Without a labelled PAN or UAN the first one in a line's text counts.
    """
    c = F.col
    placed = "boxes" in lines.columns
    rows = lines.withColumn("text", line_text(c("segs")))
    # What a line's text holds is looked for once a line, not once a cell.
    rows = rows.withColumn("capitals", F.upper("text"))
    rows = rows.withColumns({"line_pan": _found(c("capitals"), PAN), "line_uan": F.when(F.contains("capitals", F.lit("UAN")), _found(c("text"), UAN))})
    if placed:
        following = F.lead(F.struct("page", "segs", "boxes")).over(Window.partitionBy("doc_id").orderBy("line_no"))
        rows = rows.withColumns({"following": following, "plain": F.transform("segs", plain_cell)})
    kept = ["page", "boxes", "following", "plain"] if placed else []
    cells = rows.select("doc_id", "line_no", "line_pan", "line_uan", "segs", *kept, F.posexplode("segs").alias("place", "cell"))
    cells = cells.withColumn("own_plain", plain_cell(c("cell"))).withColumn("label", label_at(c("own_plain"), EMPLOYEE))
    tail = F.trim(F.regexp_extract("cell", "(?s)^[^:]*:(.*)$", 1))
    later = F.filter(F.transform(F.slice("segs", c("place") + 2, F.size("segs")), lambda x: F.trim(F.regexp_replace(F.trim(x), "^:+", ""))), lambda x: x != "")
    beside = F.when(c("label").isNotNull(), F.when(tail != "", tail).otherwise(F.get(later, F.lit(0))))
    below = F.lit(None).cast("string")
    if placed:
        own = F.get("boxes", c("place"))
        under = F.arrays_zip(c("following.segs").alias("seg"), c("following.boxes").alias("box"))
        meets = lambda u: (own["x"] < u["box"]["x"] + u["box"]["width"]) & (u["box"]["x"] < own["x"] + own["width"]) & (F.trim(u["seg"]) != "")
        first_alone = (F.array_position("plain", c("label")) == c("place") + 1) & (c("following.page") == c("page"))
        below = F.when(first_alone, F.trim(F.get(F.filter(under, meets), F.lit(0))["seg"]))
    named = cells.withColumn("beside", beside)
    value = F.when(c("label").isNotNull(), F.coalesce(c("beside"), below)).alias("value")
    # A value below counts only where no cell of the line gives the label one beside it.
    at = F.struct("line_no", (-F.length("label")).alias("shorter"), c("beside").isNull().alias("below"), "place").alias("at")
    first_cell = lambda x: F.when(c("place") == 0, c(x)).alias(x)
    named = named.select("doc_id", "line_no", first_cell("line_pan"), first_cell("line_uan"), _field(c("label"), EMPLOYEE).alias("field"), value, at)
    first = lambda name: F.min_by("value", F.when((c("field") == name) & c("value").isNotNull(), c("at")))
    other = lambda x: F.min_by(x, F.when(c(x).isNotNull(), c("line_no")))
    names = list(dict.fromkeys(EMPLOYEE.values()))
    found = named.groupBy("doc_id").agg(*(first(n).alias(n) for n in names), other("line_pan").alias("other_pan"), other("line_uan").alias("other_uan"))
    return found.withColumns({"pan": F.coalesce("pan", "other_pan"), "uan": F.coalesce("uan", "other_uan")}).drop("other_pan", "other_uan")


def employer(lines: DataFrame) -> DataFrame:
    """Name and address: the first two substantial lines above a pay slip's title (of the first four, where it has none)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    placed = lines.select("doc_id", F.trim(line_text(F.col("segs"))).alias("text"), (F.row_number().over(order) - 1).alias("place"))
    title = F.upper("text").rlike("PAYSLIP|PAY SLIP|SALARY SLIP")
    ends = placed.groupBy("doc_id").agg(F.greatest(F.coalesce(F.min(F.when(title, F.col("place"))), F.lit(4)), F.lit(1)).alias("end"))
    fits = (F.col("place") < F.col("end")) & (F.length("text") >= 3) & ~F.col("text").rlike(AMOUNT) & ~F.upper("text").rlike("PAYSLIP|PAY SLIP")
    head = placed.join(ends, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(fits & (F.col("place") < F.col("end")), F.struct("place", "text")))).alias("head"))
    return head.select("doc_id", F.get("head", F.lit(0))["text"].alias("name"), F.get("head", F.lit(1))["text"].alias("address"))


def labelled_amounts(lines: DataFrame, options: dict[str, tuple[tuple[str, str], ...]], unless: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document with the amount of each field: of the first line that holds an option and has an amount.

    An option is what the line holds without its spaces, and the text behind which the amount stands. ``unless`` names
    the fields that slab workings do not count for. Only options that a line holds are looked at for an amount.
    """
    every = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("no"), F.lit(key).alias("key"), F.lit(word).alias("word")) for f, some in options.items() for k, (key, word) in enumerate(some)))
    rows = lines.select("doc_id", "line_no", "segs", line_text(F.col("segs")).alias("text")).withColumn("upper", F.upper("text")).withColumn("squashed", squashed(F.col("text")))
    rows = rows.withColumn("o", F.explode_outer(F.filter(every, lambda o: F.contains(F.col("squashed"), o["key"]))))
    rows = rows.withColumn("o", F.when(~(slab_working(F.col("text")) & F.col("o.field").isin(*unless)), F.col("o")) if unless else F.col("o"))
    cells = F.filter(F.transform(F.slice("segs", F.lit(2), F.greatest(F.size("segs"), F.lit(1))), lambda c: money.money(c)), lambda x: x.isNotNull())
    at = F.instr(F.col("upper"), F.col("o.word"))
    behind = money.first_money(F.col("text"), F.when(at > 0, at + F.length("o.word") - 1).otherwise(0))
    found = rows.withColumn("paise", F.when(F.col("o").isNotNull(), F.coalesce(F.element_at(F.when(F.size(cells) > 0, cells), -1), behind)))
    best = lambda f: F.min_by("paise", F.when((F.col("o.field") == f) & F.col("paise").isNotNull(), F.struct("line_no", "o.no")))
    return found.groupBy("doc_id").agg(*(best(f).alias(f) for f in options))


def _spaceless(words: tuple[str, ...]) -> tuple[tuple[str, str], ...]:
    return tuple((word.replace(" ", ""), word) for word in words)


def tax_figures(lines: DataFrame) -> DataFrame:
    """One row for each document: interest, heads of income, tax and credits; slab workings are no results."""
    options = {name: (("U/S" + section.replace(" ", ""), section),) for name, section in INTEREST.items()}
    options |= {name: _spaceless(words) for name, words in (HEAD_LABELS | TAX_LABELS).items()}
    return labelled_amounts(lines, options, unless=(*HEAD_LABELS, *TAX_LABELS))


def deductions(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, section, label, amount, gross, deductible): the section lines of a sheet.

    A line without an amount counts only inside the block that a heading of deductions opens and a total of income
    closes. Gross and deductible come from the amounts of the first line with the same text: none, one, or the first
    and the last.
    """
    heading = F.lit(False)
    for word in DEDUCTIONS:
        heading = heading | F.contains("squashed", F.lit(word.replace(" ", "")))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.filter("doc_id is not null").select("doc_id", "line_no", "segs", line_text(F.col("segs")).alias("text"))
    rows = rows.withColumns({"upper": F.upper("text"), "squashed": squashed(F.col("text"))}).withColumn("heading", heading)
    rows = rows.withColumns({"marker": F.when(F.col("heading"), True).when(F.contains("upper", F.lit("TOTAL INCOME")), False), "section": section_code(F.col("upper"))})
    rows = rows.withColumn("inside", F.coalesce(F.last("marker", ignorenulls=True).over(order), F.lit(False)))
    # Equal texts are headings and have sections alike, so the first line with an item's text is an item's line too.
    rows = rows.filter("not heading and section is not null and not (section like '87%' or section like '89%')")
    amounts = F.filter(F.transform(F.slice("segs", F.lit(2), F.greatest(F.size("segs"), F.lit(1))), lambda c: money.money(c)), lambda x: x.isNotNull())
    at = F.instr(F.col("upper"), F.col("section"))
    behind = money.first_money(F.col("text"), F.when(at > 0, at + F.length("section") - 1).otherwise(0))
    amount = F.when(F.size("amounts") > 0, F.element_at("amounts", -1)).otherwise(behind)
    same = Window.partitionBy("doc_id", "text").orderBy(F.col("line_no").asc_nulls_last())
    rows = rows.withColumn("amounts", amounts).withColumn("found", F.first("amounts").over(same))
    joined = rows.withColumn("amount", amount).filter("amount is not null or inside")
    deductible = F.when(F.size("found") == 0, F.col("amount")).otherwise(F.element_at("found", -1))
    return joined.select("doc_id", "line_no", "section", F.get("segs", F.lit(0)).alias("label"), "amount", F.when(F.size("found") > 1, F.get("found", F.lit(0))).alias("gross"), deductible.alias("deductible"))


def deduction_totals(lines: DataFrame) -> DataFrame:
    """(doc_id, total): the stated total as a magnitude, as a dash before it is no sign."""
    found = labelled_amounts(lines, {"total": _spaceless(DEDUCTIONS)}, unless=("total",))
    return found.select("doc_id", F.abs("total").alias("total"))


def head_details(components: DataFrame, lines: DataFrame) -> DataFrame:
    """One row for each document with the named fields of all heads, and how a house is held.

    ``components`` have (doc_id, head, line_no, label, paise). Lines of the same text under a head count once; of several
    components in a slot the first one is the field, with or without an amount. ``lines`` have (doc_id, line_no, label).
    """
    once = components.groupBy("doc_id", "head", "label").agg(F.min(F.struct("line_no", "paise")).alias("m")).select("doc_id", "head", "label", "m.line_no", "m.paise")
    slotted = once.withColumn("slot", component_slot(F.col("head"), F.col("label")))
    pick = lambda head, slot: F.min_by("paise", F.when((F.col("head") == head) & (F.col("slot") == slot), F.col("line_no"))).alias(slot)
    fields = slotted.groupBy("doc_id").agg(*(pick(head, slot) for head, slots in SLOTS.items() for slot in slots))
    return fields.join(first_line_wins(lines, occupancy(F.col("label")), "occupancy"), "doc_id", "left")


def sheet_schema_flags(sheets: DataFrame) -> DataFrame:
    """What in a computation (source, format, pan, aadhaar, ay, fy as (start, end), fy_source, sections) breaks its schema.

    Absent values are allowed but for the source and the format; years lie between 1990 and 2100, their ends one later.
    """
    year = lambda c: F.coalesce(~(F.col(c)["start"].between(1990, 2100) & F.col(c)["end"].between(1991, 2101)), F.col(c).isNotNull())
    some = lambda c: F.coalesce(c, F.lit(False))
    return sheets.select(
        "sheet_id", (F.length(F.coalesce("source", F.lit(""))) < 1).alias("bad_source"), (~some(F.col("format").isin("Pdf", "Rtf"))).alias("bad_format"), some(~F.col("pan").rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")).alias("bad_pan"),
        some(F.col("aadhaar") != "[Aadhaar Redacted]").alias("bad_aadhaar"), year("ay").alias("bad_assessment_year"), year("fy").alias("bad_financial_year"), some(~F.col("fy_source").isin("stated", "derived")).alias("bad_year_source"),
        F.size(F.filter("sections", lambda c: c.isNull() | (F.length(c) < 2))).alias("bad_sections"),
    )


def component_slot(head: Column, label: Column) -> Column:
    """The slot of a component under its head, or null."""
    text = squashed(label)
    hits = []
    for name, slots in SLOTS.items():
        for slot, words in slots.items():
            for word in words:
                hits.append(F.when((head == name) & F.contains(text, F.lit(word.replace(" ", ""))), slot))
    return F.coalesce(*hits)
