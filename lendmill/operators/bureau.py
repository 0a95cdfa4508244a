"""Credit-bureau reports over whole tables: accounts, payment cells and enquiries rolled up by report.

Tables: accounts (report_id, account_no, account_type, status, facility, opened, sanctioned, balance, overdue,
written_off, written_off_principal), cells (report_id, account_no, year, month, token), enquiries (report_id,
enquiry_no, date_text, purpose, amount) and reports (report_id, report_date_text, score, pl_score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendmill.functions.coerce import dpd_lenient, dpd_token

# Words of an account type by class, first match first, and the delivery's name of each class.
CLASSES = [
    ("CC", ("CREDIT CARD", "CHARGE CARD")), ("AUTO", ("AUTO", "CAR LOAN", "USED CAR", "TWO-WHEELER", "TWO WHEELER")), ("HOME", ("HOME LOAN", "HOUSING", "PROPERTY LOAN", "MORTGAGE")),
    ("AGRI", ("AGRI", "KISAN", "TRACTOR", "CROP")), ("MSME", ("MSME", "BUSINESS", "COMMERCIAL")), ("CONSUMER", ("CONSUMER LOAN", "CONSUMER DURABLE")), ("PL", ("PERSONAL",)),
]
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def write_off_class(account_type: Column) -> Column:
    text = F.upper(account_type)
    has = lambda *words: F.greatest(*(F.contains(text, F.lit(w)) for w in words), F.lit(False))
    found = F.when(has("CREDIT CARD", "CHARGE CARD") | (has("KISAN CREDIT") & has("CARD")), "CC")
    for name, words in CLASSES[1:]:
        found = found.when(has(*words), name)
    return found.otherwise("OTHER")


def civil_date(text: Column) -> Column:
    """The day of a ``dd/mm/yyyy`` or ``dd-mm-yyyy`` text; a day past a short month's end rolls over into the next."""
    parts = F.split(text, r"[/\-]")
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("int")
    day, month, year = number(0), number(1), number(2)
    good = (F.size(parts) == 3) & day.between(1, 31) & month.between(1, 12) & year.between(1, 9999)
    return F.when(good, F.date_add(F.make_date(F.when(good, year), F.when(good, month), F.lit(1)), day - 1))


def profile_flags(people: DataFrame) -> DataFrame:
    """What in a person's name, pan and date_of_birth breaks the schema; only the name has to be there."""
    # The schema's shapes.
    odd = lambda c, shape: F.coalesce(~F.col(c).rlike(shape), F.lit(False))
    return people.select("report_id", (F.length(F.coalesce("name", F.lit(""))) < 1).alias("no_name"), odd("pan", "^[A-Z]{5}[0-9]{4}[A-Z]$").alias("bad_pan"), odd("date_of_birth", "^[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}$").alias("bad_birth"))


def enquiry_flags(enquiries: DataFrame) -> DataFrame:
    """How many enquiries of each report break the schema: no member, no date of its shape, a negative amount."""
    dated = F.coalesce(F.col("date_text").rlike("^[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}$"), F.lit(False))
    return enquiries.groupBy("report_id").agg(F.count_if(F.col("member").isNull()).alias("no_member"), F.count_if(~dated).alias("bad_date"), F.count_if(F.col("amount") < 0).alias("negative"))


def title_key(text: Column) -> Column:
    """Words of ASCII letters and digits, each capitalized, joined by underscores; ``Unknown`` without any."""
    words = F.filter(F.split(F.regexp_replace(text, r"[^A-Za-z0-9]", " "), " "), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "_")
    return F.when(F.size(words) > 0, joined).otherwise("Unknown")


def status_of_card(text: Column) -> Column:
    """Account status by the words of a card's text; INACTIVE is looked for before ACTIVE."""
    upper = F.upper(text)
    has = lambda pattern: upper.rlike(pattern)
    return (
        F.when(has(r"WRITTEN[\s-]?OFF"), "WrittenOff").when(has(r"SUIT[\s-]?FILED"), "SuitFiled").when(has("REPOSSESSED"), "Repossessed").when(has("INACTIVE|CLOSED"), "Inactive").when(has("ACTIVE"), "Active").otherwise("Unknown")
    )


def status_label(status: Column, facility: Column) -> Column:
    named = F.upper(F.trim(facility))
    special = F.when(status == "WrittenOff", "ACTIVE - WRITTEN OFF").when(status == "SuitFiled", "ACTIVE - SUIT FILED").when(status == "Repossessed", "ACTIVE - REPOSSESSED").otherwise("ACTIVE")
    return F.when(status == "Inactive", "INACTIVE").when(named.isNotNull() & (named != "") & (named != "ACTIVE"), F.concat(F.lit("ACTIVE - "), F.translate(named, "-", " "))).otherwise(special)


def write_offs(accounts: DataFrame) -> DataFrame:
    """A column of written-off rupees for each class (null: none); a stated total of 0 keeps the principal out."""
    amount = F.coalesce("written_off", "written_off_principal", F.lit(0))
    kind = write_off_class(F.col("account_type"))
    return accounts.groupBy("report_id").agg(*(F.sum(F.when((kind == c) & (amount > 0), amount)).alias(c.lower()) for c, _ in CLASSES))


def largest_write_off(accounts: DataFrame) -> DataFrame:
    """The account with the greatest written-off total of each report that has one; of equals the last."""
    total = F.coalesce("written_off", F.lit(0))
    some = accounts.filter((total > 0) | (F.coalesce("written_off_principal", F.lit(0)) > 0))
    row = F.struct("account_no", "account_type", F.col("written_off").alias("total"), F.col("written_off_principal").alias("principal"))
    return some.groupBy("report_id").agg(F.max_by(row, F.struct(total, F.col("account_no"))).alias("r")).select("report_id", "r.*")


def outstanding(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("report_id").agg(F.coalesce(F.sum("balance"), F.lit(0)).alias("total_balance"), F.coalesce(F.sum("overdue"), F.lit(0)).alias("total_overdue"), F.count("*").alias("accounts"))


def enquiry_bands(enquiries: DataFrame, reports: DataFrame) -> DataFrame:
    """Enquiries by age at the report's date, in bands that do not overlap; none where a date cannot be read."""
    age = F.datediff(civil_date(F.col("report_date_text")), civil_date(F.col("date_text")))
    joined = reports.select("report_id", "report_date_text").join(enquiries, "report_id", "left")
    return joined.groupBy("report_id").agg(
        F.count("enquiry_no").alias("total"), F.count_if(age.between(0, 30)).alias("past_30_days"), F.count_if(age.between(31, 365)).alias("past_12_months"), F.count_if(age.between(366, 730)).alias("past_24_months")
    )


def enquiry_list(enquiries: DataFrame) -> DataFrame:
    """Each report's enquiries numbered from the most recent; unreadable dates come last, equals in their order."""
    order = Window.partitionBy("report_id").orderBy(civil_date(F.col("date_text")).desc_nulls_last(), "enquiry_no")
    return enquiries.select("report_id", "enquiry_no", "date_text", "amount", F.row_number().over(order).alias("place"))


def worst_by_year(cells: DataFrame) -> DataFrame:
    """(report_id, account_no, year, worst): the first step of both windows; a small table."""
    return cells.groupBy("report_id", "account_no", "year").agg(F.max(dpd_lenient(F.col("token"))).alias("worst"), F.max(F.when(F.col("token").rlike(r"^\d+$"), F.col("token").try_cast("int"))).alias("worst_number"))


def worst_in_report_window(cells: DataFrame, years: int = 2) -> DataFrame:
    """Worst cell in the report's own latest years, and ever; one roll-up by report and year, without a window."""
    by_year = cells.groupBy("report_id", "year").agg(F.max(dpd_lenient(F.col("token"))).alias("worst"))
    entries = by_year.groupBy("report_id").agg(F.max("year").alias("last"), F.collect_list(F.struct("year", "worst")).alias("e"))
    recent = F.array_max(F.transform("e", lambda x: F.when(x["year"] > F.col("last") - years, x["worst"]).otherwise(0)))
    out = entries.select("report_id", recent.alias("recent"), F.array_max(F.transform("e", lambda x: x["worst"])).alias("lifetime"))
    return out.withColumns({"missed": F.col("recent") > 0, "severe": F.col("recent") > 90})


def worst_in_account_window(cells: DataFrame, years: int = 2) -> DataFrame:
    """Worst whole-number cell in each account's own latest years."""
    order = Window.partitionBy("report_id", "account_no").orderBy(F.col("year").desc())
    ranked = worst_by_year(cells).withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= years)
    return ranked.groupBy("report_id").agg(F.coalesce(F.max("worst_number"), F.lit(0)).alias("recent"))


def payment_grid(cells: DataFrame) -> DataFrame:
    """Cleaned cells in rows with their place: years from the last, months in calendar order."""
    token = dpd_token(F.col("token"))
    kept = cells.select("report_id", "account_no", "year", "month", token.alias("token")).filter("token is not null")
    order = Window.partitionBy("report_id", "account_no").orderBy(F.col("year").desc(), "month")
    return kept.withColumns({"place": F.row_number().over(order), "days": F.when(F.col("token").rlike(r"^\d+$"), F.col("token").try_cast("int"))})


# The triage rules (name, decision), most severe decision last.
DECISIONS = ("APPROVE", "REFER", "DECLINE")
TRIAGE = {"WO_PRESENT": "DECLINE", "DPD_SEVERE": "DECLINE", "SCORE_LOW": "DECLINE", "OVERDUE_OPEN": "REFER", "DPD_MILD": "REFER", "SCORE_THIN": "REFER", "ENQUIRY_BURST": "REFER"}


def signals(reports: DataFrame, accounts: DataFrame, cells: DataFrame, enquiries: DataFrame) -> DataFrame:
    """One row a report with the figures that triage reads."""
    written = write_offs(accounts)
    total = sum((F.coalesce(c.lower(), F.lit(0)) for c, _ in CLASSES), F.lit(0))
    joined = (
        reports.select("report_id", F.coalesce("score", F.lit(0)).alias("score"))
        .join(written.select("report_id", total.alias("written_off")), "report_id", "left")
        .join(outstanding(accounts).select("report_id", "total_overdue"), "report_id", "left")
        .join(worst_in_account_window(cells), "report_id", "left")
        .join(enquiry_bands(enquiries, reports).select("report_id", "past_30_days"), "report_id", "left")
    )
    return joined.fillna(0, ["written_off", "total_overdue", "recent", "past_30_days"])


def triage_rules(known: DataFrame) -> DataFrame:
    """(report_id, code, decision) of every rule that fires."""
    c = F.col
    fires = {
        "WO_PRESENT": c("written_off") > 0, "DPD_SEVERE": c("recent") > 90, "SCORE_LOW": (c("score") > 0) & (c("score") < 650), "OVERDUE_OPEN": c("total_overdue") > 0,
        "DPD_MILD": c("recent").between(30, 90), "SCORE_THIN": c("score") == 0, "ENQUIRY_BURST": c("past_30_days") >= 4,
    }
    fired = F.array_compact(F.array(*(F.when(f, F.struct(F.lit(k).alias("code"), F.lit(TRIAGE[k]).alias("decision"))) for k, f in fires.items())))
    return known.select("report_id", fired.alias("fired"))


def triage_decision(known: DataFrame) -> DataFrame:
    """The most severe decision of the rules that fire."""
    severity = F.coalesce(F.array_max(F.transform("fired", lambda r: F.array_position(F.array(*map(F.lit, DECISIONS)), r["decision"]))), F.lit(1))
    return triage_rules(known).select("report_id", F.element_at(F.array(*map(F.lit, DECISIONS)), severity.cast("int")).alias("decision"), F.size("fired").alias("fired"))


def account_summary(accounts: DataFrame) -> DataFrame:
    """Counts and sums, and how many accounts repeat an earlier one's (type, opened, sanctioned)."""
    order = Window.partitionBy("report_id", "account_type", "opened", "sanctioned").orderBy("account_no")
    numbered = accounts.withColumn("again", F.row_number().over(order) > 1)
    return numbered.groupBy("report_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "Active").alias("active"), F.count_if(F.col("status") == "Inactive").alias("closed"),
        F.coalesce(F.sum("balance"), F.lit(0)).alias("balance"), F.coalesce(F.sum("sanctioned"), F.lit(0)).alias("sanctioned"), F.count_if("again").alias("repeated"),
    )
