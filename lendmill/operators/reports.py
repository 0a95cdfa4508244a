"""Fields of bureau reports out of positioned text: metadata, identity, scores, account cards, enquiries, addresses.

A report is one row with an array of its elements (seq, x0, y0, x1, y1, text) in reading order, y counted over all pages.
An array is bounded by one report; whatever reads it is an expression, so a report is shuffled once for all its fields.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendmill.functions import pii
from lendmill.functions.coerce import amount_digits
from lendmill.operators import aligned
from lendmill.operators.aligned import NOT_A_DATE, NOT_A_NAME  # noqa: F401
from lendmill.operators.bureau import status_of_card
from lendmill.operators.extract import fold_wrapped
from lendmill.operators.layout import SLICES

ELEMENT = "struct<seq: bigint, x0: double, y0: double, x1: double, y1: double, text: string>"
# Shapes, labels and limits of a report.
DATE = r"([0-9]{2}[/-][0-9]{2}[/-][0-9]{4})"
CONTROL = r"\b([0-9]{11}|[0-9]{2},[0-9]{2},[0-9]{2},[0-9]{2},[0-9]{3}|[0-9]{10})\b"
SCORE = r"\b(3[0-9]{2}|[4-8][0-9]{2}|900)\b"
PL_SCORE = r"(?i)(?:PERSONAL\s*LOAN|PL)\s*SCORE\s*:?\s*(-?[0-9]{1,4})"
NO_DATE, NO_CONTROL, NO_NAME, NO_TYPE, NO_MEMBER = "01/01/2026", "00000000000", "UNKNOWN CONSUMER", "UNKNOWN TYPE", "NOT DISCLOSED"
NAME_LABELS = ("CONSUMER NAME", "CONSUMER:", "CONSUMER :", "NAME:")
SCORE_HEADERS = ("CREDITVISION", "SCORE", "CIBIL SCORE")
TERMINATORS = ("GLOSSARY", "END OF REPORT", "DISCLAIMER", "CIR DATA")
REPORT_KEYS = ("DATE", "CONTROL NUMBER", *NAME_LABELS, "PAN", "DOB", "DATE OF BIRTH", "GENDER")
#: Labels of a card by the slice of columns that holds them.
CARD_KEYS = {
    "first": ("TYPE", "DATE OPENED", "DATE", "DATE CLOSED", "OWNERSHIP"),
    "second": ("SANCTIONED", "SANCTIONED AMOUNT", "HIGH CREDIT AMOUNT", "CREDIT LIMIT", "CURRENT", "CURRENT BALANCE", "COLLATERAL VALUE", "OVERDUE"),
    "third": ("COLLATERAL TYPE",),
    "fourth": ("CREDIT FACILITY STATUS", "CREDIT FACILITY", "WRITTEN OFF (TOTAL)", "WRITTEN OFF (PRINCIPLE)", "WRITTEN OFF (PRINCIPAL)", "SETTLEMENT", "SETTLEMENT AMOUNT"),
}
FACILITY = r"(?i)CREDIT\s*FACILITY\s*STATUS\s*:\s*\n?\s*([A-Z][A-Z0-9 \-/()]{1,40})"


def _in_order(where: str = "true") -> Column:
    held = F.struct(F.col("seq").cast("bigint").alias("seq"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), "text")
    return F.sort_array(F.collect_list(F.when(F.expr(where), held))).cast(f"array<{ELEMENT}>").alias("elements")


def with_elements(elements: DataFrame, *keys: str) -> DataFrame:
    """One row for each key with the array of its elements in the order of seq; elements without text are left out."""
    return elements.filter("text is not null").groupBy(*keys).agg(_in_order())


def _first(elements: Column, value: Callable[[Column], Column]) -> Column:
    """The first element's value that is not null."""
    return F.get(F.filter(F.transform(elements, value), lambda v: v.isNotNull()), F.lit(0))


def _has(text: Column, *words: str) -> Column:
    held = F.lit(False)
    for word in words:
        held = held | F.contains(text, F.lit(word))
    return held


def _match(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def _fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with more columns, each evaluated once a row: the optimizer copies a plain column into every lambda that uses it."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _holding(elements: Column, *words: str) -> Column:
    """The first element with one of the words."""
    return F.get(F.filter(elements, lambda x: _has(F.upper(x["text"]), *words)), F.lit(0))


def aligned_values(scopes: DataFrame, keys: Column) -> DataFrame:
    """(columns of the scope but elements, key, value, confidence): the value that stands beside or below each key's label.

    ``keys`` is the array of keys to look for in a scope's elements. The best label is the group of elements in one column
    that holds most words of the key within the least height and with the least other text, and scores at least 50. Its
    value stands behind the label's own colon, else to the right and level with it (the nearest column within 30 points),
    else within 15 points below it. Keys without a label or a value have no row. Elements without x0, y0 or y1 take no part.
    """
    names = [c for c in scopes.columns if c != "elements"]
    schema = T.StructType([*(scopes.schema[n] for n in names), *(T.StructField(n, kind) for n, kind in (("key", T.StringType()), ("value", T.StringType()), ("confidence", T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in aligned.parts(whole)):
            e = aligned.Elements(batch.column("elements"))
            wanted = batch.column("_keys")
            owner, each = pc.list_parent_indices(wanted).to_numpy(), pc.list_flatten(wanted).dictionary_encode()
            place = pc.fill_null(each.indices, -1).to_numpy()
            asked = {key: owner[place == i] for i, key in enumerate(each.dictionary.to_pylist())}
            for scope, key, values, confidence in aligned.align(e, np.arange(e.ends[-1]), e.ends, asked):
                own = batch.select(names).take(pa.array(scope))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([key] * len(values), pa.string()), pa.array(values, pa.string()), pa.array(confidence)], schema.names)

    return scopes.withColumn("_keys", keys).mapInArrow(run, schema)


def _card_values(cards: DataFrame) -> DataFrame:
    """Cards with a column ``slice/key`` for each of CARD_KEYS, looked for in its own slice of columns, in place of their elements."""
    names = [c for c in cards.columns if c != "elements"]
    labels = [f"{name}/{key}" for name, keys in CARD_KEYS.items() for key in keys]
    schema = T.StructType([*(cards.schema[n] for n in names), *(T.StructField(n, T.StringType()) for n in labels), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in aligned.parts(whole)):
            e, rows = aligned.Elements(batch.column("elements")), batch.num_rows
            owner = np.repeat(np.arange(rows), np.diff(e.ends))
            found, total, count = {}, np.zeros(rows), np.zeros(rows, np.int64)
            for name, (low, high) in SLICES.items():
                inside = np.flatnonzero((e.x0 >= (-np.inf if low is None else low)) & (e.x0 < (np.inf if high is None else high)))
                ends = np.searchsorted(owner[inside], np.arange(rows + 1))
                for card, key, values, confidence in aligned.align(e, inside, ends, {key: np.arange(rows) for key in CARD_KEYS[name]}):
                    column = np.full(rows, None, object)
                    column[card] = values
                    found[f"{name}/{key}"] = pa.array(column, pa.string())
                    total[card] += confidence
                    count[card] += 1
            held = [found.get(label, pa.nulls(rows, pa.string())) for label in labels]
            confidence = pa.array(total / np.maximum(count, 1), mask=count == 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *held, confidence], schema.names)

    return cards.mapInArrow(run, schema)


def _aligned_map(reports: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Reports with a map ``found`` from key to aligned value."""
    found = aligned_values(reports, F.array(*map(F.lit, keys))).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("found"))
    return reports.join(found.hint("merge"), "doc_id", "left").withColumn("found", F.coalesce("found", F.expr("cast(map() as map<string, string>)")))


def metadata_and_identity(reports: DataFrame) -> DataFrame:
    """One row for each report: date and control number, each with a flag where it is a placeholder, and who it is about."""
    known = _aligned_map(reports, REPORT_KEYS)
    found = lambda key: F.element_at("found", F.lit(key))
    upper = lambda e: F.upper(e["text"])
    date = F.coalesce(_first(F.col("elements"), lambda e: F.when(_has(upper(e), "REPORT DATE", "DATE:", "DATE :"), _match(e["text"], DATE))), _match(found("DATE"), DATE))
    plain = lambda c: F.replace(c, F.lit(","), F.lit(""))
    digits = F.regexp_replace(found("CONTROL NUMBER"), "[^0-9]", "")
    control = F.coalesce(
        plain(_first(F.col("elements"), lambda e: F.when(_has(upper(e), "CONTROL NUMBER"), _match(e["text"], CONTROL)))), F.when(digits != "", digits), plain(_first(F.col("elements"), lambda e: _match(e["text"], CONTROL)))
    )
    named = F.coalesce(*(F.when((F.octet_length(found(k)) < 80) & ~F.contains(found(k), F.lit("ACCOUNT")), found(k)) for k in NAME_LABELS))
    part = lambda e: F.trim(F.get(F.split(e["text"], ":"), F.lit(1)))
    split = _first(F.col("elements"), lambda e: F.when(_has(upper(e), "CONSUMER:") & (part(e) != "") & (F.octet_length(part(e)) < 80), part(e)))
    pan = F.regexp_replace(found("PAN"), "[^A-Za-z0-9]", "")
    return known.select(
        "doc_id", F.coalesce(date, F.lit(NO_DATE)).alias("report_date"), date.isNull().alias("date_is_placeholder"), F.coalesce(control, F.lit(NO_CONTROL)).alias("control_number"), control.isNull().alias("control_is_placeholder"),
        F.coalesce(pii.redact_simple(F.coalesce(named, split)), F.lit(NO_NAME)).alias("consumer_name"), F.when(F.length(pan) >= 10, F.upper(pan)).alias("pan"), F.coalesce(found("DOB"), found("DATE OF BIRTH")).alias("date_of_birth"), found("GENDER").alias("gender"),
    )


def scores(reports: DataFrame) -> DataFrame:
    """One row for each report: score (0 without any), rural and personal-loan score.

    The score stands with its header in one element (legends of the scale aside), else it is the nearest to the first
    header, else the first of all. The personal-loan score stands behind its label, else right of it on its row.
    """
    e = F.col("elements")
    upper = lambda x: F.upper(x["text"])
    legend = lambda x: (_match(x["text"], SCORE) == "300") & _has(upper(x), "300 (HIGH RISK)") | (_match(x["text"], SCORE) == "900") & _has(upper(x), "900 (LOW RISK)")
    same = _first(e, lambda x: F.when(_has(upper(x), "SCORE", "CREDITVISION") & ~legend(x), _match(x["text"], SCORE)))
    known = _fixed(reports.select("doc_id", "elements"), same=same, header=F.coalesce(*(_holding(e, word) for word in SCORE_HEADERS)), label=_holding(e, "PERSONAL LOAN SCORE"))
    candidates = F.filter(F.transform(e, lambda x: F.struct(((x["x0"] - F.col("header.x0")) * (x["x0"] - F.col("header.x0")) + (x["y0"] - F.col("header.y0")) * (x["y0"] - F.col("header.y0"))).alias("far"), x["seq"].alias("seq"), _match(x["text"], SCORE).alias("score"))), lambda c: c["score"].isNotNull())
    near = F.array_min(candidates)["score"]
    level = lambda x: (x["y0"] < F.col("label.y1") + 6) & (x["y1"] > F.col("label.y0") - 6) & (x["x0"] > F.col("label.x1")) & F.trim(x["text"]).rlike("^-?[0-9]{1,4}$")
    personal = F.coalesce(_first(e, lambda x: _match(x["text"], PL_SCORE)), F.trim(F.get(F.filter(e, level), F.lit(0))["text"]))
    rural = F.when(F.exists(e, lambda x: _has(upper(x), "GRAMEEN") & F.contains(x["text"], F.lit("-2"))), -2)
    return known.select("doc_id", F.coalesce("same", near, F.lit("0")).cast("int").alias("score"), rural.alias("rural_score"), personal.cast("int").alias("pl_score"))


def rows_of(elements: Column) -> Column:
    """Elements as rows (row_no, cells): one joins the row whose first element it overlaps in height by more than 0.4 of the taller."""
    ordered = F.array_sort(F.transform(elements, lambda e: F.struct(e["y0"].alias("y0"), e["seq"].alias("seq"), e["x0"].alias("x0"), e["x1"].alias("x1"), e["y1"].alias("y1"), e["text"].alias("text"))))
    begun = F.struct(F.lit(0).alias("row_no"), F.lit(0.0).alias("top"), F.lit(-1.0).alias("bottom"), F.expr("cast(array() as array<int>)").alias("rows"))

    def place(state: Column, e: Column) -> Column:
        taller = F.greatest(state["bottom"] - state["top"], e["y1"] - e["y0"])
        joins = (state["row_no"] > 0) & (F.least(state["bottom"], e["y1"]) - F.greatest(state["top"], e["y0"]) > taller * 0.4)
        number = F.when(joins, state["row_no"]).otherwise(state["row_no"] + 1)
        return F.struct(number.alias("row_no"), F.when(joins, state["top"]).otherwise(e["y0"]).alias("top"), F.when(joins, state["bottom"]).otherwise(e["y1"]).alias("bottom"), F.concat(state["rows"], F.array(number)).alias("rows"))

    return F.arrays_zip(F.aggregate(ordered, begun, place)["rows"].alias("row_no"), ordered.alias("cell"))


def enquiries(reports: DataFrame) -> DataFrame:
    """(doc_id, entry, member, date_text, purpose, amount): the rows of the enquiry table, in order.

    The table begins at its column header and ends at the next closing section. A cell belongs to the column whose center
    is nearest; a row counts with a real date, and one that holds a purpose alone goes on with the enquiry above. A header
    with less than three known columns is none.
    """
    e = F.col("elements")
    known = _fixed(reports.select("doc_id", "elements"), header=_holding(e, "ENQUIRY DATE")).filter("header is not null")
    end = F.array_min(F.transform(F.filter(e, lambda x: (x["y0"] > F.col("header.y0")) & _has(F.upper(x["text"]), *TERMINATORS)), lambda x: x["y0"]))
    level = F.filter(e, lambda x: (x["y0"] < F.col("header.y1")) & (x["y1"] > F.col("header.y0")))
    slot = lambda x: F.when(_has(F.upper(x["text"]), "ENQUIRY DATE"), 1).when(_has(F.upper(x["text"]), "ENQUIRY PURPOSE"), 2).when(_has(F.upper(x["text"]), "ENQUIRY AMOUNT"), 3).when(_has(F.upper(x["text"]), "MEMBER NAME"), 0)
    headers = F.filter(F.transform(level, lambda x: F.struct(slot(x).alias("slot"), ((x["x0"] + x["x1"]) / 2).alias("center"))), lambda c: c["slot"].isNotNull())
    known = _fixed(known, end=F.coalesce(end, F.lit(float("inf"))), headers=headers)

    def last_of(k: int) -> Column:
        """Of headers with the same name the last one counts."""
        found = F.filter("headers", lambda c: c["slot"] == k)
        return F.when(F.size(found) > 0, F.element_at(found, -1))

    known = _fixed(known, columns=F.array_compact(F.array(*map(last_of, range(4))))).filter(F.size("columns") >= 3)
    body = F.filter(e, lambda x: (x["y0"] > F.col("header.y1")) & (x["y0"] < F.col("end")))
    cells = known.select("doc_id", "columns", F.inline(rows_of(body)))
    center = (F.col("cell.x0") + F.col("cell.x1")) / 2
    nearest = F.array_min(F.transform("columns", lambda c: F.struct(F.abs(center - c["center"]), c["slot"].alias("slot"))))["slot"]
    cells = cells.select("doc_id", "row_no", nearest.alias("slot"), F.trim("cell.text").alias("text"), F.struct("cell.x0", "cell.y0", "cell.seq").alias("at")).filter("text <> ''")
    pick = lambda k, name: F.min_by(F.when(F.col("slot") == k, F.col("text")), F.when(F.col("slot") == k, F.col("at"))).alias(name)
    rows = cells.groupBy("doc_id", "row_no").agg(pick(0, "member"), pick(1, "date_text"), pick(2, "purpose"), pick(3, "amount"))
    alone = F.col("purpose").isNotNull() & F.col("member").isNull() & F.col("date_text").isNull() & F.col("amount").isNull()
    valid = F.coalesce(F.col("date_text").rlike(f"^{DATE}$"), F.lit(False))
    folded = fold_wrapped(rows.filter(alone | valid).withColumn("purpose", F.coalesce("purpose", F.lit(""))))
    return folded.select("doc_id", "entry", pii.redact_simple(F.coalesce("member", F.lit(NO_MEMBER))).alias("member"), "date_text", "purpose", F.coalesce(amount_digits(F.col("amount")), F.lit(0)).alias("amount"))


def _table_rows(reports: DataFrame, *titles: str) -> DataFrame:
    """(doc_id, row_no, cells): rows of at least three cells below the first element with a title; cells from left to right."""
    known = _fixed(reports.select("doc_id", "elements"), begins=_holding(F.col("elements"), *titles)["y0"]).filter("begins is not null")
    cells = known.select("doc_id", F.inline(rows_of(F.filter("elements", lambda x: x["y0"] > F.col("begins")))))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("cell.x0", "cell.y0", "cell.seq", "cell.text"))), lambda c: F.trim(c["text"]))
    return cells.groupBy("doc_id", "row_no").agg(texts.alias("cells")).filter(F.size("cells") >= 3)


def addresses(reports: DataFrame) -> DataFrame:
    """(doc_id, row_no, address, category, date_reported): rows whose last cell looks like a date."""
    rows = _table_rows(reports, "ADDRESSES", "ADDRESS(ES)")
    last = F.element_at("cells", -1)
    return rows.filter((F.get("cells", F.lit(0)) != "") & last.rlike("[-/]")).select("doc_id", "row_no", pii.redact_simple(F.get("cells", F.lit(0))).alias("address"), F.get("cells", F.lit(1)).alias("category"), last.alias("date_reported"))


def employment(reports: DataFrame) -> DataFrame:
    """(doc_id, row_no, occupation_code, income, income_indicator): rows but the header's."""
    rows = _table_rows(reports, "EMPLOYMENT INFORMATION")
    code = F.get("cells", F.lit(1))
    return rows.filter(~code.isin("", "Occupation Code")).select("doc_id", "row_no", code.alias("occupation_code"), amount_digits(F.get("cells", F.lit(2))).alias("income"), F.get("cells", F.lit(3)).alias("income_indicator"))


def account_cards(elements: DataFrame, starts: DataFrame) -> DataFrame:
    """One row for each account card: its number, status and 18 fields, each from the first source that has a usable value.

    ``elements`` have (doc_id, page, seq, x0, y0, x1, y1, text), ``starts`` (doc_id, start_no, y0, text) of the first
    elements of cards. A card reaches down to the next start. Labels are looked for in their own slice of columns, so that
    no value of a neighbouring column is taken; an amount without a digit never stands in the way of a later source.
    """
    order = Window.partitionBy("doc_id").orderBy("y0", "start_no")
    numbered = starts.select("doc_id", "start_no", "y0", F.upper("text").alias("title")).withColumn("place", F.row_number().over(order))
    stated = F.regexp_extract("title", r"^\b([0-9]+)\.\s*ACCOUNT\b", 1).try_cast("bigint")
    # Starts and elements meet in one as-of window, dealt by document, and a card is grouped where it is: nothing is joined.
    held = F.struct("page", "seq", "x0", "y0", "x1", "y1", "text")
    marks = numbered.select("doc_id", F.col("y0").alias("y"), F.lit(0).alias("kind"), F.col("place").alias("start"), "title", F.lit(None).cast(elements.select(held.alias("held")).schema["held"].dataType).alias("held"))
    shown = elements.filter("text is not null").select("doc_id", F.col("y0").alias("y"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("title"), held.alias("held"))
    above = Window.partitionBy("doc_id").orderBy("y", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.unionByName(shown).withColumn("region", F.max("start").over(above)).withColumn("place", F.when(F.col("kind") == 0, F.col("start")).otherwise(F.col("region"))).filter("place is not null")
    rows = rows.select("doc_id", "place", "title", "kind", "held.*")
    whole = rows.groupBy("doc_id", "place").agg(F.max("title").alias("title"), _in_order("kind = 1"), F.array_sort(F.collect_set("page")).alias("source_pages"))
    whole = _fixed(whole, card=F.array_join("elements.text", "\n"))
    at = lambda s, key: F.col(f"`{s}/{key}`")
    inline = lambda label: _match(F.col("card"), rf"(?im)^\s*\Q{label}\E\s*:\s*(.+)$")
    stamp = lambda label: _match(F.col("card"), rf"(?i)(?:{label})\s*:\s*{DATE}")
    amount = lambda *sources: F.coalesce(*map(amount_digits, sources))
    facility = F.trim(_match(F.col("card"), FACILITY))
    off = lambda word: (inline(f"WRITTEN OFF AMOUNT ({word})"), inline(f"WRITTEN-OFF AMOUNT ({word})"))
    # What the text of a card says alone is read before its values are looked for, so neither is one method too long to compile.
    read = whole.select(
        "doc_id", "place", "title", "elements", F.when(F.size("elements") > 0, F.col("source_pages")).alias("source_pages"), status_of_card(F.col("card")).alias("status"), stamp(r"DATE\s*OPENED|OPENED").alias("date_opened"), stamp(r"DATE\s*CLOSED|CLOSED").alias("date_closed"),
        amount(inline("SANCTIONED"), inline("HIGH CREDIT"), inline("CREDIT LIMIT")).alias("sanctioned"), amount(inline("CURRENT BALANCE")).alias("balance"), inline("OWNERSHIP").alias("ownership"), facility.alias("facility"), amount(*off("TOTAL")).alias("written_off"),
        amount(*off("PRINCIPAL")).alias("written_off_principal"), amount(inline("SETTLEMENT AMOUNT")).alias("settlement"), amount(inline("OVERDUE")).alias("overdue"), stamp(r"LAST\s*PAYMENT").alias("last_payment"),
        stamp(r"PMT\s*HIST\s*START|START\s*DATE").alias("history_start"), stamp(r"PMT\s*HIST\s*END|END\s*DATE").alias("history_end"),
    )
    return _card_values(read).select(
        "doc_id", F.coalesce(stated, F.col("place").cast("bigint")).alias("card_no"), F.coalesce(pii.redact_simple(at("first", "TYPE")), F.lit(NO_TYPE)).alias("account_type"), "status",
        F.coalesce("date_opened", at("first", "DATE OPENED"), at("first", "DATE")).alias("date_opened"), F.coalesce("date_closed", at("first", "DATE CLOSED")).alias("date_closed"),
        F.coalesce(amount(at("second", "SANCTIONED"), at("second", "SANCTIONED AMOUNT"), at("second", "HIGH CREDIT AMOUNT"), at("second", "CREDIT LIMIT")), "sanctioned").alias("sanctioned"),
        F.coalesce(amount(at("second", "CURRENT"), at("second", "CURRENT BALANCE")), "balance").alias("balance"), F.coalesce(at("first", "OWNERSHIP"), "ownership").alias("ownership"),
        pii.redact_simple(at("third", "COLLATERAL TYPE")).alias("collateral_type"), amount(at("second", "COLLATERAL VALUE")).alias("collateral_value"),
        F.coalesce(at("fourth", "CREDIT FACILITY STATUS"), at("fourth", "CREDIT FACILITY"), "facility").alias("facility"), F.coalesce(amount(at("fourth", "WRITTEN OFF (TOTAL)")), "written_off").alias("written_off"),
        F.coalesce(amount(at("fourth", "WRITTEN OFF (PRINCIPLE)"), at("fourth", "WRITTEN OFF (PRINCIPAL)")), "written_off_principal").alias("written_off_principal"), F.coalesce(amount(at("fourth", "SETTLEMENT"), at("fourth", "SETTLEMENT AMOUNT")), "settlement").alias("settlement"),
        F.coalesce(amount(at("second", "OVERDUE")), "overdue").alias("overdue"), "last_payment", "history_start", "history_end", "source_pages", F.coalesce("confidence", F.lit(0.98)).alias("confidence"),
    )
