"""The nested document of an income sheet: heads with their components and named fields, tax matrix, deductions.

Every line of a sheet says in one row what it is: a component of the head above it, a section of the deductions, a figure
of the tax matrix, a way in which a house is held. The rows are the tagged parts of one array, so nothing is joined; the
head above a line and the open block of deductions are windows over the sheet, whose partitioning the last aggregate
shares: a sheet is shuffled once, whatever the document nests.

Cases: a sheet without any such line has every head unreported and empty lists; a head printed without an amount is
reported where it has a component; equal lines under a head count once, the first of a slot is its field, with or without
an amount; a line that names two heads opens both; null cells count as empty; amounts are in paise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendmill.functions import money
from lendmill.operators.extract import block_boundary, occupancy, section_code, slab_working
from lendmill.operators.fields import line_text
from lendmill.operators.labels import DEDUCTIONS, HEAD_LABELS, INTEREST, SLOTS, TAX_LABELS, component_slot

# The chapters of the heads, names of the matrix, words of totals, lines of a head's block, the version.
CHAPTERS = {"salary": "IV A", "house_property": "IV C", "business": "IV D", "capital_gains": "IV E", "other_sources": "IV F"}
CREDITS = {"tds": "tds", "tcs": "tcs", "advance_tax": "advance_tax", "self_assessment": "self_assessment_140a"}
MATRIX = {"tax_due": "tax_on_total_income", "rebate": "rebate_87a", "surcharge": "surcharge", "cess": "health_education_cess", "relief": "relief_89", "net_tax": "net_tax_payable"}
TOTALS = {"gross_total_income": ("GROSS TOTAL INCOME",), "total_income": ("TOTAL INCOME",)}
MOST_LINES, VERSION = 40, "1.0"

_PART = "struct<tag: string, name: string, no: int, label: string, paise: bigint, gross: bigint, slot: string>"


def _options() -> list[tuple[str, int, str, str]]:
    """(field, number, text that a line holds without its spaces, text behind which the amount stands)."""
    found = [(field, k, word.replace(" ", ""), word) for field, words in (HEAD_LABELS | TAX_LABELS | TOTALS | {"total_deductions": DEDUCTIONS}).items() for k, word in enumerate(words)]
    return found + [(field, 0, "U/S" + section.replace(" ", ""), section) for field, section in INTEREST.items()] + [("refundable", 0, "REFUNDABLE", "REFUNDABLE")]


def _part(tag: str, **fields: Column) -> Column:
    kinds = {"name": "string", "no": "int", "label": "string", "paise": "bigint", "gross": "bigint", "slot": "string"}
    return F.struct(F.lit(tag).alias("tag"), *(fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with their text, amounts, open heads and the state of the block of deductions."""
    c = F.col
    rows = lines.select("doc_id", "line_no", "page", F.transform("segs", lambda s: F.coalesce(s, F.lit(""))).alias("segs"))
    rows = rows.withColumn("text", line_text(c("segs"))).withColumns({"upper": F.upper("text"), "label": F.coalesce(F.get("segs", F.lit(0)), F.lit(""))})
    rows = rows.withColumns({"squashed": F.replace("upper", F.lit(" "), F.lit("")), "slab": slab_working(c("text"))})
    cells = F.filter(F.transform(F.slice("segs", F.lit(2), F.greatest(F.size("segs"), F.lit(1))), lambda s: money.money(s)), lambda x: x.isNotNull())
    rows = rows.withColumn("cells", cells)
    rows = rows.withColumn("amount", _amount(F.upper("label")))
    holds = lambda words: reduce(lambda a, b: a | b, (F.contains(c("squashed"), F.lit(w.replace(" ", ""))) for w in words))
    heads = F.array_compact(F.array(*(F.when(~c("slab") & holds(words), head) for head, words in HEAD_LABELS.items())))
    rows = rows.withColumns({"heads": heads, "heading": holds(DEDUCTIONS), "boundary": block_boundary(c("text"), c("amount").isNotNull())})
    along = Window.partitionBy("doc_id").orderBy("line_no")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"place": F.row_number().over(along), "own": (F.size("heads") > 0) | c("boundary")})
    event = F.when(c("own"), F.struct(F.when(F.size("heads") > 0, c("heads")).alias("heads"), c("place").alias("start")))
    marker = F.when(c("heading"), True).when(F.contains("upper", F.lit("TOTAL INCOME")), False)
    same = Window.partitionBy("doc_id", "text").orderBy("line_no")
    return rows.withColumns({"open": F.last(event, ignorenulls=True).over(upto), "inside": F.coalesce(F.last(marker, ignorenulls=True).over(upto), F.lit(False)), "found": F.first("cells").over(same)})


def _amount(word: Column) -> Column:
    """The last cell after the first that is an amount, else the first amount behind the word in the line's text."""
    at = F.instr(F.col("upper"), word)
    behind = money.first_money(F.col("text"), F.when(at > 0, at + F.length(word) - 1).otherwise(0))
    return F.when(F.size("cells") > 0, F.element_at("cells", -1)).otherwise(behind)


def parts(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, page, raw, tag, name, no, label, paise, gross, slot): what each line of a sheet is."""
    c = F.col
    every = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("no"), F.lit(key).alias("key"), F.lit(word).alias("word")) for f, k, key, word in _options()))
    free = ("gross_total_income", "refundable", *INTEREST)
    held = F.filter(every, lambda o: F.contains(F.col("squashed"), o["key"]) & (~F.col("slab") | o["field"].isin(*free)) & ((o["field"] != "total_income") | ~F.contains(F.col("squashed"), F.lit("GROSSTOTALINCOME"))))
    figures = F.transform(held, lambda o: _part("figure", name=o["field"], no=o["no"], paise=_amount(o["word"])))
    kept = ~c("own") & (c("place") - c("open.start") <= MOST_LINES)
    open_heads = F.when(kept, F.coalesce("open.heads", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    components = F.filter(F.transform(open_heads, lambda h: _part("component", name=h, label=F.col("label"), paise=F.col("amount"), slot=component_slot(h, F.col("text")))), lambda p: p["paise"].isNotNull() | p["slot"].isNotNull())
    section = section_code(c("upper"))
    behind = _amount(section)
    is_item = ~c("heading") & section.isNotNull() & ~section.rlike("^8[79]") & (behind.isNotNull() | c("inside"))
    deductible = F.when(F.size("found") == 0, behind).otherwise(F.element_at("found", -1))
    entry = _part("deduction", name=section, label=c("label"), paise=deductible, gross=F.when(F.size("found") > 1, F.get("found", F.lit(0))))
    house = occupancy(c("text"))
    single = F.array_compact(F.array(_part("line"), F.when(is_item, entry), F.when(house.isNotNull(), _part("field", name=F.lit("occupancy"), label=house))))
    rows = _placed(lines).select("doc_id", "line_no", "page", c("text").alias("raw"), F.explode(F.concat(figures, components, single)).alias("p")).select("doc_id", "line_no", "page", "raw", "p.*")
    # Equal lines under a head count once.
    again = F.row_number().over(Window.partitionBy("doc_id", "tag", "name", "raw").orderBy("line_no", "no"))
    return rows.withColumn("again", again).filter("tag <> 'component' or again = 1").drop("again")


def relational_documents(lines: DataFrame) -> DataFrame:
    """(doc_id, document) of lines (doc_id, line_no, page, segs): the whole nested document of each sheet."""
    c = F.col
    order = F.struct("line_no", "no")
    figure = lambda f: F.min_by(F.when(F.lit(f).isin("total_deductions", "refundable"), F.abs("paise")).otherwise(c("paise")), F.when((c("tag") == "figure") & (c("name") == f) & c("paise").isNotNull(), order)).alias(f"f_{f}")
    slot = lambda h, s: F.min_by("paise", F.when((c("tag") == "component") & (c("name") == h) & (c("slot") == s), c("line_no"))).alias(f"s_{h}_{s}")
    listed = lambda tag, *cols: F.array_sort(F.collect_list(F.when(c("tag") == tag, F.struct("line_no", *cols)))).alias(tag)
    fields = list(dict.fromkeys(o[0] for o in _options()))
    whole = parts(lines).groupBy("doc_id").agg(
        *(figure(f) for f in fields), *(slot(h, s) for h, slots in SLOTS.items() for s in slots),
        F.min_by("label", F.when((c("tag") == "field") & (c("name") == "occupancy"), c("line_no"))).alias("occupancy"),
        listed("component", "name", "label", "paise", "slot", "page", "raw"), listed("deduction", "name", "label", "gross", "paise", "raw"), F.max("page").alias("pages"),
    )

    def head(name: str) -> Column:
        own = F.filter("component", lambda p: p["name"] == name)
        below = F.transform(own, lambda p: F.struct(p["label"].alias("label"), p["paise"].alias("amount"), p["slot"].alias("slot"), p["page"].alias("page"), p["raw"].alias("raw_line")))
        held = [c("occupancy").alias("occupancy")] if name == "house_property" else []
        detail = F.struct(*held, *(c(f"s_{name}_{s}").alias(s) for s in SLOTS[name]))
        reported = c(f"f_{name}").isNotNull() | (F.size(own) > 0)
        return F.struct(F.lit(name).alias("head"), F.lit(CHAPTERS[name]).alias("chapter"), reported.alias("reported"), c(f"f_{name}").alias("total"), detail.alias("detail"), below.alias("components")).alias(name)

    entries = F.transform("deduction", lambda p: F.struct(p["name"].alias("section"), p["label"].alias("label"), p["gross"].alias("gross_amount"), p["paise"].alias("deductible_amount"), p["raw"].alias("raw_line")))
    total = F.aggregate(F.transform("deduction", lambda p: F.coalesce(p["paise"], F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    credits = [c(f"f_{f}").alias(n) for f, n in CREDITS.items()]
    credited = reduce(lambda a, b: a + b, (F.coalesce(f"f_{f}", F.lit(0)) for f in CREDITS))
    matrix = F.struct(
        c("f_gross_total_income").alias("gross_total_income"), c("f_total_deductions").alias("total_deductions"), c("f_total_income").alias("total_income"), *(c(f"f_{f}").alias(n) for f, n in MATRIX.items()),
        *(c(f"f_{f}").alias(f) for f in INTEREST), F.struct(*credits, credited.alias("total")).alias("credits"), c("f_refundable").alias("refundable"),
    )
    document = F.struct(
        F.struct(F.lit(VERSION).alias("schema_version"), c("pages").alias("page_count")).alias("metadata"), F.struct(*map(head, CHAPTERS)).alias("income_heads"), matrix.alias("tax_computation"),
        F.struct(entries.alias("entries"), c("f_total_deductions").alias("total_claimed"), total.alias("sum_of_entries")).alias("chapter_vi_a"),
    )
    return whole.select("doc_id", document.alias("document"))


def as_json(document: Column) -> Column:
    return F.to_json(document, {"ignoreNullFields": "false"})
