"""Fields and flags out of lines, text blocks and uploaded files, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendmill.functions import pii
from lendmill.functions.coerce import dpd_token
from lendmill.operators.bureau import MONTHS

# Words that close a block of income lines, and shapes of deductions.
SUMMARY = ("GROSSTOTALINCOME", "TOTALINCOME", "CHAPTERVI-A", "CHAPTERVIA", "ROUNDOFF", "TAXDUE", "TAXPAYABLE", "TAXREFUNDABLE", "NAMEOFASSESSEE")
HEADINGS = ("TAXCALCULATION", "STATEMENTOF", "DETAILSOF", "DETAILOF", "ANNEXURE", "BANKACCOUNT", "GSTTURNOVER", "BALANCESHEET", "SIGNATURE", "COMPUTATIONOFTOTALINCOME")
SECTION_CODE = r"(?i)\b(80[A-Z]{1,3}\b|87A|89|24\(b\)|10\([0-9]+[A-Z]*\))"
SLAB = r"^TAX ON |EXEMPTION LIMIT :|@(5|10|15|20|30)%"
TOTALS = r"TOTAL|GROSS|NET PAY|NET SALARY|NET AMOUNT|TAKE HOME"
#: Uploads: largest size and page count, most bytes that streams may declare, and how much larger than the file.
MOST_BYTES, MOST_PAGES, MOST_DECLARED, MOST_RATIO = 5 << 20, 120, 300 << 20, 500
ACTIVE = {
    "javascript": r"(?i)/JavaScript|/JS\b", "auto_action": r"(?i)/OpenAction|/AA\b", "launch_action": r"(?i)/Launch\b", "embedded_file": r"(?i)/EmbeddedFile|/Filespec", "remote_uri": r"(?i)/URI\s*\(|/SubmitForm", "xfa_form": r"(?i)/XFA\b",
}


def slab_working(label: Column) -> Column:
    return F.upper(label).rlike(SLAB)


def block_boundary(label: Column, has_amount: Column) -> Column:
    """A summary row always closes a block; a heading only where it has no figure."""
    squashed = F.replace(F.upper(label), F.lit(" "), F.lit(""))
    return squashed.rlike("|".join(SUMMARY)) | (~has_amount & squashed.rlike("|".join(HEADINGS)))


def section_code(label: Column) -> Column:
    found = F.regexp_extract(label, SECTION_CODE, 1)
    return F.when(found != "", F.upper(found))


def first_line_wins(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """The value of each document's first line that has one."""
    return lines.groupBy("doc_id").agg(F.min_by(value, F.when(value.isNotNull(), F.col("line_no"))).alias(name))


def regime(label: Column) -> Column:
    upper = F.upper(label)
    return F.when(F.contains(upper, F.lit("115BAC")), "115BAC (New Tax Regime)").when(upper.rlike("OLD (TAX )?REGIME"), "Old Regime")


def occupancy(label: Column) -> Column:
    upper = F.upper(label)
    return F.when(upper.rlike("SELF[ -]OCCUPIED"), "self_occupied").when(upper.rlike("LET[ -]OUT"), "let_out")


def text_grid(blocks: DataFrame) -> DataFrame:
    """(block_id, year, month, token) of lines that begin with a year: tokens by place, January first."""
    lines = blocks.select("block_id", F.explode(F.split("block", r"\n")).alias("line")).select("block_id", F.trim("line").alias("line"))
    year = F.regexp_extract("line", r"^(20[0-9]{2})", 1)
    tokens = F.filter(F.split("line", r"[\s|]+"), lambda t: (t != "") & (t != F.col("year")))
    rows = lines.withColumn("year", year).filter("year <> ''").withColumn("tokens", F.slice(tokens, 1, 12)).select("block_id", F.col("year").cast("int").alias("year"), F.posexplode("tokens").alias("place", "raw"))
    return rows.select("block_id", "year", F.element_at(F.array(*map(F.lit, MONTHS)), F.col("place") + 1).alias("month"), dpd_token(F.col("raw")).alias("token"))


def inline_field(text: Column, label: str) -> Column:
    """The rest of the first line ``label : value``, any case."""
    found = F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*{label}[ \t]*:[ \t]*([^\n]*)$", 1))
    return F.when(found != "", found)


def pay_period(text: Column) -> tuple[Column, Column]:
    """Month and year of a pay slip's text."""
    pattern = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ ,'-]*(20[0-9]{2})\b"
    month = F.regexp_extract(text, pattern, 1)
    return F.when(month != "", F.initcap(month)), F.when(month != "", F.regexp_extract(text, pattern, 2).try_cast("int"))


def label_value_pairs(rows: DataFrame) -> DataFrame:
    """(row_id, pair_no, label, value): the cells of a row two by two; an odd last cell has no value."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / 2).cast("int")), lambda i: F.struct(i.alias("pair_no"), F.get("cells", i * 2).alias("label"), F.get("cells", i * 2 + 1).alias("value")))
    return rows.filter(F.size("cells") > 0).select("row_id", F.inline(pairs))


def fold_wrapped(rows: DataFrame) -> DataFrame:
    """Table rows whose only cell is the purpose belong to the last full row above; purposes are joined in order."""
    alone = F.col("purpose").isNotNull() & F.col("member").isNull() & F.col("date_text").isNull() & F.col("amount").isNull()
    order = Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("alone", alone).withColumn("entry", F.sum((~alone).cast("int")).over(order)).filter("entry > 0")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "purpose"))), lambda x: x["purpose"]), " ")
    first = lambda c: F.min_by(c, "row_no").alias(c)
    return numbered.groupBy("doc_id", "entry").agg(first("member"), first("date_text"), first("amount"), words.alias("purpose"))


def upload_verdict(data: Column, size: Column) -> dict[str, Column]:
    """Threat (or null), pages and active content of an upload read as latin-1 text."""
    numbers = lambda pattern: F.transform(F.regexp_extract_all(data, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("bigint"))
    counts = numbers(r"(?is)/Type\s*/Pages\b.{0,200}?/Count\s+([0-9]+)")
    pages = F.when(F.size(counts) > 0, F.array_max(counts)).otherwise(F.regexp_count(data, F.lit(r"(?i)/Type\s*/Page[^s]")).cast("bigint"))
    declared = F.aggregate(numbers(r"/Length\s+([0-9]{1,12})\b"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    threat = (
        F.when(size == 0, "EMPTY_UPLOAD").when(size > MOST_BYTES, "TOO_LARGE").when(~F.ltrim(F.substring(data, 1, 1024)).startswith("%PDF-"), "NOT_A_PDF").when(~F.contains(F.right(data, F.lit(4096)), F.lit("%%EOF")), "CORRUPT")
        .when(data.rlike(r"(?i)/Encrypt\b"), "ENCRYPTED").when(pages == 0, "CORRUPT").when(pages > MOST_PAGES, "TOO_MANY_PAGES").when((declared > MOST_DECLARED) | (declared / F.greatest(size, F.lit(1)) > MOST_RATIO), "DECOMPRESSION_BOMB")
    )
    active = F.array_join(F.array_compact(F.array(*(F.when(data.rlike(p), n) for n, p in ACTIVE.items()))), ",")
    return {"threat": threat, "pages": pages, "active": active}


def confidence(elements: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Character, layout, relation and overall confidence of each document; bytes count for all, characters for lost ones."""
    lost = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
    rolled = elements.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("whole"), F.sum(lost).alias("lost"), F.avg("layout").alias("layout"))
    known = rolled.join(mismatches, "doc_id", "left")
    character = F.when(F.col("whole") > 0, (F.col("whole") - F.col("lost")) / F.col("whole")).otherwise(1.0)
    layout, relation = F.coalesce("layout", F.lit(0.97)), F.greatest(F.lit(0.5), 1 - F.coalesce("mismatches", F.lit(0)) * 0.1)
    return known.select("doc_id", F.round(character, 4).alias("character"), F.round(layout, 4).alias("layout"), F.round(relation, 4).alias("relation"), F.round((character + layout + relation) / 3, 4).alias("overall"))


def redact_map(entries: Column) -> Column:
    """A map with identifiers masked in its keys and its values."""
    return F.transform_values(F.transform_keys(entries, lambda k, v: pii.redact_simple(k)), lambda k, v: pii.redact_simple(v))


def cells_to_bands(cells: DataFrame, bands: DataFrame, most: float = 6.0) -> DataFrame:
    """The column band of each cell: the nearest left edge, at most so far; of equals the first.

    Edges are repeated for the strip of that width that they lie in and its neighbours, so a cell meets those near it.
    """
    strip = lambda x: F.floor(F.col(x) / most)
    near = bands.select("doc_id", F.col("x0").alias("edge")).withColumn("strip", F.explode(F.array(strip("edge") - 1, strip("edge"), strip("edge") + 1)))
    joined = cells.select("doc_id", "seq", "x0").withColumn("strip", strip("x0")).join(near, ["doc_id", "strip"]).withColumn("gap", F.abs(F.col("x0") - F.col("edge")))
    return joined.filter(F.col("gap") <= most).groupBy("doc_id", "seq").agg(F.min(F.struct("gap", "edge")).alias("m")).select("doc_id", "seq", F.col("m.edge").alias("edge"))


def column_bands(elements: DataFrame, most: float = 6.0) -> DataFrame:
    """Bands of left edges: an edge joins a band whose first edge is at most so far to its left; read in order by document."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, start, number = None, 0.0, 0
        for part in parts:
            found = []
            for d, x in zip(part["doc_id"], part["x0"], strict=True):
                if d != doc:
                    doc, start, number = d, x, 1
                elif x - start > most:
                    start, number = x, number + 1
                found.append((number, start))
            yield part.assign(band=[n for n, _ in found], edge=[e for _, e in found])

    dealt = elements.select("doc_id", "x0").distinct().repartition("doc_id").sortWithinPartitions("doc_id", "x0")
    return dealt.mapInPandas(fold, "doc_id long, x0 double, band long, edge double")
