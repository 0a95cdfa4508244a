"""Positioned text: bands, offsets, nearest labels, regions and runs of elements, document by document.

Elements are (doc_id, page, x0, y0, x1, y1, text, seq). Joins between elements have the document as an equality key, so
they are hash joins with a filter, never products of whole tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bands(elements: DataFrame, gap: float) -> DataFrame:
    """Each element with its band: a new one begins where it starts below all before it by more than the gap."""
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "seq")
    before = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = elements.withColumn("fresh", F.when(before.isNull() | (F.col("y0") > before + gap), 1).otherwise(0))
    return fresh.withColumn("band", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def page_offsets(pages: DataFrame, between: float = 100.0) -> DataFrame:
    """Where each page begins when all pages of a document are laid below each other."""
    order = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("top", F.coalesce(F.sum(F.col("height") + between).over(order), F.lit(0.0)))


def repeated_margins(elements: DataFrame, pages: DataFrame, margin: float = 60.0, least: int = 2) -> DataFrame:
    """Texts (digits aside) in the margins of at least so many pages of a document."""
    near = elements.join(pages, ["doc_id", "page"]).filter((F.col("y0") < margin) | (F.col("y1") > F.col("height") - margin))
    norm = F.regexp_replace(F.upper(F.trim("text")), r"[0-9]", "X")
    return near.groupBy("doc_id", norm.alias("norm")).agg(F.countDistinct("page").alias("pages"), F.count("*").alias("elements")).filter(F.col("pages") >= least)


# Texts of margins that are noise on any page, and words that no margin is dropped with.
NOISE = r"PAGE X|CREDIT INFORMATION BUREAU|ALL RIGHTS RESERVED|CONFIDENTIAL|CONSUMER CREDIT INFORMATION"
CRITICAL = r"ACCOUNT|DATE OPENED|DATE CLOSED|SANCTIONED|CURRENT BALANCE|WRITTEN OFF|DAYS PAST DUE|YEAR"


def without_margins(runs: DataFrame, margin: float = 60.0) -> DataFrame:
    """Runs (with page_height) but for headers and footers: noise, and texts (numbers aside) that margins repeat.

    Only what begins in a margin and holds no critical word goes; repeats count in documents of several pages and over
    three bytes. One window by document tells its pages, one by document and text the repeats.
    """
    inside = (F.col("y0") < margin) | (F.col("y0") > F.col("page_height") - margin)
    norm = F.regexp_replace(F.upper(F.trim("text")), "[0-9]+", "X")
    marked = runs.withColumns({"__in": F.coalesce(inside, F.lit(False)), "__norm": norm})
    document = Window.partitionBy("doc_id")
    marked = marked.withColumn("__many", F.min("page").over(document) < F.max("page").over(document)).withColumn("__times", F.count("*").over(Window.partitionBy("doc_id", "__norm", "__in")))
    noise = F.col("__norm").rlike(NOISE) | (F.col("__many") & (F.octet_length("__norm") > 3) & (F.col("__times") > 1))
    dropped = F.col("__in") & ~F.upper("text").rlike(CRITICAL) & noise
    return marked.filter(~F.coalesce(dropped, F.lit(False))).drop("__in", "__norm", "__many", "__times")


def nearest_label(values: DataFrame, labels: DataFrame, most: float | None) -> DataFrame:
    """The label of the same document and row whose center is nearest, at most so far; of equals the first."""
    center = (F.col("x0") + F.col("x1")) / 2
    left = values.select("doc_id", "row", "seq", center.alias("vx"))
    right = labels.select("doc_id", "row", F.col("seq").alias("label_seq"), F.col("text").alias("label"), center.alias("lx"))
    joined = left.join(right, ["doc_id", "row"]).withColumn("gap", F.abs(F.col("vx") - F.col("lx")))
    if most is not None:
        joined = joined.filter(F.col("gap") <= most)
    return joined.groupBy("doc_id", "row", "seq").agg(F.min(F.struct("gap", "label_seq", "label")).alias("m")).select("doc_id", "row", "seq", "m.label", "m.gap")


def regions(elements: DataFrame, starts: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Each element with the start at or above it that is lowest (as-of by height), or null above the first.

    ``also`` names columns of the elements that come along.
    """
    marks = starts.select("doc_id", F.col("y0").alias("y"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("seq"), F.col("start_no").alias("start"))
    rows = elements.select("doc_id", F.col("y0").alias("y"), F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("seq"), F.lit(None).cast(starts.schema["start_no"].dataType).alias("start"), *([F.struct(*also).alias("_also")] if also else []))
    order = Window.partitionBy("doc_id").orderBy("y", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.unionByName(rows, allowMissingColumns=True).withColumn("region", F.max("start").over(order)).filter("kind = 1")
    return found.select("doc_id", "seq", "region", *(["_also.*"] if also else []))


def stacked_pairs(lines: DataFrame) -> DataFrame:
    """A label and the value on the next line of the same page that overlaps it across."""
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "seq")
    following = lines.withColumn("below", F.lead(F.struct("text", "x0", "x1")).over(order))
    across = (F.col("below.x0") < F.col("x1")) & (F.col("below.x1") > F.col("x0"))
    return following.filter(across).select("doc_id", "page", "seq", "text", F.col("below.text").alias("value"))


#: Overlapping column slices of a card: name, from, to (left edge).
SLICES = {"first": (None, 250.0), "second": (250.0, 450.0), "third": (400.0, 580.0), "fourth": (550.0, None)}


def column_slices(elements: DataFrame) -> DataFrame:
    """A row for each slice that an element's left edge lies in; slices overlap."""
    inside = []
    for name, (low, high) in SLICES.items():
        held = F.lit(True)
        if low is not None:
            held &= F.col("x0") >= low
        if high is not None:
            held &= F.col("x0") < high
        inside.append(F.when(held, F.lit(name)))
    return elements.select("doc_id", "seq", F.explode(F.array_compact(F.array(*inside))).alias("slice"))


#: Height of the cells that intervals are dealt into before they are joined.
GRID = 32.0


def _cells(rows: DataFrame, begin: str, end: str) -> DataFrame:
    """A row for each grid cell that an interval touches."""
    cell = lambda x: F.floor(F.col(x) / GRID)
    return rows.withColumn("_from", cell(begin)).withColumn("_cell", F.explode(F.sequence(F.col("_from"), F.greatest("_from", cell(end)))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Pairs of rows with the same keys whose intervals overlap (ends excluded); all columns but the keys differ in name.

    Both sides are repeated for the grid cells that they touch and met there by an equi-join; of the cells that a pair
    shares the one of the later beginning counts. So a document's pairs are tried within a cell, not within the document.
    """
    a, b = _cells(left, *first), _cells(right, *second).withColumnRenamed("_from", "_other")
    met = a.join(b, [*keys, "_cell"]).filter(F.col("_cell") == F.greatest("_from", "_other"))
    return met.filter((F.col(first[0]) < F.col(second[1])) & (F.col(first[1]) > F.col(second[0]))).drop("_cell", "_from", "_other")


def overlapping_right(labels: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements of the same document and page that overlap a label in height and begin right of it."""
    left = labels.select("doc_id", "page", F.col("seq").alias("label_seq"), F.col("y0").alias("ly0"), F.col("y1").alias("ly1"), F.col("x1").alias("lx1"))
    found = overlapping(left, elements.select("doc_id", "page", "seq", "x0", "y0", "y1"), ["doc_id", "page"], ("ly0", "ly1"), ("y0", "y1"))
    return found.filter("x0 >= lx1").select("doc_id", "page", "label_seq", "seq")


def anchored_groups(elements: DataFrame, share: float = 0.4, begin: str = "y0", end: str = "y1") -> DataFrame:
    """Rows of elements: one joins the row whose first element it overlaps in height by more than a share of the taller.
    With ``begin`` and ``end`` x0 and x1 they are columns.

    Each step depends on the row's first element, which no window frame expresses. Documents are dealt out and sorted by
    Spark; a task then reads its elements in order and holds one row's first element only.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, page, number, top, bottom = None, None, 0, 0.0, 0.0
        for part in parts:
            groups = []
            for d, p, a, b in zip(part["doc_id"], part["page"], part[begin], part[end], strict=True):
                if d != doc:
                    doc, page, number = d, None, 0
                if p != page or min(b, bottom) - max(a, top) <= share * max(b - a, bottom - top):
                    number, page, top, bottom = number + 1, p, a, b
                groups.append(number)
            yield part.assign(group=groups)[["doc_id", "seq", "group"]]

    dealt = elements.select("doc_id", "seq", "page", begin, end).repartition("doc_id").sortWithinPartitions("doc_id", "page", begin, "seq")
    return dealt.mapInPandas(fold, "doc_id long, seq long, group long")
