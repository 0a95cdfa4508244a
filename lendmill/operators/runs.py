"""Runs of text fragments, first elements of accounts, and payment grids with month labels.

What depends on a group's first or last kept element is read in order, document by document, from rows that Spark has
dealt and sorted; a task holds one element at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendmill.functions.coerce import dpd_token
from lendmill.operators.bureau import MONTHS
from lendmill.operators.layout import overlapping

#: Baselines within a share of the smaller size, sizes within a ratio, gaps within a multiple of the size.
BASELINE, RATIO, GAP = 0.5, 1.6, 1.0


def _in_order(rows: DataFrame, order: list[str], step: Callable[[], Callable[[tuple], object]], columns: list[str], out: str, kind: str) -> DataFrame:
    """``rows`` with a column that a step makes of each row in order; a new step begins with every doc_id."""
    names = list(dict.fromkeys(["doc_id", *order, *columns, *rows.columns]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, own = None, step()
        for part in parts:
            made = []
            for values in zip(part["doc_id"], *(part[c] for c in columns), strict=True):
                if values[0] != doc:
                    doc, own = values[0], step()
                made.append(own(values[1:]))
            yield part.assign(**{out: made})

    dealt = rows.select(*names).repartition("doc_id").sortWithinPartitions("doc_id", *order)
    return dealt.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + f", `{out}` {kind}")


def assemble_runs(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, run, x0, x1, baseline, text) of fragments (doc_id, page, seq, x0, x1, baseline, size, text).

    In the order of emission a fragment joins the run before it if its baseline and size are near the run's first
    fragment's and it begins neither far right of the run nor left of its beginning.
    """

    def step():
        first, right, number = None, 0.0, 0

        def own(values):
            nonlocal first, right, number
            page, x0, x1, baseline, size = values
            near = first is not None and first[0] == page and abs(first[3] - baseline) <= min(first[4], size) * BASELINE and max(first[4], size) / max(min(first[4], size), 0.01) <= RATIO
            if near and x0 - right <= max(size, 1.0) * GAP and x0 >= first[1] - size:
                right = max(right, x1)
            else:
                first, right, number = values, x1, number + 1
            return number

        return own

    numbered = _in_order(fragments, ["page", "seq"], step, ["page", "x0", "x1", "baseline", "size"], "run", "long")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    return numbered.groupBy("doc_id", "page", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min_by("baseline", "seq").alias("baseline"), words.alias("text"))


def line_groups(elements: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, page, line, x0, y0, x1, y1, text) of elements: one joins the line whose first element's center it is near.

    Near is at most a share of the smaller height (1 at least); blank elements are left out.
    """

    def step():
        first, number = None, 0

        def own(values):
            nonlocal first, number
            page, center, height = values
            if first is None or page != first[0] or abs(center - first[1]) > max(min(height, first[2]), 1.0) * share:
                first, number = values, number + 1
            return number

        return own

    shown = elements.filter(F.trim("text") != "").withColumns({"center": (F.col("y0") + F.col("y1")) / 2, "height": F.col("y1") - F.col("y0")})
    numbered = _in_order(shown.select("doc_id", "page", "seq", "x0", "y0", "x1", "y1", "text", "center", "height"), ["page", "center", "x0", "seq"], step, ["page", "center", "height"], "line", "long")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "center", "seq", "text"))), lambda x: F.trim(x["text"])), " ")
    return numbered.groupBy("doc_id", "page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), words.alias("text"))


def account_starts(marks: DataFrame) -> DataFrame:
    """The marks (doc_id, page, y0, seq) that begin an account: not within 100 points below the last kept one on its page,
    and on the next page not within 20 elements of it."""

    def step():
        kept = None

        def own(values):
            nonlocal kept
            page, y0, seq = values
            if kept is not None and (page == kept[0] and y0 - kept[1] < 100.0 or page == kept[0] + 1 and abs(seq - kept[2]) < 20):
                return False
            kept = values
            return True

        return own

    found = _in_order(marks.select("doc_id", "page", "y0", "seq"), ["page", "y0", "seq"], step, ["page", "y0", "seq"], "kept", "boolean")
    return found.filter("kept").drop("kept")


def month_grid(elements: DataFrame, most: float = 20.0, least: int = 3) -> DataFrame:
    """(doc_id, year, month, token): each ``MM-YY`` label of a row of labels with the nearest cell of the row above it.

    A row of labels has at least so many; one right below another has no values.
    """
    label = F.trim("text").rlike(r"^[0-9]{2}-[0-9]{2}$")
    rows = elements.groupBy("doc_id", "row_no").agg((F.count_if(label) >= least).alias("labels"))
    order = Window.partitionBy("doc_id").orderBy("row_no")
    above = rows.select("doc_id", "row_no", "labels", F.lag(F.struct("row_no", "labels")).over(order).alias("above"))
    pairs = above.filter("labels and not above.labels").select("doc_id", "row_no", F.col("above.row_no").alias("value_row"))
    center = (F.col("x0") + F.col("x1")) / 2
    month = F.substring(F.trim("text"), 1, 2).cast("int")
    labels = elements.filter(label & month.between(1, 12)).join(pairs, ["doc_id", "row_no"])
    labels = labels.select("doc_id", "value_row", F.col("seq").alias("label_seq"), center.alias("lx"), (2000 + F.substring(F.trim("text"), 4, 2).cast("int")).alias("year"), F.element_at(F.array(*map(F.lit, MONTHS)), month).alias("month"))
    cells = elements.select("doc_id", F.col("row_no").alias("value_row"), "seq", center.alias("vx"), "text")
    near = labels.join(cells, ["doc_id", "value_row"]).withColumn("gap", F.abs(F.col("vx") - F.col("lx"))).filter(F.col("gap") <= most)
    best = near.groupBy("doc_id", "label_seq", "year", "month").agg(F.min(F.struct("gap", "seq", "text")).alias("m"))
    return best.select("doc_id", "label_seq", "year", "month", dpd_token(F.col("m.text")).alias("token"))


def year_grid(elements: DataFrame, header: DataFrame) -> DataFrame:
    """(doc_id, year, month, token): cells right of a year's cell and level with it, under the month whose center is nearest.

    ``header`` has (doc_id, month_no, x0, x1) of the month names. A year's cell holds nothing else and stands left of all
    months; of several cells under a month the rightmost counts.
    """
    center = (F.col("x0") + F.col("x1")) / 2
    # A document's months are one short array, so that its cells are not paired with each of them.
    months = header.groupBy("doc_id").agg(F.min("x0").alias("begins"), F.collect_set(F.struct(center.alias("mx"), "month_no")).alias("months"))
    years = elements.filter(F.trim("text").rlike(r"^20[0-9]{2}$")).join(months, "doc_id").filter("x0 < begins")
    years = years.select("doc_id", F.trim("text").cast("int").alias("year"), F.col("y0").alias("yy0"), F.col("y1").alias("yy1"), F.col("x1").alias("yx1"), "months")
    cells = elements.select("doc_id", "seq", "x0", center.alias("vx"), "y0", "y1", "text")
    level = overlapping(cells, years, ["doc_id"], ("y0", "y1"), ("yy0", "yy1")).filter("x0 > yx1")
    nearest = F.array_min(F.transform("months", lambda m: F.struct(F.abs(F.col("vx") - m["mx"]).alias("gap"), m["month_no"].alias("month_no"))))
    near = level.select("doc_id", "year", "seq", "x0", "text", nearest.alias("m"))
    last = near.groupBy("doc_id", "year", F.col("m.month_no").alias("month_no")).agg(F.max_by("text", F.struct("x0", "seq")).alias("text"))
    return last.select("doc_id", "year", F.element_at(F.array(*map(F.lit, MONTHS)), F.col("month_no")).alias("month"), dpd_token(F.col("text")).alias("token"))
