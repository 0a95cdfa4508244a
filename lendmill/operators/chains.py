"""Greedy picks along a line: of rows in order, the first, then the first that begins where the last pick has ended, ...

Rows that no earlier row reaches are picked at once and begin a segment. Inside a segment every row points to the first
row that begins at or beyond its own limit; the picks are the rows that the segment's first one reaches. They are found by
pointer jumping: after r rounds the first 2 ** r picks of every segment are known, so a segment of n rows takes log2(n)
rounds of joins, whatever the rows are; where no row reaches another there are none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendmill.sources.tables import shared_folder


def _table(rows: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    folder = f"{shared_folder(rows.sparkSession)}/chain-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def picked(rows: DataFrame, keys: list[str], start: str, limit: str) -> DataFrame:
    """(keys, place) of the picks among ``rows`` (keys, place, start, limit), in the order of (start, place); limit > start.

    ``place`` tells rows of a key apart.
    """
    order = [F.col(start), F.col("place")]
    along = Window.partitionBy(*keys).orderBy(*order)
    before = F.max(limit).over(along.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.select(*keys, "place", F.col(start).alias("_start"), F.col(limit).alias("_limit"), F.coalesce(F.col(start) >= before, F.lit(True)).alias("_first"))
    named = Window.partitionBy(*keys).orderBy("_start", "place").rowsBetween(Window.unboundedPreceding, 0)
    held = cut.withColumn("_segment", F.sum(F.col("_first").cast("long")).over(named))
    held = _table(held.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_segment"))))
    firsts = held.filter("_first").select(*keys, "place")
    longest = held.agg(F.max("_n")).first()[0] or 1
    if longest < 2:
        return firsts
    some = held.filter("_n > 1")
    group = [*keys, "_segment"]
    points = some.select(*group, F.col("_start").alias("at"), F.lit(1).alias("kind"), "place")
    probes = some.select(*group, F.col("_limit").alias("at"), F.lit(0).alias("kind"), "place")
    onward = Window.partitionBy(*group).orderBy("at", "kind", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = points.unionByName(probes).withColumn("next", F.first(F.when(F.col("kind") == 1, F.col("place")), ignorenulls=True).over(onward))
    jump = _table(found.filter("kind = 0 and next is not null").select(*group, "place", "next"))
    chosen = _table(some.filter("_first").select(*group, "place"))
    for _ in range((longest - 1).bit_length()):
        chosen = _table(chosen.unionByName(chosen.join(jump, [*group, "place"]).select(*group, F.col("next").alias("place"))).distinct())
        after = jump.select(*group, F.col("place").alias("next"), F.col("next").alias("after"))
        jump = _table(jump.join(after, [*group, "next"]).select(*group, "place", F.col("after").alias("next")))
    return firsts.unionByName(chosen.select(*keys, "place")).distinct()
