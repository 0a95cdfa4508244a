"""Fixed windows over requests, on a batch or a stream of (tenant, ts) alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_counts(requests: DataFrame, limit: int, width: str = "1 minute", late: str | None = None) -> DataFrame:
    """Requests of each tenant in each window and how many of them are over the limit; ``late`` sets a watermark."""
    if late is not None:
        requests = requests.withWatermark("ts", late)
    counted = requests.groupBy("tenant", F.window("ts", width).alias("w")).agg(F.count("*").alias("requests"))
    return counted.select("tenant", F.col("w.start").alias("begins"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))
