"""Queries of event streams, run as batches over the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.registry import query
from lendmill.sources.tables import table
from lendmill.streaming import challenges, windows


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("tenant"), "ts")


@query("rate_limit_window", "SELECT user_id % 20 AS tenant, date_trunc('minute', ts) AS begins, count(*) AS requests, greatest(count(*) - 600, 0) AS rejected FROM events GROUP BY ALL")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.request_counts(_requests(spark, sf_dir), 600)


@query("api_key_window", "SELECT user_id % 20 AS tenant, date_trunc('hour', ts) AS begins, count(*) AS requests, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY ALL")
def api_key_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another width and limit for keys of the service."""
    return windows.request_counts(_requests(spark, sf_dir), 2, "1 hour")


@query(
    "otp_challenge_outcome",
    """WITH e AS (SELECT user_id AS key, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'send' WHEN 'click' THEN 'right' ELSE 'wrong' END AS kind FROM events WHERE event_type IN ('signup', 'click', 'error')),
n AS (SELECT *, count(*) FILTER (WHERE kind = 'send') OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS challenge FROM e),
k AS (SELECT *, min(ts) OVER w AS sent, count(*) FILTER (WHERE kind = 'wrong') OVER (PARTITION BY key, challenge ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wrongs FROM n WHERE challenge > 0 WINDOW w AS (PARTITION BY key, challenge)),
d AS (SELECT *, epoch(ts)::BIGINT - epoch(sent)::BIGINT > 864000 AS late FROM k)
SELECT key, challenge, CASE WHEN bool_or(kind = 'right' AND NOT late AND wrongs < 5) THEN 'VERIFIED' WHEN bool_or(kind = 'wrong' AND NOT late AND wrongs >= 5) THEN 'LOCKED' WHEN bool_or(kind <> 'send' AND late) THEN 'EXPIRED' ELSE 'OPEN' END AS status FROM d GROUP BY key, challenge""",
)
def otp_challenge_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Challenges of users who sign up, click and err; ten days to live, as the events are that sparse."""
    kind = F.when(F.col("event_type") == "signup", "send").when(F.col("event_type") == "click", "right").otherwise("wrong")
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "click", "error")).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))
    return challenges.outcomes(events, ttl=864_000).select("key", F.col("challenge").cast("long"), "status")
