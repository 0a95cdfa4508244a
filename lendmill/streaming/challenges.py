"""One-time codes: a challenge lives for some time, allows some attempts, and the right code ends it.

The batch form folds each key's events in order; the stream form keeps a key's open challenge as state with a timeout.
Events are (key, ts, seq, kind) with kind ``send``, ``right`` or ``wrong``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS, ATTEMPTS = 300, 5


def outcomes(events: DataFrame, ttl: int = TTL_SECONDS, attempts: int = ATTEMPTS) -> DataFrame:
    """(key, challenge, sent, status) of every challenge: VERIFIED, LOCKED, EXPIRED (a try came late) or OPEN.

    A later ``send`` replaces the challenge before it, so each challenge's tries are those up to the next one: windows
    within a key, no state beyond them.
    """
    order = Window.partitionBy("key").orderBy("ts", "seq")
    numbered = events.withColumn("challenge", F.sum((F.col("kind") == "send").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("challenge > 0")
    within = Window.partitionBy("key", "challenge").orderBy("ts", "seq")
    known = numbered.withColumn("sent", F.first("ts").over(within)).withColumn("wrong_before", F.coalesce(F.sum((F.col("kind") == "wrong").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    late = F.col("ts").cast("timestamp").cast("long") - F.col("sent").cast("timestamp").cast("long") > ttl
    good = (F.col("kind") == "right") & ~late & (F.col("wrong_before") < attempts)
    locked = (F.col("kind") == "wrong") & ~late & (F.col("wrong_before") + 1 >= attempts)
    grouped = known.groupBy("key", "challenge").agg(F.first("sent").alias("sent"), F.bool_or(good).alias("good"), F.bool_or(locked).alias("locked"), F.bool_or((F.col("kind") != "send") & late).alias("late"))
    return grouped.select("key", "challenge", "sent", F.when(F.col("good"), "VERIFIED").when(F.col("locked"), "LOCKED").when(F.col("late"), "EXPIRED").otherwise("OPEN").alias("status"))


def stream_outcomes(events: DataFrame, ttl: int = TTL_SECONDS, attempts: int = ATTEMPTS, late: str = "10 minutes") -> DataFrame:
    """A row for every challenge of a stream that ends: VERIFIED, LOCKED, EXPIRED or REPLACED."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, wrong = state.get if state.exists else (None, 0)
        ended = []
        if state.hasTimedOut:
            ended.append((key[0], sent, "EXPIRED"))
            sent = None
        else:
            rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
            for ts, kind in zip(rows["ts"].astype("int64") // 10**9 if str(rows["ts"].dtype).startswith("datetime64[ns") else rows["ts"].map(lambda t: int(t.timestamp())), rows["kind"], strict=True):
                if sent is not None and ts - sent > ttl:
                    ended.append((key[0], sent, "EXPIRED"))
                    sent = None
                if kind == "send":
                    if sent is not None:
                        ended.append((key[0], sent, "REPLACED"))
                    sent, wrong = int(ts), 0
                elif sent is not None:
                    wrong += kind == "wrong"
                    if kind == "right" or wrong >= attempts:
                        ended.append((key[0], sent, "VERIFIED" if kind == "right" else "LOCKED"))
                        sent = None
        if sent is None:
            if state.exists:
                state.remove()
        else:
            state.update((sent, int(wrong)))
            state.setTimeoutTimestamp(max((sent + ttl) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(ended, columns=["key", "sent", "status"])

    keyed = events.withWatermark("ts", late).groupBy("key")
    return keyed.applyInPandasWithState(step, "key long, sent long, status string", "sent long, wrong long", "append", GroupStateTimeout.EventTimeTimeout)
