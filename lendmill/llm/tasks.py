"""Small Spark helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.sources.tables import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; one in fewer pieces than there are cores is dealt out, as work on texts costs more than moving them."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and rows.rdd.getNumPartitions() < cores else rows


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder; unlike a checkpoint's, its size is known to later plans."""
    folder = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealing_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n shuffle partitions an integer that ``repartition(n, column)`` deals to it, so that dealt keys spread evenly."""
    tried = 16 * n + 256
    found: dict[int, int] = {}
    while len(found) < n:
        place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("place")
        found = dict(tuple(r) for r in spark.range(tried).groupBy(place).agg(F.min("id")).collect())
        tried *= 2
    return np.array([found[i] for i in range(n)], np.int32)


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Labels that are learned at most (the most frequent ones), and how many more rows are drawn than asked for.
MOST_LABELS, SPARE = 1000, 1.3


def training_rows(docs: DataFrame, ids: DataFrame, label: str, per_label: int, also: tuple[str, ...] = ()) -> pd.DataFrame:
    """A bounded sample (text, label, ...): of each label at most the ``per_label`` first ids by a hash of the id.

    ``ids`` has doc_id and the label. Counts by label give the share of the hash's range to draw from, so rows are drawn
    one by one and neither ids nor texts of a label meet in a task; the ids drawn (about ``SPARE`` times the bound) are
    broadcast. A doc_id that repeats counts once, with its smallest text.
    """
    named = ids.select("doc_id", F.col(label).alias("_label")).filter("doc_id is not null and _label is not null")
    counts = named.groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(MOST_LABELS).collect()
    names = [text for text in ("text", *also)]
    if not counts:
        return pd.DataFrame({n: [] for n in (*names, label)})
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40))
    upto = F.create_map(*(F.lit(x) for r in counts for x in (r[0], int(min(1.0, SPARE * per_label / r[1]) * (1 << 40)))))
    drawn = named.withColumn("_place", place).filter(F.col("_place") < F.try_element_at(upto, F.col("_label"))).distinct()
    texts = docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), *also).alias("_t")).join(F.broadcast(drawn), "doc_id")
    found = texts.groupBy("doc_id", "_label", "_place").agg(F.min("_t").alias("_t")).select("_label", "_place", "doc_id", "_t.*").toPandas()
    found = found.sort_values(["_label", "_place", "doc_id"]).groupby("_label", sort=False).head(per_label)
    return found.rename(columns={"_label": label})[[*names, label]].reset_index(drop=True)


class Bitmap:
    """A bitmap of fixed size over mixed 64-bit keys: no false negatives, so what it rejects needs no join."""

    WORDS = 1 << 20

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        word = self.words[((keys >> np.uint64(7)) & np.uint64(self.WORDS - 1)).astype(np.int64)]
        return (word >> ((keys >> np.uint64(1)) & np.uint64(63))) & np.uint64(1) > 0


def bitmap_of(keys: DataFrame) -> Bitmap:
    """The bitmap of a column of mixed keys, made by ``bit_or``: at most ``Bitmap.WORDS`` rows reach the driver."""
    key = F.col(keys.columns[0])
    word = F.shiftrightunsigned(key, 7).bitwiseAND(F.lit(Bitmap.WORDS - 1)).alias("at")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{keys.columns[0]}`, 1) & 63 as int))")
    found = keys.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(Bitmap.WORDS, np.uint64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Bitmap(words)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected edges (u, v), except each component's smallest node.

    Alternating stars: every node's larger neighbours, then its smaller ones, move to the least node that it knows.
    Each round is a few joins; the lineage is cut after each. No component is gathered in a task.
    """
    edges = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
