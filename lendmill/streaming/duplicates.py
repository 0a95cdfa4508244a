"""Duplicate documents across runs: a persisted index of file, text and image hashes, the first document wins.

Layout of an index folder, tables only:

- ``entries/generation=<name>/prefix=<two digits>``: (kind, key, doc_id, batch), a row for each hash of a first document.
  A batch writes a generation of its own; ``compact`` rewrites all live ones as a single generation.
- ``live/version=<v>``: the names of the generations that make up the index: version 2 n after batch n, 2 n + 1 after
  compaction then. A version is written after its entries, so a batch that fails leaves the version before it in force,
  and one that is run again overwrites its own generation and version with the same rows.
- ``keys/batch=<n>`` and ``out/batch=<n>``: a batch's hashes, and its (doc_id, original_id, kind).

A batch reads only the prefixes that its keys fall in: generation and prefix are partition columns, so the filter prunes
folders before any file is opened. At most ``16 ** PREFIX`` prefixes come to the driver for it.

The three keys of a document are one class: its content hash, else (a text too short to count) its image hash, else its
file hash; files that are equal have equal texts and images, so whoever shares any key shares the class. Equal files
are one row of a partial aggregate before anything is joined; verdicts of files that at least ``LEAST`` rows and a
``HOT``-th of all share (so at most ``HOT`` files) come back by broadcast, all others by a shuffle.

Cases: null text is empty; rows that repeat a first document's id and text are that document; a null doc_id is a document
after all others; an empty batch writes an empty version; a batch number below the last one replays history as it was then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators.duplicates import content_hash

#: Digits of a key's digest that name its partition; when a file counts as one that very many rows share.
PREFIX, LEAST, HOT = 2, 1000, 10_000
#: Strongest first: what a document shares with the first one.
KINDS = ("Exact", "Content", "Image")
ENTRY = "kind string, key string, doc_id {kind}, batch int"


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, content, image, class) of (doc_id, text[, image_hash]); an image counts where the text does not."""
    text = F.coalesce("text", F.lit(""))
    image = F.col("image_hash") if "image_hash" in docs.columns else F.lit(None).cast("string")
    found = docs.select("doc_id", F.sha2(text, 256).alias("sha"), content_hash(text).alias("content"), image.alias("image"))
    found = found.withColumn("image", F.when(F.col("content").isNull(), F.col("image")))
    own = F.coalesce(F.concat(F.lit("c:"), "content"), F.concat(F.lit("i:"), "image"), F.concat(F.lit("s:"), "sha"))
    return found.withColumn("class", own)


def _entries(rows: DataFrame) -> DataFrame:
    """A row for each key of a document: (kind, key, ...)."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in zip(KINDS, ("sha", "content", "image"), strict=True)))
    exploded = rows.select("*", F.explode(pairs).alias("e"))
    return exploded.select(*rows.columns, "e.kind", "e.key").filter("key is not null")


def _prefix(key: Column) -> Column:
    """Digits of a digest of the key, as the keys themselves may be of any form."""
    return F.left(F.md5(key), F.lit(PREFIX))


class DuplicateIndex:
    """The index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.schema = spark, path, ENTRY.format(kind=id_type)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def live(self, before: int | None = None) -> list[str]:
        """Generations of the last version, or of the last one before a batch."""
        rows = self._read("live", "generation string, version int")
        if before is not None:
            rows = rows.filter(F.col("version") < before)
        last = rows.agg(F.max("version")).first()[0]
        return [] if last is None else [r[0] for r in rows.filter(F.col("version") == last).select("generation").collect() if r[0]]

    def entries(self, generations: list[str], prefixes: list[str] | None = None) -> DataFrame:
        rows = self._read("entries", f"{self.schema}, generation string, prefix string").filter(F.col("generation").isin(generations))
        return rows if prefixes is None else rows.filter(F.col("prefix").isin(prefixes))

    def _write(self, rows: DataFrame, generation: str, version: int, generations: list[str]) -> None:
        """Entries of a generation, one file a prefix, then the version that makes them count."""
        dealt = rows.withColumn("prefix", _prefix(F.col("key"))).repartition("prefix")
        dealt.write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/entries/generation={generation}")
        names = self.spark.createDataFrame([(g,) for g in generations] or [(None,)], "generation string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live/version={version}")

    def add(self, docs: DataFrame, number: int) -> DataFrame:
        """(doc_id, original_id, kind) of a batch's documents by all batches before it; its firsts join the index."""
        columns, id_type = ["sha", "content", "image"], docs.schema["doc_id"].dataType
        rows = self._table(keys_of(docs), f"keys/batch={number}")
        own = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "sha")
        files = rows.groupBy(*columns, "class").agg(F.min(own).alias("own"), F.count("*").alias("n"))
        before = self.live(2 * number)
        if before:
            keyed = _entries(files.select(*columns)).select("kind", "key").distinct()
            touched = [r[0] for r in keyed.select(_prefix(F.col("key")).alias("p")).distinct().collect()]
            old = self.entries(before, touched).groupBy("kind", "key").agg(F.min(F.struct("batch", "doc_id")).alias("old"))
            hits = keyed.join(old, ["kind", "key"]).select("kind", "key", F.struct("old.doc_id").alias("old"))
        judged = files.join(files.groupBy("class").agg(F.min("own").alias("first")), "class")
        for c, k in zip(columns, KINDS, strict=True):
            if before:
                judged = judged.join(hits.filter(F.col("kind") == k).select(F.col("key").alias(c), F.col("old").alias(f"old_{c}")), c, "left")
            else:
                judged = judged.withColumn(f"old_{c}", F.lit(None).cast(f"struct<doc_id: {id_type.simpleString()}>"))
        known = [F.col(f"old_{c}") for c in columns]
        within = F.when(F.col("sha") == F.col("first.sha"), "Exact").when(F.col("content").isNotNull(), "Content").otherwise("Image")
        kind = F.coalesce(*(F.when(i.isNotNull(), k) for i, k in zip(known, KINDS, strict=True)), within)
        original = F.coalesce(*known, F.struct("first.doc_id")).alias("original")
        fresh = F.coalesce(*known).isNull() & (F.col("sha") == F.col("first.sha"))
        verdict = judged.select("sha", "class", original, kind.alias("kind"), fresh.alias("fresh"), "n")
        # Verdicts of files that very many rows share are few.
        least = max(LEAST, rows.count() / HOT)
        hot = F.broadcast(verdict.filter(F.col("n") >= least).drop("n"))
        usual = rows.join(hot, ["sha", "class"], "left")
        names = ["doc_id", *columns, "original", "kind", "fresh"]
        rest = usual.filter("kind is null").drop("original", "kind", "fresh").join(verdict.filter(F.col("n") < least).drop("n"), ["sha", "class"])
        both = usual.filter("kind is not null").select(names).unionByName(rest.select(names))
        first = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("original.doc_id"))
        made = both.select("doc_id", F.col("original.doc_id").alias("original_id"), F.when(first, "New").otherwise(F.col("kind")).alias("kind"), *columns)
        made = self._table(made, f"out/batch={number}")
        firsts = made.filter("kind = 'New'").groupBy(*columns).agg(F.min("doc_id").alias("doc_id"))
        name = f"b{number:09d}"
        self._write(_entries(firsts).select("kind", "key", "doc_id", F.lit(number).alias("batch")), name, 2 * number, [*before, name])
        return made.select("doc_id", "original_id", "kind")

    def _table(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows written to a table of the index's folder and read again."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def compact(self) -> None:
        """Rewrite the live generations as one; readers of the version before go on with the old ones."""
        rows = self._read("live", "generation string, version int")
        last, generations = rows.agg(F.max("version")).first()[0], self.live()
        if len(generations) > 1:
            name = f"c{last:09d}"
            self._write(self.entries(generations).drop("generation", "prefix"), name, last | 1, [name])


def keep_index(index_path: str, compact_every: int = 64, id_type: str = "bigint") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: judges each batch by the index and adds its firsts; kinds are in ``out/batch=<n>``."""

    def run(batch: DataFrame, number: int) -> None:
        index = DuplicateIndex(batch.sparkSession, index_path, id_type)
        index.add(batch, number)
        if number % compact_every == compact_every - 1:
            index.compact()

    return run
