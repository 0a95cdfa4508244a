"""Duplicate documents by exact and normalized content, the first one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and digits that a text needs before its content counts.
LEAST = 200


def content_hash(text: Column) -> Column:
    """Digest of the text in capitals with single spaces; null for short texts."""
    plain = F.upper(F.replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("ß"), F.lit("SS")))
    enough = lambda part: F.length(F.regexp_replace(part, r"[^\p{L}\p{N}]+", "")) >= LEAST
    # The front of a text settles most cases; the whole is counted only where it does not.
    return F.when(enough(F.substring(text, 1, 4 * LEAST)), F.sha2(plain, 256)).when(enough(text), F.sha2(plain, 256))


def image_hash(images: DataFrame) -> DataFrame:
    """(file_id, image_hash) of images (file_id, object_no, data): a digest of lengths and data in order, and their count.

    Numbers are eight bytes, the low one first. The images of one file meet in one row; files without images have none.
    """

    def low_first(n: Column) -> Column:
        digits = F.lpad(F.hex(n.cast("bigint")), 16, "0")
        return F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2)))

    part = F.concat(low_first(F.octet_length("data")), F.hex("data"))
    found = images.filter("data is not null").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("object_no", part.alias("part")))).alias("parts"))
    whole = F.concat(F.array_join(F.transform("parts", lambda p: p["part"]), ""), low_first(F.size("parts")))
    return found.select("file_id", F.sha2(F.unhex(whole), 256).alias("image_hash"))


def file_identity(files: DataFrame, images: DataFrame) -> DataFrame:
    """(file_id, content, image_hash) of files (file_id, text): an image hash counts only where the text has no hash."""
    content = content_hash(F.coalesce("text", F.lit("")))
    return files.select("file_id", content.alias("content")).join(image_hash(images), "file_id", "left").select("file_id", "content", F.when(F.col("content").isNull(), F.col("image_hash")).alias("image_hash"))


def hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sha, content = F.sha2(text, 256), content_hash(text)
    return docs.select("doc_id", sha.alias("sha"), content.alias("content")).withColumn("key", F.coalesce(F.concat(F.lit("c:"), "content"), F.concat(F.lit("s:"), "sha")))


def first_wins(docs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(doc_id, original_id, kind) of every document; ``seen`` has (key, doc_id, sha) of earlier runs' firsts.

    The first of each key comes from a partial aggregate, so a key that most rows share does not meet in one task.
    """
    rows = hashed(docs)
    firsts = rows.select("key", F.lit(1).alias("late"), "doc_id", "sha")
    if seen is not None:
        firsts = firsts.unionByName(seen.select("key", F.lit(0).alias("late"), "doc_id", "sha"))
    first = firsts.groupBy("key").agg(F.min(F.struct("late", "doc_id", "sha")).alias("f")).select("key", F.col("f.doc_id").alias("original_id"), F.col("f.sha").alias("first_sha"))
    kind = F.when(F.col("doc_id") == F.col("original_id"), "New").when(F.col("sha") == F.col("first_sha"), "Exact").otherwise("Content")
    return rows.join(first, "key").select("doc_id", "original_id", kind.alias("kind"))
