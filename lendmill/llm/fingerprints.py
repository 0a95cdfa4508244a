"""Operator 5, document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each word shingle is hashed once; its high bits name a bin and each of ``BINS`` bins keeps its smallest hash. An empty
bin borrows from a bin that a hash of its own number and of the attempt's number picks, until that one is full
(optimal densification: all documents probe alike, independently for each bin). Of every bin the low ``BITS`` bits are
packed; the likeness of two fingerprints is the share of equal bins, corrected for accidental equality
(``(match - 2**-BITS) / (1 - 2**-BITS)``, not below 0).

``with_next`` pairs each document with the one after it in the order of descending doc_id without gathering the order
in one task: rows are dealt into ranges of the id, one a partition, each range gets a copy of the first row that follows
it, and the order is local from there. The driver holds about ``DRAWN`` ids and one place for each range, never a text.

Cases: null is the empty text; texts without words have the empty fingerprint, alike (1) to each other only; rows with
the same id come in the order of a hash of the text, and a null id after all others; repeated rows are fingerprinted
each and lie in one range; a table of one row follows itself; a text of any length is one block of its task; an empty
table gives no rows; an id that is no number counts as 0 in the order, so such rows come in the order of the hash; extra
columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lendmill.llm.ragged import BLOCK_BYTES, blocks, mix64, shingles, text_bytes, words
from lendmill.llm.tasks import dealing_keys, shuffle_partitions

BINS, BITS = 256, 4
#: Ids drawn for each range when the ranges are laid out.
DRAWN = 60
_U = np.uint64
_NONE = ~_U(0)


def _probes() -> np.ndarray:
    """For each attempt and bin the bin to borrow from."""
    number = np.arange(64 * BINS, dtype=np.uint64)
    return (mix64(number + _U(0xA0761D6478BD642F)) % _U(BINS)).astype(np.int64).reshape(64, BINS)


_PROBES = _probes()


def fingerprints(texts: pa.Array) -> list[bytes]:
    """Packed fingerprint of each text; empty for a text without words."""
    body, offsets = text_bytes(texts)
    _, _, docs, hashes, _ = words(body, offsets)
    values, ends = shingles(docs, hashes, len(texts))
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    table = np.full(len(texts) * BINS, _NONE)
    np.minimum.at(table, owner * BINS + (values >> _U(56)).astype(np.int64), values & _U((1 << 56) - 1))
    table = table.reshape(-1, BINS)
    full = table != _NONE
    some = full.any(axis=1)
    for row in np.flatnonzero(some & ~full.all(axis=1)):
        empty = np.flatnonzero(~full[row])
        for probe in _PROBES:
            source = probe[empty]
            got = full[row, source]
            table[row, empty[got]] = table[row, source[got]]
            empty = empty[~got]
            if not len(empty):
                break
        table[row, empty] = table[row].min()
    low = (table & _U((1 << BITS) - 1)).astype(np.uint8)
    packed = low[:, 0::2] << 4 | low[:, 1::2]
    return [packed[i].tobytes() if some[i] else b"" for i in range(len(texts))]


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard likeness of the shingles behind two fingerprints."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    same = (np.count_nonzero((x ^ y) >> 4 == 0) + np.count_nonzero((x ^ y) & 15 == 0)) / BINS
    chance = 2.0**-BITS
    return float(max(0.0, (same - chance) / (1 - chance)))


def _range(cuts: list[tuple], at) -> F.Column:
    """How many of the ascending cuts lie above a place; a cut of cuts first, so that few are compared."""
    if not cuts:
        return F.lit(0)
    step = int(np.ceil(np.sqrt(len(cuts))))
    literal = lambda some: F.array(*(F.struct(F.lit(k).alias("known"), F.lit(i).cast("long").alias("id"), F.lit(t).cast("long").alias("tie")) for k, i, t in some))
    below = lambda some: F.size(F.filter(some, lambda c: c <= at))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    part = below(literal([p[0] for p in parts[1:]])) if len(parts) > 1 else F.lit(0)
    return F.lit(len(cuts)) - part * step - below(F.element_at(F.array(*map(literal, parts)), part + 1))


def _dealt_to(n: int, keys: np.ndarray):
    """The key that deals a range's rows to a partition of their own."""
    return F.element_at(F.array(*(F.lit(int(k)) for k in keys)), (F.col("range") % n + 1).cast("int"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (range, id, tie, text, extra), to be read range by range in descending (id, tie); an ``extra`` row ends each
    range and holds the row after it (after the last row: the very first)."""
    spark = docs.sparkSession
    # As many ranges as shuffle partitions, or as the input has pieces where these are more.
    n = max(shuffle_partitions(spark), docs.rdd.getNumPartitions())
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").try_cast("long"), F.lit(0)).alias("id"), F.xxhash64("doc_id", text).alias("tie")).alias("at"), text.alias("text"))
    # A draw of about DRAWN ids a range lays out the ranges; every row is dealt whatever they are.
    share = min(1.0, n * DRAWN / max(docs.count(), 1))
    drawn = keyed.select("at").filter(F.pmod(F.xxhash64("at", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    drawn = sorted(tuple(r[0]) for r in drawn.collect())
    cuts = list(dict.fromkeys(drawn[i * len(drawn) // n] for i in range(1, n))) if drawn else []
    dealt = keyed.withColumn("range", _range(cuts, F.col("at")))
    # The first place of each range (one small row a range), and the range that ends with it: the last one before it
    # that is not empty. Only here are all ranges looked at together; the texts of these rows go straight to their range.
    tops = sorted((r[0], tuple(r[1])) for r in dealt.groupBy("range").agg(F.max("at").alias("at")).collect())
    ends = [(number, at, tops[i - 1][0]) for i, (number, at) in enumerate(tops)]
    named = spark.createDataFrame(ends, "range int, at struct<known: boolean, id: long, tie: long>, ends: int")
    first = dealt.join(F.broadcast(named), ["range", "at"]).groupBy(F.col("ends").alias("range")).agg(F.max(F.struct("at", "text")).alias("top"))
    copies = first.select("range", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("top.at").alias("at"), F.col("top.text").alias("text"), F.lit(True).alias("extra"))
    rows = dealt.select("range", "doc_id", "at", "text", F.lit(False).alias("extra")).unionByName(copies)
    key = _dealt_to(n, dealing_keys(spark, n))
    return rows.withColumn("key", key).repartition(n, "key").sortWithinPartitions("range", "extra", F.col("at").desc())


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many characters from the front of the next."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likenesses."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows for all texts but the last, which only follows."""
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        own, other = fingerprints(pa.array(texts, pa.string())), fingerprints(pa.array(changed, pa.string()))
        shown = [base64.b64encode(f).decode() for f in own]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": ids,
                "n_chars": [len(t) for t in texts[:-1]],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                "fingerprint": shown[:-1],
                "edited_fingerprint": [base64.b64encode(f).decode() for f in other],
                "near_edited": [likeness(a, b) for a, b in zip(own, other, strict=False)],
                "near_next": [likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
            },
            schema=pa.schema([("doc_id", arrow), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in blocks(batches):
            for doc_id, text, extra in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("extra").to_pylist(), strict=True):
                texts.append(text)
                held += len(text)
                if extra:
                    yield finish(ids, texts)
                    ids, texts, held = [], [], 0
                    continue
                ids.append(doc_id)
                if held > BLOCK_BYTES and len(ids) > 1:
                    yield finish(ids[:-1], texts)
                    ids, texts, held = ids[-1:], texts[-1:], len(text)

    arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).select("doc_id", "text", "extra").mapInArrow(run, schema)
