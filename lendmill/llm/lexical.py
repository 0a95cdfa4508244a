"""Operator 13, ranked lexical search: a bit-sliced impact index with exact top k.

1. A narrow pass counts the asked terms of every whole text. A row of the postings holds up to ``PIECE`` documents: their
   ids and sizes, and (term, document, occurrences) in term order, as packed integers. Postings are written once to the
   shared folder. Number and size of documents and document frequencies are sums over the pieces.
2. A task joins its pieces to blocks of up to ``BLOCK`` documents in the order of their ids. The impact of a term in a
   document, its weight times the share of its occurrences, is an integer; its bits are cut into slices, one bitmap over
   the block for each bit.
3. An item adds up the slices of its terms by carry-save addition (two bitmaps a bit, three bitwise operations a step; a
   repeated term is added at the places of its count's bits), and one pass of carries at the end. So every document of
   the block is scored by some words of bits, exactly.
4. The top k go down from the most significant slice: documents with the bit come first while they are no more than
   k, else only they stay in question. Ties at the end go by id. A task keeps k of each item; a window
   over (item) ranks those of all tasks.

Items are asked in groups whose (item, term) pairs are about ``MOST_PAIRS``, each group in a pass of its own, so what a
task is given is bounded, however many items there are; within a task ``ITEMS`` items are added up at once.

Cases: a null text, and one without a term, is no document of the collection; an item without a known term has no rows;
repeated rows are documents each, an item that repeats is answered each time; equal scores go by ascending doc_id (no id
comes last); a text of any length is counted as a whole; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendmill.llm.tasks import checkpointed
from lendmill.llm.terms import term_table, terms_of

PIECE, PIECE_POSTINGS, BLOCK = 4096, 1 << 19, 1 << 14
MOST_PAIRS, ITEMS = 1 << 18, 512
# Fixed values of the score: unit of the occurrences' share, part of a document's size in its norm (percent).
UNIT, LENGTH_PART = 1000, 75
WORDS = term_table(digits=True)
POSTINGS = "known binary, ids binary, sizes binary, term binary, doc binary, tf binary, terms array<int>, holders array<int>, documents long, words long"

Slices = np.ndarray


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, repeats) of every item's terms; ``item`` numbers the rows."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, item_id = batch.column("item"), batch.column("item_id")
            counts = [Counter(terms_of(t.as_py(), WORDS)) for t in batch.column("text")]
            owner = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
            terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
            repeats = pa.array([n for c in counts for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([item.take(owner), item_id.take(owner), terms, repeats], ["item", "item_id", "term", "repeats"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return numbered.mapInArrow(run, f"item long, item_id {kind}, term string, repeats long")


def postings(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """Pieces of documents with the occurrences of the wanted terms (term -> number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys = [c.split()[0] for c in POSTINGS.split(", ")], wanted.keys()
        ids, sizes, found = [], [], []

        def made() -> pa.RecordBatch:
            term, doc, tf = np.array(found, np.int64).reshape(-1, 3).T
            order = np.argsort(term, kind="stable")
            term, doc, tf = (x[order].astype("<u4") for x in (term, doc, tf))
            terms, holders = np.unique(term, return_counts=True)
            known = np.array([i is not None for i in ids], bool)
            packed = [known, np.array([i or 0 for i in ids], "<i8"), np.array(sizes, "<i8"), term, doc, tf]
            arrays = [pa.array([x.tobytes()], pa.binary()) for x in packed]
            arrays += [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (terms, holders)]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array([x], pa.int64()) for x in (len(ids), sum(sizes)))], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                terms = terms_of(text.as_py(), WORDS)
                if not terms:
                    continue
                counts, place = Counter(terms), len(ids)
                found += [(wanted[t], place, counts[t]) for t in counts.keys() & keys]
                ids.append(doc_id.as_py())
                sizes.append(len(terms))
                if len(ids) >= PIECE or len(found) >= PIECE_POSTINGS:
                    yield made()
                    ids, sizes, found = [], [], []
        if ids:
            yield made()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


def slices_of(docs: np.ndarray, values: np.ndarray, words: int) -> Slices:
    """Bitmaps (bit, word) of the bits of the values at the documents' places."""
    bits = int(values.max()).bit_length()
    table = np.zeros((bits, words * 64), np.uint8)
    table[:, docs] = (values >> np.arange(bits)[:, None]) & 1
    return np.packbits(table, axis=1, bitorder="little").view("<u8")


class Adder:
    """A sum of slices for every document of a block, kept as two numbers until it is read."""

    def __init__(self, bits: int, words: int):
        self.sum, self.carry = np.zeros((bits, words), np.uint64), np.zeros((bits, words), np.uint64)

    def add(self, slices: Slices, times: int) -> None:
        """Add a term's slices so many times: at each place of a bit of ``times``."""
        place = 0
        while times >> place:
            if times >> place & 1:
                rows = slice(place, place + len(slices))
                either, both = self.sum ^ self.carry, self.sum & self.carry
                both[rows] |= either[rows] & slices
                either[rows] ^= slices
                self.sum, self.carry[1:] = either, both[:-1]
                self.carry[0] = 0
            place += 1

    def slices(self) -> Slices:
        """The sum's own slices, after all carries."""
        carry = np.zeros_like(self.sum[0])
        for i, (a, b) in enumerate(zip(self.sum, self.carry, strict=True)):
            either = a ^ b
            self.sum[i], carry = either ^ carry, (a & b) | (either & carry)
        return self.sum


def ones(bitmap: np.ndarray) -> np.ndarray:
    """Places of the bits of a bitmap."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top(slices: Slices, k: int) -> list[tuple[int, int]]:
    """(score, place) of the k greatest sums above 0; of equal ones the first places."""
    sure, open_ = np.zeros_like(slices[0]), np.bitwise_or.reduce(slices)
    for row in slices[::-1]:
        with_bit = open_ & row
        tried = sure | with_bit
        many = int(np.bitwise_count(tried).sum())
        if many > k:
            open_ = with_bit
        else:
            sure, open_ = tried, open_ & ~row
            if many == k:
                break
    places = np.append(ones(sure), ones(open_))[:k]
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    scores = [0] * len(places)
    for i, row in enumerate(slices):
        for j in np.flatnonzero(row[word] >> bit & np.uint64(1)):
            scores[j] |= 1 << i
    return list(zip(scores, places.tolist(), strict=True))


def impacts(tf: np.ndarray, sizes: np.ndarray, documents: int, words: int) -> np.ndarray:
    """Share of a term's occurrences in documents of so many words, in millionths."""
    norm = np.array([100 - LENGTH_PART + LENGTH_PART * n * documents // words for n in sizes.tolist()], np.int64)
    return lambda doc, count: (count * UNIT**3) // (count * UNIT + 8 * norm[doc])


def search_blocks(pieces: DataFrame, asked: dict[int, dict[int, int]], weights: dict[int, int], documents: int, words: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of each item in each task's documents.

    ``asked``: terms of each item with their repeats; ``weights`` of the terms that a document holds.
    """
    holders: dict[int, dict[int, int]] = {}
    for item, terms in asked.items():
        for term, times in terms.items():
            holders.setdefault(term, {})[item] = times

    def best_of(block: list[dict], best: dict[int, list[tuple]]) -> None:
        column = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in block])
        ids, unknown, sizes = column("ids", "<i8"), ~column("known", bool), column("sizes", "<i8")
        first = np.cumsum([0, *(r["documents"] for r in block[:-1])])
        order = np.lexsort((ids, unknown))
        place = np.argsort(order)
        term, tf = column("term", "<u4"), column("tf", "<u4").astype(np.int64)
        if not len(term):
            return
        doc = column("doc", "<u4").astype(np.int64) + np.repeat(first, [len(r["doc"]) // 4 for r in block])
        by_term = np.argsort(term, kind="stable")
        term, doc, tf = term[by_term], doc[by_term], tf[by_term]
        value, lanes = impacts(tf, sizes, documents, words)(doc, tf), -(-len(ids) // 64)
        numbers, starts = np.unique(term, return_index=True)
        ends = [*starts[1:].tolist(), len(term)]
        ranges = {t: (a, b) for t, a, b in zip(numbers.tolist(), starts.tolist(), ends, strict=True) if t in holders}
        greatest = {t: int(value[a:b].max()) * weights[t] for t, (a, b) in ranges.items()}
        most: dict[int, int] = {}
        for t, bound in greatest.items():
            for item, times in holders[t].items():
                most[item] = most.get(item, 0) + bound * times
        named = sorted(most)
        for some in (named[i : i + ITEMS] for i in range(0, len(named), ITEMS)):
            adders = {item: Adder(max(1, most[item].bit_length()), lanes) for item in some}
            for t, (a, b) in ranges.items():
                users = [(item, times) for item, times in holders[t].items() if item in adders]
                if users:
                    slices = slices_of(place[doc[a:b]], value[a:b] * weights[t], lanes)
                    for item, times in users:
                        adders[item].add(slices, times)
            for item, adder in adders.items():
                found = [(-score, bool(unknown[order[p]]), int(ids[order[p]]), score) for score, p in top(adder.slices(), k)]
                best[item] = sorted(best.get(item, []) + found)[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        block, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                piece = batch.slice(i, 1).to_pylist()[0]
                if block and held + piece["documents"] > BLOCK:
                    best_of(block, best)
                    block, held = [], 0
                block.append(piece)
                held += piece["documents"]
        if block:
            best_of(block, best)
        rows = [(item, None if unknown else doc_id, score) for item, found in best.items() for _, unknown, doc_id, score in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item", "doc_id", "score"])

    return pieces.drop("terms", "holders", "words").mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    terms = checkpointed(item_terms(items))
    groups = max(1, -(-terms.count() // MOST_PAIRS))
    group = F.pmod(F.xxhash64("item"), F.lit(groups)).alias("of")
    found = None
    for number in range(groups):
        asked: dict[int, dict[int, int]] = {}
        wanted: dict[bytes, int] = {}
        for r in terms.select(group, "item", "term", "repeats").filter(F.col("of") == number).collect():
            asked.setdefault(r["item"], {})[wanted.setdefault(r["term"].encode(), len(wanted))] = r["repeats"]
        pieces = checkpointed(postings(docs, wanted))
        documents, words = pieces.agg(F.sum("documents"), F.sum("words")).first()
        if not documents:
            pieces, documents, words = pieces.limit(0), 0, 0
        frequency = pieces.select(F.explode(F.arrays_zip("terms", "holders")).alias("t")).groupBy("t.terms").agg(F.sum("t.holders").alias("n"))
        weights = {r["terms"]: math.floor(UNIT * math.log((2 * documents + 2) / (2 * r["n"] + 1))) for r in frequency.collect()}
        part = search_blocks(pieces, asked, weights, documents, words, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(terms.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS doc,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
d AS (SELECT doc_id, doc, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0),
c AS (SELECT count(*) AS many, CAST(sum(n) AS BIGINT) AS total FROM d),
norm AS (SELECT doc_id, doc, 25 + (75 * n * many) // total AS m FROM d, c),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY doc, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * many + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, many),
asked AS (
    SELECT item, any_value(item_id) AS item_id, term, count(*) AS times
    FROM (SELECT item_id, row_number() OVER () AS item,
                 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark)
    GROUP BY item, term
),
scored AS (
    SELECT item, any_value(item_id) AS item_id, doc, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN norm USING (doc)
    GROUP BY item, doc
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
