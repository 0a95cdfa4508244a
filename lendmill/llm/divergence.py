"""Operator 12, source divergence audit: how far the sources of a language differ in their words, by a sort-based stream.

1. A task counts the terms of its documents by (lang, source) and hands on segments: (lang, term, source, first document,
   documents, occurrences), one for each term and group every ``ENTRIES`` different ones. A document lies in one segment
   of a term, so adding up segments gives document frequencies. A hot term or source has one segment a task, not a row a
   document.
2. Segments are repartitioned by (lang, term, source), sorted by (lang, term, source, document) within the partition, and
   a scan of run lengths gives each run's document frequency and occurrences. Python holds one batch and one open run.
3. Terms in at least ``least`` documents of a language are kept, with their sources' occurrences. A task gathers them by
   language, up to ``CELLS`` cells (terms x sources) in all; every such run yields partial sums of the differences of
   each pair of sources, and its first ``ranks`` terms of each source. Sums and ranks over the partials are Spark's.

Shares are parts of a thousand million, with ``ADDED`` occurrences added to every term: ``1 + floor(1e9 * (count + 5) /
(N + 5 V))``, exact for totals below 9e15 (long division by three digits at a time; no product leaves 64 bits).

The driver holds one number for each (lang, source) group. The report itself has a row for each pair of sources of a
language, so that the groups are few wherever the report can be made at all.

Cases: null text, lang and source count as ''; a group whose texts have no terms is reported with pairs; a language
without kept terms has pairs of value 0 and no terms; a language of one source has no pairs; repeated rows and repeated
ids are documents each; a text of any length is counted as a whole; ties are ranked by item in UTF-8 order; an empty
table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendmill.llm.tasks import checkpointed
from lendmill.llm.terms import term_table, terms_of

#: Different (lang, source, term) that a task counts before it hands them on, and cells (terms x sources) of one run.
ENTRIES, CELLS = 1 << 18, 1 << 19
# Fixed values of the report: documents of a language that hold a kept term, ranks of terms, the share's unit, occurrences added.
LEAST, RANKS, UNIT_DIGITS, ADDED = 30, 50, 9, 5
LETTERS = term_table(digits=False)
REPORT = "lang string, source string, part string, item string, value long"


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * (counts + ADDED) / totals)`` without leaving 64 bits."""
    left, found = counts + ADDED, np.zeros(np.broadcast(counts, totals).shape, np.int64)
    for _ in range(UNIT_DIGITS // 3):
        whole, left = np.divmod(left * 1000, totals)
        found = found * 1000 + whole
    return found + 1


def segments(docs: DataFrame) -> DataFrame:
    """(lang, term, source, document, docs, count) of each task's documents; the term '' counts a group's documents."""

    def made(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, held, document) in groups.items():
            terms = pa.array(list(count), pa.binary()).cast(pa.string())
            n = len(terms)
            columns = [pa.repeat(lang, n), terms, pa.repeat(source, n), pa.repeat(document, n), pa.array([held[t] for t in count]), pa.array(count.values())]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter, int]] = {}
        place, entries = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(n) for n in ("text", "lang", "source")), strict=True):
                terms = terms_of(text.as_py(), LETTERS)
                count, held, _ = groups.setdefault((lang.as_py() or "", source.as_py() or ""), (Counter(), Counter(), place))
                before = len(count)
                count.update(terms)
                held.update(set(terms))
                held[b""] += 1
                count[b""] += 0
                entries += len(count) - before
                place += 1
                if entries >= ENTRIES:
                    yield from made(groups)
                    groups, entries = {}, 0
        yield from made(groups)

    schema = pa.schema([(n, pa.string()) for n in ("lang", "term", "source")] + [(n, pa.int64()) for n in ("document", "docs", "count")])
    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, term string, source string, document long, docs long, count long")


def run_lengths(dealt: DataFrame) -> DataFrame:
    """(lang, term, source, docs, count) of each run of equal (lang, term, source) of sorted partitions."""
    keys, sums = ("lang", "term", "source"), ("docs", "count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in keys] + [(n, pa.int64()) for n in sums])
        key, total = None, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n) for n in keys]
            begins = np.ones(batch.num_rows, bool)
            begins[1:] = False
            for c in columns:
                begins[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(begins)
            added = [np.add.reduceat(batch.column(n).to_numpy(), starts) for n in sums]
            first, last = (tuple(c[i].as_py() for c in columns) for i in (0, batch.num_rows - 1))
            if first == key:
                for a, t in zip(added, total, strict=True):
                    a[0] += t
            elif key is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, *total), schema, strict=True)], schema=schema)
            key, total = last, [int(a[-1]) for a in added]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(starts[:-1])) for c in columns), *(pa.array(a[:-1]) for a in added)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, *total), schema, strict=True)], schema=schema)

    return dealt.select(*keys, *sums).mapInArrow(run, "lang string, term string, source string, docs long, count long")


def term_runs(docs: DataFrame) -> DataFrame:
    """Document frequency and occurrences of every (lang, term, source); the term '' has a group's documents."""
    order = ["lang", "term", "source"]
    return run_lengths(segments(docs).repartition(*order).sortWithinPartitions(*order, "document"))


def partials(kept: DataFrame, groups: dict[str, dict[str, int]], ranks: int) -> DataFrame:
    """Partial pairs and terms of kept (lang, term, sources).

    ``groups``: of each language its sources and their occurrences of kept terms.
    """
    sizes = {lang: sum(own.values()) for lang, own in groups.items()}
    names = {lang: sorted(own) for lang, own in groups.items()}
    vocabulary = {r[0]: r[1] for r in kept.groupBy("lang").count().collect()}

    def of_run(lang: str, terms: list[str], counts: list[dict[str, int]]) -> Iterator[pa.RecordBatch]:
        own, added = names[lang], ADDED * vocabulary[lang]
        order = sorted(range(len(terms)), key=lambda i: terms[i].encode())
        terms, counts = [terms[i] for i in order], [counts[i] for i in order]
        table = np.array([[c.get(s, 0) for s in own] for c in counts], np.int64)
        p = shares(table, np.array([groups[lang][s] for s in own], np.int64) + added)
        q = shares(table.sum(1), np.int64(sizes[lang] + added))
        for i, source in enumerate(own):
            apart = np.abs(p - p[:, i : i + 1]).sum(0)
            items, values = [s for s in own if s != source], np.delete(apart, i)
            yield rows(lang, source, "pair", items, values)
            over = np.flatnonzero((table[:, i] > 0) & (p[:, i] > q))
            gain = p[over, i] - q[over]
            best = np.argsort(-gain, kind="stable")[:ranks]
            yield rows(lang, source, "term", [terms[j] for j in over[best]], gain[best])

    def rows(lang: str, source: str, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
        n = len(items)
        columns = [pa.array([x] * n, pa.string()) for x in (lang, source, part)] + [pa.array(items, pa.string()), pa.array(values, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[str], list[dict[str, int]]]] = {}
        cells = 0
        for batch in batches:
            for row in batch.to_pylist():
                terms, counts = held.setdefault(row["lang"], ([], []))
                terms.append(row["term"])
                counts.append({s["source"]: s["count"] for s in row["sources"]})
                cells += len(names[row["lang"]])
                if cells >= CELLS:
                    # The language with the most cells gives way.
                    most = max(held, key=lambda x: len(held[x][0]) * len(names[x]))
                    cells -= len(held[most][0]) * len(names[most])
                    yield from of_run(most, *held.pop(most))
        for lang, run_ in held.items():
            yield from of_run(lang, *run_)

    return kept.select("lang", "term", "sources").mapInArrow(run, REPORT)


def divergence_report(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources by summed difference, terms that a source uses more."""
    runs = checkpointed(term_runs(docs))
    source = F.collect_list(F.struct("source", "count")).alias("sources")
    kept = runs.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), source).filter(F.col("docs") >= least)
    kept = checkpointed(kept)
    found = runs.filter("term = ''").select("lang", "source")
    totals = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.count").alias("n"))
    groups: dict[str, dict[str, int]] = {}
    for r in found.join(totals, ["lang", "source"], "left").collect():
        groups.setdefault(r["lang"], {})[r["source"]] = r["n"] or 0

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each group's pairs with value 0, for languages without a kept term."""
        for batch in batches:
            for row in batch.to_pylist():
                items = [s for s in groups[row["lang"]] if s != row["source"]]
                n = len(items)
                columns = [pa.array([x] * n, pa.string()) for x in (row["lang"], row["source"], "pair")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(items, pa.string()), pa.array([0] * n, pa.int64())], ["lang", "source", "part", "item", "value"])

    parts = partials(kept, groups, ranks).unionByName(found.mapInArrow(others, REPORT))
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
t AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (
    SELECT g.lang, g.source, any_value(v.v) AS v, coalesce(sum(c.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source
    GROUP BY g.lang, g.source
),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS BIGINT) AS p
    FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
q AS (
    SELECT c.lang, c.term, CAST(1 + (1000000000 * (sum(c.n) + 5)) // (any_value(s.total) + 5 * any_value(v.v)) AS BIGINT) AS q
    FROM c JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) s ON s.lang = c.lang JOIN v ON v.lang = c.lang
    GROUP BY c.lang, c.term
),
pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
    FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY a.lang, a.source, b.source
),
term AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
    FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
