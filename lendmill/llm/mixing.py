"""Operator 4, mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Tokens (words) are summed over all documents by cell (source, language, topic). The cells' weights are raked in turn to
the target share of each source, language and topic; a target is given, or the corpus' own share to the power ``power``
(below 1: small groups gain). Rounds over the margins end when none is off by more than ``TOLERANCE`` of all tokens. A
cell's factor, weight over tokens, becomes the probability of its documents: ``factor / largest factor``, the greatest
share of the corpus at which every cell gets its target, so the sample meets all of them in expectation. So that a tiny
cell that ought to grow very much does not shrink all others, factors above ``MOST_FACTOR`` count as that: their cells
are kept whole and get less than their target. A share ``keep`` can be asked for instead: ``min(1, c * factor)`` with the
one ``c`` that keeps it; beyond the greatest share more cells are held at 1. A document stays if a uniform number from the
digest of its id is below its probability, so runs repeat and rows are decided alone.

Cells are few and are raked on the driver up to ``MOST_CELLS``; more are raked by joins, with the lineage cut after
each round. Documents meet their cell's probability in a broadcast join of that many rows at most, else by a shuffle.

Cases: a null source or language counts as an empty one; null and blank texts have the topic ``empty`` and no tokens, a
cell without tokens keeps its documents; rows with the same id share their number, those without id use their text's;
a text of any length is counted whole and lies in one row; an empty table gives an empty one; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmill.llm.tasks import checkpointed

MARGINS = ("source", "lang", "topic")
POWER, MOST_CELLS = 0.9, 100_000
#: Raking ends when no margin is off by more than this share of all tokens, or after so many rounds (targets that
#: contradict each other); the SQL below makes all of them.
TOLERANCE, ROUNDS, MOST_FACTOR = 1e-10, 24, 2.5
WORD = r"[^\x20\x09-\x0D]+"
_CELL = ("_source", "_lang", "_topic")


def topic_of(text: Column) -> Column:
    """A document's kind, by marks that its text holds; the first that fits."""
    return (
        F.when(text.isNull() | (F.length(F.trim(text)) == 0), "empty")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(F.lower(text), F.lit("license")), "legal")
        .when(F.contains(text, F.lit("\n")), "lines")
        .otherwise("prose")
    )


def uniform_of(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the digest of the id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _with_cells(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source", "lang").withColumns(
        {"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit("")), "_topic": topic_of(text), "_tokens": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")}
    )


def _targets(shares: dict[str, float], given: dict[str, float] | None, power: float) -> dict[str, float]:
    wanted = {k: (given.get(k, 0.0) if given is not None else v**power) for k, v in shares.items()}
    total = sum(wanted.values())
    return {k: v / total for k, v in wanted.items()} if total > 0 else shares


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of cells (``tokens`` and a column for each margin) that meet the targets, or after so many rounds."""
    weight = cells["tokens"].to_numpy(np.float64).copy()
    total = weight.sum()
    codes = {m: np.unique(cells[m], return_inverse=True) for m in targets}
    wanted = {m: np.array([targets[m][n] for n in names]) * total for m, (names, _) in codes.items()}
    for _ in range(rounds):
        off = 0.0
        for m, (names, code) in codes.items():
            have, want = np.bincount(code, weights=weight, minlength=len(names)), wanted[m]
            off = max(off, float(np.abs(have - want).max(initial=0)))
            weight *= np.divide(want, have, out=np.zeros(len(names)), where=have > 0)[code]
        if off <= TOLERANCE * total:
            break
    return weight


def calibrated(tokens: np.ndarray, factor: np.ndarray, keep: float | None) -> np.ndarray:
    """min(1, c * factor) that keeps the share of all tokens; None: the greatest share at which no cell (up to MOST_FACTOR) is cut off."""
    if keep is None:
        return np.minimum(1, factor / min(factor.max(), MOST_FACTOR)) if len(factor) and factor.max() > 0 else np.ones(len(factor))
    order = np.argsort(-factor, kind="stable")
    f, t = factor[order], tokens[order].astype(np.float64)
    aim, whole = keep * t.sum(), np.r_[0, np.cumsum(t)]
    part = (t * f).sum() - np.r_[0, np.cumsum(t * f)]
    for k in range(len(f)):  # the k cells with the largest factors are kept whole
        c = (aim - whole[k]) / part[k] if part[k] > 0 else np.inf
        if c * f[k] <= 1:
            return np.minimum(1, max(c, 0) * factor)
    return np.ones(len(factor))


def _raked_by_joins(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, keep: float | None) -> DataFrame:
    """The same for cells beyond the driver's bound."""
    total = cells.agg(F.sum("tokens")).first()[0]
    cells = cells.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds):
        off = 0.0
        for m in MARGINS:
            have = checkpointed(cells.groupBy(f"_{m}").agg(F.sum("w").alias("have")).join(targets[m], f"_{m}"))
            off = max(off, have.agg(F.max(F.abs(F.col("have") - F.col("share") * total))).first()[0] or 0.0)
            ratio = F.when(F.col("have") > 0, F.col("share") * total / F.col("have")).otherwise(0.0)
            cells = cells.join(have.select(f"_{m}", ratio.alias("ratio")), f"_{m}").withColumn("w", F.col("w") * F.col("ratio")).drop("ratio")
        cells = checkpointed(cells)
        if off <= TOLERANCE * (total or 0):
            break
    cells = cells.withColumn("factor", F.col("w") / F.col("tokens"))
    if keep is None:
        most = cells.agg(F.max("factor")).first()[0]
        return cells.select(*_CELL, (F.least(F.lit(1.0), F.col("factor") / min(most, MOST_FACTOR)) if most else F.lit(1.0)).alias("probability"))
    low, high = 0.0, 1.0
    kept = lambda c: cells.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * c))).first()[0]
    while kept(high) < keep * total * (1 - 1e-12) and high < 1e18:
        low, high = high, high * 2
    for _ in range(60):
        c = (low + high) / 2
        low, high = (c, high) if kept(c) < keep * total else (low, c)
    return cells.select(*_CELL, F.least(F.lit(1.0), F.col("factor") * high).alias("probability"))


def with_probabilities(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, keep: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Rows (_row, doc_id, text, source, lang, _source, _lang, _topic, _tokens, probability): _row has all columns of ``docs``.

    ``targets`` gives token shares by margin and name (missing names get none); margins without one are tempered.
    """
    tagged = _with_cells(docs)
    cells = tagged.groupBy(*_CELL).agg(F.sum("_tokens").alias("tokens")).filter("tokens > 0")
    given = targets or {}
    few = cells.limit(MOST_CELLS + 1).toPandas()
    if len(few) <= MOST_CELLS:
        few.columns = [*MARGINS, "tokens"]
        few = few.sort_values(list(MARGINS)).reset_index(drop=True)
        shares = {m: (few.groupby(m)["tokens"].sum() / max(few["tokens"].sum(), 1)).to_dict() for m in MARGINS}
        weight = rake(few, {m: _targets(shares[m], given.get(m), power) for m in MARGINS}, rounds)
        few["probability"] = calibrated(few["tokens"].to_numpy(), weight / few["tokens"].to_numpy(), keep) if len(few) else 1.0
        found = docs.sparkSession.createDataFrame(
            [(*map(str, r[:3]), float(r[4])) for r in few.itertuples(index=False)], "_source string, _lang string, _topic string, probability double"
        )
        found = F.broadcast(found)
    else:
        cells = checkpointed(cells)
        total = cells.agg(F.sum("tokens")).first()[0]
        wanted = {}
        for m in MARGINS:
            share = cells.groupBy(f"_{m}").agg((F.sum("tokens") / total).alias("have"))
            if m in given:
                own = docs.sparkSession.createDataFrame(list(given[m].items()), f"_{m} string, wish double")
                share = share.join(own, f"_{m}", "left").withColumn("wish", F.coalesce("wish", F.lit(0.0)))
            else:
                share = share.withColumn("wish", F.pow("have", F.lit(power)))
            whole = share.agg(F.sum("wish")).first()[0]
            wanted[m] = share.select(f"_{m}", (F.col("wish") / whole).alias("share"))
        found = _raked_by_joins(cells, wanted, rounds, keep)
    return tagged.join(found, list(_CELL), "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    return with_probabilities(docs, **settings).filter(uniform_of(F.col("doc_id"), F.col("text")) < F.col("probability")).select("_row.*")


def mixed_report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability) of the sampled rows."""
    chosen = with_probabilities(docs, **settings).filter(uniform_of(F.col("doc_id"), F.col("text")) < F.col("probability"))
    return chosen.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"))


def _sql() -> str:
    """The same rows in DuckDB's SQL: every round a window over the margin's cells."""
    parts = [
        r"""tagged AS (
    SELECT doc_id, text, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l,
           CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '@') THEN 'contact'
                WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(text, chr(10)) THEN 'lines' ELSE 'prose' END AS t,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n
    FROM documents)""",
        "cells AS (SELECT s, l, t, sum(n)::DOUBLE AS n FROM tagged GROUP BY s, l, t HAVING sum(n) > 0)",
    ]
    for m in "slt":
        parts.append(f"share_{m} AS (SELECT {m}, power(sum(n) / (SELECT sum(n) FROM cells), {POWER}) AS x FROM cells GROUP BY {m})")
        parts.append(f"want_{m} AS (SELECT {m}, x / sum(x) OVER () * (SELECT sum(n) FROM cells) AS want_{m} FROM share_{m})")
    parts.append("w0 AS (SELECT *, n AS w FROM cells JOIN want_s USING (s) JOIN want_l USING (l) JOIN want_t USING (t))")
    k = 0
    for _ in range(ROUNDS):
        for m in "slt":
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * want_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM w{k})")
            k += 1
    parts.append(f"odds AS (SELECT s, l, t, least(1, (w / n) / least(max(w / n) OVER (), {MOST_FACTOR})) AS p FROM w{k})")
    return (
        "WITH "
        + ",\n".join(parts)
        + """
SELECT doc_id, source, lang, t AS topic, n AS n_tokens, round(coalesce(p, 1), 6) AS probability
FROM tagged LEFT JOIN odds USING (s, l, t)
WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::UBIGINT / 4294967296.0 < coalesce(p, 1)"""
    )


SQL = _sql()
