"""Queries of the library and the SQL that gives the same rows; each plans module adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def fold_sql(rows: str, order: str, joins: str, first: str, carry: dict[str, str] | None = None) -> str:
    """Groups of a document's rows: row r joins the group g if ``joins``; ``first`` names the columns of a group's first row.

    ``carry`` has other columns of a group, as they are after a row that joins.
    """
    names = [*first.split(", "), *(carry or {})]
    after = [f"CASE WHEN {joins} THEN {(carry or {}).get(n, 'g.' + n)} ELSE r.{n} END AS {n}" for n in names]
    return (
        f"r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS k FROM ({rows})), g AS (SELECT doc_id, k, seq, 1 AS grp, {', '.join(names)} FROM r WHERE k = 1 "
        f"UNION ALL SELECT r.doc_id, r.k, r.seq, CASE WHEN {joins} THEN grp ELSE grp + 1 END, {', '.join(after)} FROM g JOIN r ON r.doc_id = g.doc_id AND r.k = g.k + 1)"
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name of its own, with its SQL where SQL can express it."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add
