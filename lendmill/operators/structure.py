"""Tagged structure trees: tables with their rows and cells in reading order.

Siblings are numbered once. The walk then goes down level by level from the roots; each level is a join of the last one
with its children, written to the shared folder. The children are dealt and sorted by parent once and kept on disk, so a
level shuffles its own rows only. What lies above a node is carried along in its path, four bytes of sibling number for
each level, and its kinds, a letter for each level. The beginnings of both are those of the nodes above, and order by path
is reading order. A node that no root reaches, such as one of a cycle, is never met; the walk ends at ``DEEPEST`` levels.

Below the walk nothing is joined: nodes and texts are dealt by document once, and texts, pages and numbers come from
windows and one aggregate inside a document, which all spill.

Cases: a null tag is a node without meaning; texts are trimmed and empty ones left out; a row without cells is no row; a
table in a cell is a table of its own, its rows belong to both, and its text to the outer cell too; a node that several
parents name is met once for each; siblings of one ordinal follow each other by node; an empty table gives no rows; a tag
that a document's roles name twice has the last of them in order.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendmill.sources.tables import shared_folder

# Tags, and the deepest level that is read.
TABLE, ROW, CELLS, DEEPEST = "Table", "TR", ("TD", "TH"), 64
#: Letters of kinds, and bytes of a path for each level.
IS_TABLE, IS_ROW, IS_CELL, IS_OTHER, STEP = "T", "R", "C", "-", 4


def _pieces(rows: DataFrame, pieces: int | None) -> int:
    return pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def walked(nodes: DataFrame, roles: DataFrame | None = None, deepest: int = DEEPEST, pieces: int | None = None) -> DataFrame:
    """(doc, node, path, kinds, page) of the nodes below the roots, which have no parent.

    ``nodes`` has (doc, node, parent, ordinal, tag, page), ``roles`` (doc, tag, role) names tags anew; a document's roles
    are few. Children are dealt into ``pieces``. Texts stay out of the walk.
    """
    c = F.col
    if roles is not None:
        named = roles.filter("tag is not null and role is not null").groupBy("doc", "tag").agg(F.max("role").alias("role"))
        named = named.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("tag", "role"))).alias("named"))
        nodes = nodes.join(named.hint("merge"), "doc", "left").withColumn("tag", F.coalesce(F.try_element_at("named", c("tag")), "tag"))
    kind = F.when(c("tag") == TABLE, IS_TABLE).when(c("tag") == ROW, IS_ROW).when(c("tag").isin(*CELLS), IS_CELL).otherwise(IS_OTHER)
    nodes = nodes.select("doc", "node", "parent", F.coalesce("ordinal", F.lit(0)).cast("long").alias("ordinal"), kind.alias("kind"), "page")
    siblings = Window.partitionBy("doc", "parent").orderBy("ordinal", "node")
    step = F.unhex(F.lpad(F.hex(F.row_number().over(siblings)), 2 * STEP, "0"))
    nodes = nodes.repartition(_pieces(nodes, pieces), "doc", "parent").withColumn("step", step).drop("ordinal").persist(StorageLevel.DISK_ONLY)
    spark, folder = nodes.sparkSession, f"{shared_folder(nodes.sparkSession)}/walk-{uuid.uuid4().hex}"
    level = nodes.filter("parent is null").select("doc", "node", c("step").alias("path"), c("kind").alias("kinds"), "page")
    kids = nodes.filter("parent is not null").select("doc", c("parent").alias("node"), c("node").alias("kid"), "step", "kind", "page")
    schema, folders = level.schema, []
    for depth in range(deepest + 1):
        folders.append(f"{folder}/level={depth}")
        level.write.parquet(folders[-1])
        level = spark.read.schema(schema).parquet(folders[-1])
        if level.isEmpty():
            break
        # A small level is not broadcast: its size on disk says little of its rows.
        level = level.drop("page").hint("merge").join(kids, ["doc", "node"]).select(
            "doc", c("kid").alias("node"), F.concat("path", "step").alias("path"), F.concat("kinds", "kind").alias("kinds"), "page"
        )
    nodes.unpersist()
    return spark.read.schema(schema).parquet(*folders)


def _upto(value: str, depth: Column) -> Column:
    """A path down to a depth that counts from 1."""
    return F.substr(value, F.lit(1), depth * STEP)


def _levels(rows: DataFrame, kinds: str, name: str) -> DataFrame:
    """A row for each level of ``kinds``, counted from 1."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.length(kinds))))


def tables(tree: DataFrame, nodes: DataFrame, pieces: int | None = None) -> DataFrame:
    """(doc, table_no, page, row_no, cell_no, text) of the cells of every table of a walked tree, numbered from 1.

    ``nodes`` has the texts (doc, node, text). Both are dealt by document into ``pieces``, once.
    """
    c = F.col
    said = nodes.select("doc", "node", F.trim("text").alias("text")).filter("text <> '' and node is not null")
    both = tree.unionByName(said, allowMissingColumns=True).repartition(_pieces(tree, pieces), "doc")
    both = both.withColumn("text", F.max("text").over(Window.partitionBy("doc", "node"))).filter("path is not null")
    # A cell's text is its own and that of all below it; a table's page its own or the first below it.
    held = _levels(both.filter(c("kinds").rlike(f"[{IS_TABLE}{IS_CELL}]")), "kinds", "upto")
    held = held.withColumns({"kind": F.substr("kinds", c("upto"), F.lit(1)), "own": c("upto") == F.length("kinds")})
    held = held.filter((c("kind") == IS_CELL) & (c("own") | c("text").isNotNull()) | (c("kind") == IS_TABLE) & (c("own") | c("page").isNotNull()))
    held = held.select(
        "doc", _upto("path", c("upto")).alias("holder"), F.substr("kinds", F.lit(1), c("upto")).alias("kinds"), "kind", "path",
        F.when(c("kind") == IS_CELL, c("text")).alias("text"), F.when(c("kind") == IS_TABLE, c("page")).alias("page"),
    )
    held = held.groupBy("doc", "holder", "kinds", "kind").agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY path)").alias("text"), F.min_by("page", F.when(c("page").isNotNull(), c("path"))).alias("page")
    )
    # A cell stands in each row above it that no other cell closes. A table has no row, so that the tables of a document
    # are numbered together, as are the cells of a row.
    is_cell = c("kind") == IS_CELL
    rows = _levels(held, "kinds", "at")
    open_row = (F.substr("kinds", c("at"), F.lit(1)) == IS_ROW) & ~F.substr("kinds", c("at"), F.length("kinds") - c("at")).contains(IS_CELL)
    rows = rows.filter(is_cell & open_row | ~is_cell & (c("at") == F.length("kinds")))
    rows = rows.withColumns({"row": F.when(is_cell, _upto("holder", c("at"))), "kinds": F.substr("kinds", F.lit(1), c("at"))})
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("doc", "row").orderBy("holder")).cast("long"))
    # A row stands in each table above it, behind the table itself, which gives its number and page.
    rows = _levels(rows, "kinds", "table_at")
    rows = rows.filter((F.substr("kinds", c("table_at"), F.lit(1)) == IS_TABLE) & (is_cell | (c("table_at") == c("at")))).withColumn("table", _upto("holder", c("table_at")))
    in_table = Window.partitionBy("doc", "table").orderBy(c("row").asc_nulls_first())
    so_far = in_table.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"table_no": F.first("number").over(so_far), "page": F.first("page").over(so_far), "row_no": (F.dense_rank().over(in_table) - 1).cast("long")})
    return rows.filter(is_cell).select("doc", "table_no", "page", "row_no", c("number").alias("cell_no"), F.coalesce("text", F.lit("")).alias("text"))
