"""Rows and cells of rich text: groups, skipped destinations, escapes and fall-back characters by ordered windows.

A text is exploded to its tokens (controls, braces, line ends, literal runs). What a reader would keep as state follows
from running counts over a document's tokens:

- depth is the sum of +1 and -1 of braces, lifted by its running minimum, as a brace too many closes nothing;
- a group ends at the next brace that closes its depth; a starred or skipped destination hides tokens from where it is
  named to that end, so a token is hidden where more such ranges have begun than ended;
- a code point is followed by as many fall-back units as the last ``uc`` says (a character, a control or a brace is one);
  one that is itself a fall-back of another does nothing, which is a greedy pick along the document (``chains.picked``),
  made for the documents in which a code point can be one (``ODD`` finds them by their text);
- rows and cells are counts of the controls that end them.

Windows are over one document and spill; a document's tokens are shuffled once. No text passes through Python.

Cases: null and empty texts, and texts without any shown character, have no runs and are returned by ``without_text``;
missing and surplus braces, a lone backslash and bad hexadecimal escapes are read as above; rows that repeat a doc_id are
told apart by ``doc`` numbers of the rows; a ``uc`` control that is itself a fall-back still counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendmill.functions.coerce import code_point
from lendmill.operators.chains import picked

# Controls that end rows and cells, destinations that are no text, geometry of runs.
ROW_ENDS, CELL_ENDS = ("par", "line", "row", "sect"), ("cell", "nestcell", "tab")
DESTINATIONS = (
    "fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "themedata", "colorschememapping", "latentstyles", "datastore", "rsidtbl", "generator",
    "listtable", "listoverridetable", "xmlnstbl", "filetbl", "revtbl", "upr", "mmathPr", "wgrffmtfilter", "panose", "falt", "listtext", "nonshppict",
)
LEFT, TOP, CELL_WIDTH, LINE_HEIGHT, LINE_GAP, CHARACTER_WIDTH, LEAST_WIDTH = 40.0, 40.0, 90.0, 12.0, 2.0, 5.0, 8.0
TOKEN = r"(?s)\\[A-Za-z]+(?:-?[0-9]*) ?|\\'[0-9A-Fa-f]{2}|\\[^A-Za-z]|\\$|[{}]|[\r\n]+|[^\\{}\r\n]+"


#: Texts in which a code point may be the fall-back of another: they follow each other, or more than one unit falls back.
ODD = r"\\uc0*(?:[2-9]|[1-9][0-9])|\\u-?[0-9]* ?\\u(?![A-Za-z])"
LITERAL, OPENS, CLOSES, BREAK, BYTE, CODE, FALLBACKS, HIDES, ROW, CELL, ESCAPED, OTHER = range(12)


def _dealt(rows: DataFrame, pieces: int | None) -> DataFrame:
    return rows.repartition("doc") if pieces is None else rows.repartition(pieces, "doc")


def tokens(texts: DataFrame, pieces: int | None = None) -> DataFrame:
    """(doc, pos, token, kind, value, units) of (doc, text); units are what a fall-back counts, value a control's number.

    With ``pieces`` texts are dealt into so many; without it Spark joins small ones by bytes, which tokens far outgrow.
    """
    token, word = F.col("token"), F.col("word")
    # Texts are dealt by document before they are exploded: the tokens keep that partitioning for all windows.
    rows = _dealt(texts, pieces).select("doc", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    rows = rows.withColumn("word", F.when(token.startswith("\\"), F.regexp_extract(token, r"^\\([A-Za-z]+)", 1)).otherwise(""))
    kind = (
        F.when(token == "{", OPENS).when(token == "}", CLOSES).when(token.rlike("^[\r\n]"), BREAK).when(~token.startswith("\\"), LITERAL)
        .when(token.startswith("\\'") & (F.length(token) == 4), BYTE).when(word == "u", CODE).when(word == "uc", FALLBACKS)
        .when((token == "\\*") | word.isin(*DESTINATIONS), HIDES).when(word.isin(*ROW_ENDS), ROW).when(word.isin(*CELL_ENDS), CELL)
        .when(token.isin("\\\\", "\\{", "\\}"), ESCAPED).otherwise(OTHER)
    )
    rows = rows.withColumn("kind", kind.cast("tinyint"))
    number = F.regexp_extract(token, r"^\\[A-Za-z]+(-?[0-9]+)", 1).try_cast("int")
    value = F.when(F.col("kind") == CODE, number).when(F.col("kind") == FALLBACKS, F.greatest(F.coalesce(number, F.lit(1)), F.lit(0)))
    units = F.when(F.col("kind").isin(LITERAL, BREAK), F.length(token)).when(F.col("kind") == BYTE, 3).otherwise(1)
    return rows.select("doc", "pos", "token", "kind", value.alias("value"), units.alias("units"))


def _counted(texts: DataFrame, pieces: int | None = None) -> DataFrame:
    """Tokens with the units before and behind them and the fall-backs that hold."""
    along = Window.partitionBy("doc").orderBy("pos")
    rows = tokens(texts, pieces).withColumn("end", F.sum("units").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.last(F.when(F.col("kind") == FALLBACKS, F.col("value")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"start": F.col("end") - F.col("units"), "uc": F.coalesce(held, F.lit(1))})


def placed(rows: DataFrame) -> DataFrame:
    """(doc, pos, piece, ends) of counted tokens with ``done`` code points: pieces of text, and ends of cells and rows."""
    c = F.col
    along = Window.partitionBy("doc").orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    fallback = F.coalesce(F.last(F.when(c("done"), c("end") + c("uc")), ignorenulls=True).over(before), F.lit(0))
    rows = rows.withColumn("lost", F.greatest(F.least(fallback - c("start"), c("units")), F.lit(0))).drop("start", "end", "uc", "units", "done")
    alive = c("lost") == 0
    # Depth: a closing brace below the lowest depth so far closes nothing.
    step = F.when(alive & (c("kind") == OPENS), 1).when(alive & (c("kind") == CLOSES), -1).otherwise(0)
    rows = rows.withColumn("step", step).withColumn("level", F.sum("step").over(upto))
    rows = rows.withColumn("lowest", F.least(F.coalesce(F.min("level").over(before), F.lit(0)), F.lit(0)))
    closes = (c("step") == -1) & (c("level") >= c("lowest"))
    depth = c("level") - F.least("level", "lowest")
    rows = rows.withColumns({"closes": closes, "names": (alive & (c("kind") == HIDES)).cast("int"), "own": F.when(closes, depth + 1).otherwise(depth)}).drop("level", "lowest", "step")
    # A closing brace ends the ranges that were named in its own group: all of its level since the last such brace.
    inside = Window.partitionBy("doc", "own").orderBy("pos")
    rows = rows.withColumn("named", F.sum("names").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ended = F.when(c("closes"), c("named") - F.coalesce(F.last(F.when(c("closes"), c("named")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).otherwise(0)
    rows = rows.withColumn("change", c("names") - ended).withColumn("hidden", F.sum("change").over(upto))
    code = F.when(c("value") < 0, c("value") + 65536).otherwise(c("value"))
    piece = (
        F.when(c("kind") == LITERAL, F.substr("token", (c("lost") + 1).cast("int")))
        .when((c("kind") == BYTE) & alive, code_point(F.conv(F.substr("token", F.lit(3)), 16, 10).cast("int")))
        .when(c("kind") == BYTE, F.substr("token", (c("lost") + 2).cast("int")))
        .when((c("kind") == ESCAPED) & alive, F.substr("token", F.lit(2)))
        .when((c("kind") == CODE) & alive, code_point(code))
    )
    ends = F.when(alive & c("kind").isin(ROW, CELL), c("kind"))
    return rows.filter("hidden = 0").select("doc", "pos", piece.alias("piece"), ends.alias("ends")).filter("piece <> '' or ends is not null")


def _runs(rows: DataFrame) -> DataFrame:
    """The trimmed cells that are not empty, with their rows and columns."""
    c = F.col
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", F.coalesce(F.sum((c("ends") == ROW).cast("int")).over(before), F.lit(0)))
    in_line = Window.partitionBy("doc", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("column", F.coalesce(F.sum((c("ends") == CELL).cast("int")).over(in_line), F.lit(0)))
    pieces = rows.filter("piece is not null").groupBy("doc", "line", "column")
    cells = pieces.agg(F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY pos)").alias("text"))
    cells = cells.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    return cells.withColumn("row_no", F.dense_rank().over(Window.partitionBy("doc").orderBy("line")).cast("long"))


def text_runs(texts: DataFrame, pieces: int | None = None) -> DataFrame:
    """(doc, row_no, column, text, x, y, width, height) of (doc, text): the trimmed cells that are not empty."""
    c = F.col
    odd = F.coalesce(c("text").rlike(ODD), F.lit(False))
    usual = _counted(texts.filter(~odd), pieces).withColumn("done", c("kind") == CODE)
    rare = _counted(texts.filter(odd), pieces)
    codes = rare.filter(c("kind") == CODE).select("doc", c("pos").alias("place"), "start", (c("end") + c("uc")).alias("limit"))
    marks = picked(codes, ["doc"], "start", "limit").select("doc", c("place").alias("pos"), F.lit(True).alias("mark"))
    # Marks come to their tokens by a union, after which one shuffle by document serves all windows.
    marked = _dealt(rare.unionByName(marks, allowMissingColumns=True), pieces)
    done = F.coalesce(F.max("mark").over(Window.partitionBy("doc", "pos")), F.lit(False))
    rare = marked.withColumn("done", done).filter("token is not null").select(*usual.columns)
    cells = _runs(placed(usual)).unionByName(_runs(placed(rare)))
    return cells.select(
        "doc", "row_no", c("column").cast("long").alias("column"), "text", (LEFT + c("column") * CELL_WIDTH).alias("x"),
        (TOP + (c("row_no") - 1) * (LINE_HEIGHT + LINE_GAP)).alias("y"), F.greatest(F.length("text") * CHARACTER_WIDTH, F.lit(LEAST_WIDTH)).alias("width"), F.lit(LINE_HEIGHT).alias("height"),
    )


def without_text(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents that have no run at all: reading them is an error."""
    return texts.select("doc").join(runs.select("doc").distinct(), "doc", "left_anti")
