"""Queries of marked-up texts: rich text, tagged structure, code maps, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators import codemaps, nested, rtf, schema, structure
from lendmill.registry import query
from lendmill.sources.tables import pieces, table, texts

#: Documents in a dealt piece, about: their tokens and pieces are many times as large as their texts.
DOCUMENTS = 1 << 11
#: The same of trees, which are walked level by level, a task a piece each: about 27 nodes a document of ten lines.
TREES = 1 << 13
#: Rich text of a document: sentences are cells and lines are rows, between groups of every kind; some are broken.
#: ~Q~ is a quotation mark, which the two engines escape in their own ways.
_BODY = r"""replace(replace(replace(replace(replace(replace(coalesce(text, ''), '\', '\\'), '{', '\{'), '}', '\}'), '. ', '.\cell '), chr(10), '\par' || chr(10)), ', ', ',{\b\tab}')"""
_KINDS = [
    r"""concat('{\rtf1\ansi{\fonttbl{\f0 Arial;}{\f1 Times\tab New;}}{\*\generator Writer {\b 7};}\f0 ', {b}, '~U~8377? end\par}')""",
    r"""concat('{\rtf1\uc2 ~U~8364\~Q~80x{\uc0 \u233 y}\u-10179 ab\u-8704 cd{\*\bkmk {\b n}{\par}} ', {b}, '}}} after \cell x')""",
    r"""concat('{\rtf1 {\info {\title t}{\pict 89ab} ', {b})""",
    r"""concat('}}{\rtf1 caf\~Q~e9 \~Q~zz\~ \_', chr(10), '{\i\u945\u946\u947 z}\uc3\u1{ab}\u2\u3\u4\u5 q', {b}, '\row\row\sect last\line ~U~55296? ~U~128512 x\')""",
    r"""concat('\*gone', {b})""",
    r"""concat('{\stylesheet', {b}, '}')""",
]
_KINDS = [k.replace("~U~", "\\" + "u") for k in _KINDS]
_SOURCE = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN " + k.replace("{b}", _BODY) for i, k in enumerate(_KINDS)) + " ELSE concat('{\\rtf1 ', " + _BODY + ", '}') END"


def _sql_list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


RTF_SQL = rf"""
WITH RECURSIVE t AS (
    SELECT doc_id AS doc, unnest(g) AS token, generate_subscripts(g, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all(src, '(?s)\\[A-Za-z]+(?:-?[0-9]*) ?|\\''[0-9A-Fa-f]{{2}}|\\[^A-Za-z]|\\$|[{{}}]|[\r\n]+|[^\\{{}}\r\n]+') AS g
          FROM (SELECT doc_id, {_SOURCE.replace("~Q~", "''")} AS src FROM documents))
),
k AS (
    SELECT *, regexp_extract(token, '^\\([A-Za-z]+)', 1) AS word, TRY_CAST(regexp_extract(token, '^\\[A-Za-z]+(-?[0-9]+)', 1) AS INT) AS param,
           token[1] = '\' AS control, token IN ('{{', '}}') AS brace, token[1:2] = '\''' AND length(token) = 4 AS byte
    FROM t
),
f AS (
    SELECT doc, 0::BIGINT AS pos, 0 AS depth, NULL::INT AS hide, 1 AS uc, 0 AS skip, ''::VARCHAR AS piece, ''::VARCHAR AS ends FROM (SELECT DISTINCT doc FROM k)
    UNION ALL
    SELECT doc, pos, depth,
           CASE WHEN hide IS NOT NULL AND depth < hide THEN NULL WHEN names AND hide IS NULL THEN depth ELSE hide END,
           uc, CASE WHEN live AND word = 'u' THEN uc ELSE rest END,
           CASE WHEN hide IS NOT NULL THEN ''
                WHEN NOT control AND NOT brace AND token[1] NOT IN (chr(10), chr(13)) THEN token[lost + 1:]
                WHEN byte AND live THEN chr(CAST('0x' || token[3:] AS INT)) WHEN byte THEN token[lost + 2:]
                WHEN live AND token IN ('\\', '\{{', '\}}') THEN token[2:]
                WHEN live AND word = 'u' AND param IS NOT NULL AND NOT (code BETWEEN 55296 AND 57343) THEN chr(code) ELSE '' END,
           CASE WHEN hide IS NOT NULL OR NOT live THEN '' WHEN word IN ({_sql_list(rtf.ROW_ENDS)}) THEN 'row' WHEN word IN ({_sql_list(rtf.CELL_ENDS)}) THEN 'cell' ELSE '' END
    FROM (
        SELECT *, lost = 0 AS live, CASE WHEN param < 0 THEN param + 65536 ELSE param END AS code, lost = 0 AND (token = '\*' OR word IN ({_sql_list(rtf.DESTINATIONS)})) AS names,
               CASE WHEN lost > 0 THEN d WHEN token = '{{' THEN d + 1 WHEN token = '}}' THEN greatest(d - 1, 0) ELSE d END AS depth,
               CASE WHEN word = 'uc' THEN greatest(coalesce(param, 1), 0) ELSE u END AS uc
        FROM (
            SELECT k.*, f.depth AS d, f.hide, f.uc AS u, least(f.skip, CASE WHEN NOT control AND NOT brace THEN length(token) WHEN byte THEN 3 ELSE 1 END) AS lost,
                   f.skip - least(f.skip, CASE WHEN NOT control AND NOT brace THEN length(token) WHEN byte THEN 3 ELSE 1 END) AS rest
            FROM f JOIN k ON k.doc = f.doc AND k.pos = f.pos + 1
        )
    )
),
n AS (SELECT *, count(*) FILTER (WHERE ends = 'row') OVER w AS line FROM f WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, count(*) FILTER (WHERE ends = 'cell') OVER w AS col FROM n WINDOW w AS (PARTITION BY doc, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT doc, line, col, regexp_replace(string_agg(piece, '' ORDER BY pos), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g') AS text FROM m GROUP BY doc, line, col)
SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY line) AS row_no, col AS "column", text, 40 + col * 90.0 AS x,
       40 + (dense_rank() OVER (PARTITION BY doc ORDER BY line) - 1) * 14.0 AS y, greatest(length(text) * 5.0, 8) AS width, 12.0 AS height
FROM c WHERE text <> ''
"""


@query("src_rtf_runs", RTF_SQL)
def src_rtf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of rich text made from every document."""
    source = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.expr(_SOURCE.replace("\\", "\\\\").replace("~Q~", "\\'")).alias("text"))
    return rtf.text_runs(source, pieces(table(spark, sf_dir, "documents"), DOCUMENTS))


#: Nodes of a document's tree made from its lines: three cells a row, three rows a table, with heads, tables in cells, tags
#: by other names and cycles that no root reaches.
_NODES = """
SELECT doc, 'Z' AS node, CAST(NULL AS STRING) AS parent, 0 AS ordinal, 'StructTreeRoot' AS tag, CAST(NULL AS INT) AS page, CAST(NULL AS STRING) AS text FROM s WHERE i = 0
UNION ALL SELECT doc, 'S', 'Z', 0, 'Sect', CAST(NULL AS INT), '' FROM s WHERE i = 0
UNION ALL SELECT doc, concat('T', CAST(t AS STRING)), CASE WHEN t % 4 = 3 THEN concat('C', CAST(i - 1 AS STRING)) ELSE 'S' END, i,
                 CASE WHEN doc % 5 = 0 THEN 'Tabelle' ELSE 'Table' END, CASE WHEN t % 3 = 0 THEN 100 + t END, '' FROM s WHERE i % 9 = 0
UNION ALL SELECT doc, concat('H', CAST(t AS STRING)), concat('T', CAST(t AS STRING)), 0, 'THead', CAST(NULL AS INT), 'head text' FROM s WHERE i % 9 = 0
UNION ALL SELECT doc, concat('R', CAST(r AS STRING)), CASE WHEN i % 9 = 0 THEN concat('H', CAST(t AS STRING)) ELSE concat('T', CAST(t AS STRING)) END, i, 'TR', CAST(NULL AS INT), CAST(NULL AS STRING)
          FROM s WHERE i % 3 = 0
UNION ALL SELECT doc, concat('C', CAST(i AS STRING)), concat('R', CAST(r AS STRING)), 2 - i % 3, CASE WHEN i % 9 < 2 THEN 'TH' ELSE 'TD' END, CAST(NULL AS INT),
                 CASE WHEN i % 7 = 0 THEN '  own ' END FROM s
UNION ALL SELECT doc, concat('M', CAST(i AS STRING)), concat('C', CAST(i AS STRING)), 1, 'MC', CAST(1 + i % 4 AS INT), line FROM s WHERE i % 11 <> 5
UNION ALL SELECT doc, 'X', 'Y', 0, 'Table', 1, 'x' FROM s WHERE i = 0 AND doc % 6 = 0
UNION ALL SELECT doc, 'Y', 'X', 0, 'TR', 1, 'y' FROM s WHERE i = 0 AND doc % 6 = 0
UNION ALL SELECT doc, concat('E', CAST(t AS STRING)), concat('T', CAST(t AS STRING)), 90000 + i, 'TR', CAST(NULL AS INT), 'no cells' FROM s WHERE i % 9 = 0 AND doc % 4 = 0
"""
_LINES = "CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) // 9 AS t, CAST(i AS BIGINT) // 3 AS r"
#: Those of one line, as the SQL above has them, for one pass over the lines: when, and a node's columns.
_OF_LINE = [
    ("i = 0", "'Z'", "NULL", "0", "'StructTreeRoot'", "NULL", "NULL"),
    ("i = 0", "'S'", "'Z'", "0", "'Sect'", "NULL", "''"),
    ("i % 9 = 0", "concat('T', t)", "CASE WHEN t % 4 = 3 THEN concat('C', i - 1) ELSE 'S' END", "i", "CASE WHEN doc % 5 = 0 THEN 'Tabelle' ELSE 'Table' END", "CASE WHEN t % 3 = 0 THEN 100 + t END", "''"),
    ("i % 9 = 0", "concat('H', t)", "concat('T', t)", "0", "'THead'", "NULL", "'head text'"),
    ("i % 3 = 0", "concat('R', r)", "CASE WHEN i % 9 = 0 THEN concat('H', t) ELSE concat('T', t) END", "i", "'TR'", "NULL", "NULL"),
    ("true", "concat('C', i)", "concat('R', r)", "2 - i % 3", "CASE WHEN i % 9 < 2 THEN 'TH' ELSE 'TD' END", "NULL", "CASE WHEN i % 7 = 0 THEN '  own ' END"),
    ("i % 11 <> 5", "concat('M', i)", "concat('C', i)", "1", "'MC'", "1 + i % 4", "line"),
    ("i = 0 AND doc % 6 = 0", "'X'", "'Y'", "0", "'Table'", "1", "'x'"),
    ("i = 0 AND doc % 6 = 0", "'Y'", "'X'", "0", "'TR'", "1", "'y'"),
    ("i % 9 = 0 AND doc % 4 = 0", "concat('E', t)", "concat('T', t)", "90000 + i", "'TR'", "NULL", "'no cells'"),
]
_TYPES = {"node": "STRING", "parent": "STRING", "ordinal": "BIGINT", "tag": "STRING", "page": "BIGINT", "text": "STRING"}


def _nodes(lines: DataFrame, columns: str) -> DataFrame:
    """Nodes with the named columns of lines (doc, i), which have ``line`` where texts are asked for."""
    rows = lines.selectExpr("doc", *(["line"] if "line" in lines.columns else []), *(x.replace(" // ", " div ") for x in _LINES.split(", ")))
    at = [list(_TYPES).index(n) + 1 for n in columns.split()]
    made = (f"CASE WHEN {kind[0]} THEN named_struct(" + ", ".join(f"'{n}', CAST({kind[k]} AS {_TYPES[n]})" for n, k in zip(columns.split(), at, strict=True)) + ") END" for kind in _OF_LINE)
    return rows.selectExpr("doc", f"inline(array({', '.join(made)}))").filter("node IS NOT NULL")


TREE_SQL = f"""
WITH RECURSIVE s AS (SELECT doc_id AS doc, line, {_LINES} FROM (
    SELECT doc_id, unnest(g) AS line, generate_subscripts(g, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS g FROM documents))),
n AS (SELECT doc, node, parent, {{'o': CAST(ordinal AS BIGINT), 'n': node}} AS place, CASE WHEN tag = 'Tabelle' THEN 'Table' ELSE tag END AS tag, page, trim(text, ' ') AS text FROM ({_NODES})),
w AS (
    SELECT doc, node, [place] AS path, tag, page, text, [0][:0] AS tables, [0][:0] AS rows, [0][:0] AS cells FROM n WHERE parent IS NULL
    UNION ALL
    SELECT n.doc, n.node, list_append(w.path, n.place), n.tag, n.page, n.text, CASE WHEN w.tag = 'Table' THEN list_append(w.tables, len(w.path)) ELSE w.tables END,
           CASE WHEN w.tag IN ('TD', 'TH') THEN [0][:0] WHEN w.tag = 'TR' THEN list_append(w.rows, len(w.path)) ELSE w.rows END,
           CASE WHEN w.tag IN ('TD', 'TH') THEN list_append(w.cells, len(w.path)) ELSE w.cells END
    FROM w JOIN n ON n.doc = w.doc AND n.parent = w.node WHERE len(w.path) <= 64
),
x AS (SELECT doc, cell, string_agg(text, ' ' ORDER BY path) AS text FROM (
    SELECT doc, path, text, path[:unnest(CASE WHEN tag IN ('TD', 'TH') THEN list_append(cells, len(path)) ELSE cells END)] AS cell FROM w WHERE text <> '') GROUP BY doc, cell),
g AS (SELECT doc, tbl, arg_min(page, path) AS page FROM (
    SELECT doc, path, page, path[:unnest(CASE WHEN tag = 'Table' THEN list_append(tables, len(path)) ELSE tables END)] AS tbl FROM w WHERE page IS NOT NULL) GROUP BY doc, tbl),
e AS (SELECT doc, path AS tbl, row_number() OVER (PARTITION BY doc ORDER BY path) AS table_no FROM w WHERE tag = 'Table'),
c AS (SELECT *, row_number() OVER (PARTITION BY doc, row_ ORDER BY cell) AS cell_no FROM (SELECT doc, path AS cell, path[:unnest(rows)] AS row_ FROM w WHERE tag IN ('TD', 'TH'))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, tbl ORDER BY row_) AS row_no FROM (SELECT doc, path AS row_, path[:unnest(tables)] AS tbl FROM w WHERE tag = 'TR')
      WHERE (doc, row_) IN (SELECT (doc, row_) FROM c))
SELECT r.doc, table_no, page, row_no, cell_no, coalesce(x.text, '') AS text
FROM r JOIN e ON e.doc = r.doc AND e.tbl = r.tbl LEFT JOIN g ON g.doc = r.doc AND g.tbl = r.tbl JOIN c ON c.doc = r.doc AND c.row_ = r.row_ LEFT JOIN x ON x.doc = c.doc AND x.cell = c.cell
"""


@query("src_tagged_tables", TREE_SQL)
def src_tagged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the tables of structure trees made from every document's lines."""
    documents, lines = table(spark, sf_dir, "documents"), F.split(F.coalesce("text", F.lit("")), "\n")
    dealt = pieces(documents, TREES, 1)
    # Trees are made from numbers of lines, so only the texts' own pass has lines as rows.
    counted = documents.select(F.col("doc_id").alias("doc"), F.size(lines).alias("n")).repartition(dealt, "doc")
    nodes = _nodes(counted.select("doc", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")), "node parent ordinal tag page")
    said = _nodes(texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(lines).alias("i", "line")), "node text")
    roles = documents.select(F.col("doc_id").alias("doc")).distinct().select("doc", F.lit("Tabelle").alias("tag"), F.lit(structure.TABLE).alias("role"))
    return structure.tables(structure.walked(nodes, roles, pieces=dealt), said, dealt)


#: A map for each nation: single codes and ranges that overlap, lists longer than their range, bad numbers; some have none.
_MAP = (
    "CASE WHEN n_nationkey % 6 = 5 THEN 'no entries' ELSE concat('1 beginbfchar <41> <0391> <0062><00620062> <2F> <D83D> <', "
    "lpad(hex(n_nationkey + 97), 4, '0'), '> <0040', lpad(hex(n_nationkey + 97), 4, '0'), '> <zz> <0041> endbfchar', chr(10), "
    "'2 beginbfrange <30> <39> <0660> <6874> <6874> [<0048> <00540054>] <6F> <72> <FFFE> <70><71> <0050> <7A> <61> <0041> ', "
    "CASE WHEN n_nationkey % 3 = 0 THEN '<61> <7A> <0041>' ELSE '<2E63> <2E63> <0127> <x> <y> <0041> <61> <7A> <0061>' END, ' endbfrange beginbfrange <3A2F> <3A2F> <2014> <D0> <D1> <D7FF> endbfrange') END"
)
_FONT = "page_id % 26"
MAP_SQL = f"""
WITH RECURSIVE maps AS (SELECT n_nationkey AS font, {_MAP} AS map FROM nation),
b AS (SELECT font, 0 AS kind, unnest(regexp_extract_all(map, '(?s)beginbfchar(.*?)endbfchar', 1)) AS body FROM maps
      UNION ALL SELECT font, 1, unnest(regexp_extract_all(map, '(?s)beginbfrange(.*?)endbfrange', 1)) FROM maps),
k AS (SELECT font, kind, row_number() OVER (PARTITION BY font, kind) AS block, regexp_extract_all(body, '\\[(?:<[^>]*>|[^\\]<])*\\]|<[^>]*>') AS t FROM b),
p AS (SELECT font, kind, block, unnest(range(0, len(t) // (2 + kind))) AS nr, t FROM k),
q AS (SELECT font, kind, block, nr, t[nr * (2 + kind) + 1] AS a, t[nr * (2 + kind) + 2] AS z, t[nr * (2 + kind) + 3] AS d FROM p),
h AS (SELECT *, TRY_CAST('0x' || a[2:length(a) - 1] AS BIGINT) AS low, TRY_CAST('0x' || z[2:length(z) - 1] AS BIGINT) AS high FROM q),
stop AS (SELECT font, block, min(nr) AS stop FROM h WHERE kind = 1 AND (low IS NULL OR high IS NULL) GROUP BY font, block),
g AS (SELECT h.* FROM h LEFT JOIN stop ON stop.font = h.font AND stop.block = h.block AND h.kind = 1 WHERE stop.stop IS NULL OR h.nr < stop.stop),
e AS (
    SELECT font, low AS code, z AS d, NULL::BIGINT AS point, (0, block, nr, 0) AS turn FROM g WHERE kind = 0
    UNION ALL SELECT font, code, NULL, base + code - low, (1, block, nr, 0) FROM (SELECT *, unnest(range(low, high + 1)) AS code, TRY_CAST('0x' || d[2:length(d) - 1] AS BIGINT) AS base
        FROM g WHERE kind = 1 AND d[1] = '<' AND high >= low)
    UNION ALL SELECT font, low + i, item, NULL, (1, block, nr, i::INT) FROM (SELECT *, unnest(regexp_extract_all(d, '<[^>]*>')) AS item, generate_subscripts(regexp_extract_all(d, '<[^>]*>'), 1) - 1 AS i
        FROM g WHERE kind = 1 AND d[1] = '[')
),
v AS (SELECT font, code, turn, CASE WHEN d IS NULL THEN [point] ELSE list_transform(regexp_extract_all(d[2:length(d) - 1], '.{{1,4}}'), lambda u: TRY_CAST('0x' || u AS BIGINT)) END AS points FROM e WHERE code IS NOT NULL),
m AS (SELECT font, code, arg_max(shown, turn) AS shown FROM (
    SELECT font, code, turn, array_to_string(list_transform(list_filter(points, lambda x: x IS NOT NULL AND x NOT BETWEEN 55296 AND 57343), lambda x: chr(CAST(x AS INT))), '') AS shown FROM v)
    WHERE shown <> '' GROUP BY font, code),
s AS (SELECT page_id AS id, {_FONT} AS font, url, hex(encode(coalesce(url, ''))) AS h FROM pages),
f AS (
    SELECT id, font, h, 0 AS nr, ''::VARCHAR AS text FROM s WHERE font IN (SELECT font FROM m) AND h <> ''
    UNION ALL
    SELECT f.id, f.font, f.h, f.nr + CASE WHEN two.shown IS NOT NULL THEN 2 ELSE 1 END,
           f.text || coalesce(two.shown, one.shown, chr(CAST('0x' || f.h[f.nr * 2 + 1:f.nr * 2 + 2] AS INT)))
    FROM f LEFT JOIN m two ON two.font = f.font AND f.nr * 2 + 4 <= length(f.h) AND two.code = CAST('0x' || f.h[f.nr * 2 + 1:f.nr * 2 + 4] AS BIGINT)
    LEFT JOIN m one ON one.font = f.font AND one.code = CAST('0x' || f.h[f.nr * 2 + 1:f.nr * 2 + 2] AS BIGINT) WHERE f.nr * 2 < length(f.h)
)
SELECT id AS page_id, text FROM f WHERE nr * 2 >= length(h)
UNION ALL SELECT id, url FROM s WHERE h = '' OR font NOT IN (SELECT font FROM m)
"""


@query("src_code_maps", MAP_SQL)
def src_code_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address read as bytes of a font's codes, by maps made for each nation."""
    maps = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS font", f"{_MAP} AS map")
    shown = table(spark, sf_dir, "pages").selectExpr("page_id AS id", f"{_FONT} AS font", "cast(url AS binary) AS data")
    return codemaps.decoded(shown, maps).select(F.col("id").alias("page_id"), "text")


# A record of depth 6 for each document: lists of maps, names that hold others, numbers under masked names.
_PAN = "concat('ABCPK', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), 'F')"
_BORN = "concat('19', lpad(CAST(doc_id % 90 + 10 AS STRING), 2, '0'), '-05-11')"
_ID = "concat(lpad(CAST(doc_id % 7919 AS STRING), 4, '2'), '-4567-', lpad(CAST(doc_id % 9973 AS STRING), 4, '0'))"
_TEXT = "coalesce(text, '')"


def _record(esc: str, comp: str, pan: str, dob: str, no: str, listed: str, plain: str, name: str = "concat('id ', {no})") -> str:
    """A record's JSON; ``esc`` writes a string, the others say what stands in each place."""
    leaf = f"concat('{{\"pan_cards\":[', {esc}({listed}), ', 5,null,true,[', {esc}({listed}), ']],\"note\":', {esc}({plain}), ',\"UIDAadhaar\":', {esc}({no}), '}}')"
    deep = f"concat('{{\"DOB\":', {esc}({dob}), ', \"n\" : -1.50e3,\"people\":[{{}},', {leaf}, ',[]]}}')"
    return f"concat('{{\"companyName\":', {esc}({comp}), ',\"pan\": ', {esc}({pan}), ',\"dob\":1990,\"list\":[', {esc}({listed}), ',{{\"meta\":', {deep}, '}}],', {esc}({name}), ':\"\"}}')".replace("{{", "{").replace("}}", "}")


_PLAIN_RECORD = {"comp": "concat('Comp ', " + _PAN + ")", "pan": _PAN, "dob": _BORN, "no": _ID, "listed": f"concat({_PAN}, ' born ', {_BORN}, ' ', {_ID}, ' ', {_TEXT})", "plain": f"concat({_PAN}, ' ', {_TEXT})", "name": f"concat('id ', {_ID})"}
_SHORT = "concat(left({x}, 2), '******', right({x}, 2))"
_SCRUB = """regexp_replace(regexp_replace(regexp_replace({x}, '(?i)\\b([A-Z]{{2}})[A-Z]{{3}}[0-9]{{3}}([0-9][A-Z])\\b', '\\1******\\2', 'g'), '\\b([0-9]{{4}}-[0-9]{{2}}-)([0-9]{{2}})\\b', '****-**-\\2', 'g'),
'\\b[0-9]{{4}}[-\\s]?[0-9]{{4}}[-\\s]?([0-9]{{4}})\\b', '****-****-\\1', 'g')"""
_MASKED_RECORD = _PLAIN_RECORD | {
    "comp": _SHORT.format(x=_PLAIN_RECORD["comp"]), "pan": _SHORT.format(x=_PAN), "dob": f"concat('****-**-', right({_BORN}, 2))", "no": f"concat('****-****-', right({_ID}, 4))", "listed": _SCRUB.format(x=_PLAIN_RECORD["listed"]),
}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a JSON record; Spark writes a string's escapes as the first element of a list."""
    made = _record("WRITE", **_PLAIN_RECORD)
    while "WRITE(" in made:
        at = made.index("WRITE(")
        depth, end = 0, at + 5
        for end in range(at + 5, len(made)):
            depth += {"(": 1, ")": -1}.get(made[end], 0)
            if not depth:
                break
        inner = made[at + 6 : end]
        made = f"{made[:at]}substring(to_json(array({inner})), 2, length(to_json(array({inner}))) - 2){made[end + 1:]}"
    return texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(made).alias("json"))


@query("pii_mask_nested", f"SELECT doc_id, sha256({_record('to_json', **_MASKED_RECORD)}) AS masked_sha256 FROM documents")
def pii_mask_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records of all documents masked by name at every depth."""
    return nested.masked(_records(spark, sf_dir), nested.by_name, pieces(table(spark, sf_dir, "documents"), DOCUMENTS)).select(F.col("id").alias("doc_id"), F.sha2("json", 256).alias("masked_sha256"))


@query("pii_redact_nested")
def pii_redact_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records of all documents without identifiers, names too; lookbehind as in pii_redact_lookaround."""
    return nested.masked(_records(spark, sf_dir), nested.everywhere, pieces(table(spark, sf_dir, "documents"), DOCUMENTS)).select(F.col("id").alias("doc_id"), F.col("json").alias("redacted"))


# A computation for each document, with the document's lines as the segments of its raw line.
_COMPUTED = (
    """{"source":"a.pdf","format":"Pdf","regime":null,"assessment_year":{"start":2024,"end":2025},"assessee":{"name":"A","pan":"ABCDE1234F","aadhaar":null},"""
    """"heads":{"salary":{"paise":100,"raw":"1"},"capital_gains":null},"deductions":{"items":[{"section":"80C","label":"l","raw_line":"r","amount":{"paise":5,"raw":"5"}},"""
    """{"section":"80D","label":"m","raw_line":"s"}],"total":null},"tax":{"tax_due":{"paise":0,"raw":"0"}},"credits":{},"raw":{"page_count":2,"lines":[{"page":1,"""
    """"bbox":{"x":0,"y":1.5,"width":10,"height":2},"segments":""",
    ""","segment_boxes":[{"x":0,"y":0,"width":0,"height":0}]}],"table":{"columns":[[0,10.5],[20,30]],"rows":[{"page":1,"cells":[{"text":"t","""
    """"bbox":{"x":1,"y":1,"width":1,"height":1},"column":0},{"text":"u","bbox":{"x":2,"y":1,"width":1,"height":1}}]}]}}}""",
)
#: What is put for what, and the findings (path, keyword).
_BROKEN: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("", "", []),
    ('"source":"a.pdf",', "", [("", "required")]),
    ('"source":"a.pdf"', '"source":""', [("/source", "minLength")]),
    ('"source":"a.pdf"', '"source":7', [("/source", "type")]),
    ('"format":"Pdf"', '"format":"pdf"', [("/format", "enum")]),
    ('"format":"Pdf"', '"format":null', [("/format", "type"), ("/format", "enum")]),
    ('"regime":null', '"regime":false', [("/regime", "type")]),
    ('"regime":null', '"regime":"new","extra":1', [("", "additionalProperties")]),
    ('"start":2024', '"start":1989', [("/assessment_year/start", "minimum")]),
    ('"end":2025', '"end":2102', [("/assessment_year/end", "maximum")]),
    ('"start":2024', '"start":2024.5', [("/assessment_year/start", "type")]),
    ('"start":2024', '"start":2024.0', []),
    ('"start":2024,', "", [("/assessment_year", "required")]),
    ('"assessment_year":{"start":2024,"end":2025}', '"assessment_year":null', []),
    ('"pan":"ABCDE1234F"', '"pan":"ABCDE12345"', [("/assessee/pan", "pattern")]),
    ('"aadhaar":null', '"aadhaar":"1234"', [("/assessee/aadhaar", "enum")]),
    ('"aadhaar":null', '"aadhaar":"[Aadhaar Redacted]"', []),
    ('"name":"A"', '"name":"A","nick":"B"', [("/assessee", "additionalProperties")]),
    ('{"paise":100,"raw":"1"}', '{"paise":1.5,"raw":"1"}', [("/heads/salary/paise", "type")]),
    ('{"paise":100,"raw":"1"}', '{"raw":"1"}', [("/heads/salary", "required")]),
    ('{"paise":100,"raw":"1"}', '"100"', [("/heads/salary", "type")]),
    ('"heads":{', '"heads":{"lottery":null,', [("/heads", "additionalProperties")]),
    ('"section":"80D"', '"section":"8"', [("/deductions/items/1/section", "minLength")]),
    (',"label":"m"', "", [("/deductions/items/1", "required")]),
    ('"label":"l"', '"label":null,"note":0', [("/deductions/items/0", "additionalProperties"), ("/deductions/items/0/label", "type")]),
    ('{"paise":5,"raw":"5"}', '{"paise":5,"raw":5}', [("/deductions/items/0/amount/raw", "type")]),
    ('"items":[', '"items":[3,', [("/deductions/items/0", "type")]),
    ('"tax_due":', '"tax_dew":', [("/tax", "additionalProperties")]),
    ('"credits":{}', '"credits":[]', [("/credits", "type")]),
    ('"page_count":2', '"page_count":-1', [("/raw/page_count", "minimum")]),
    ('"page_count":2,', "", [("/raw", "required")]),
    ('"y":1.5', '"y":"1.5"', [("/raw/lines/0/bbox/y", "type")]),
    ('"width":10,', '"width":-0.5,', [("/raw/lines/0/bbox/width", "minimum")]),
    (',"segment_boxes":[{"x":0,"y":0,"width":0,"height":0}]', ',"segment_boxes":[{"x":0,"y":0,"width":0},9]', [("/raw/lines/0/segment_boxes/0", "required"), ("/raw/lines/0/segment_boxes/1", "type")]),
    ("[[0,10.5],[20,30]]", "[[0],[20,30,40],[1,null]]", [("/raw/table/columns/0", "minItems"), ("/raw/table/columns/1", "maxItems"), ("/raw/table/columns/2/1", "type")]),
    ('"rows":[{"page":1', '"rows":[{"page":0', [("/raw/table/rows/0/page", "minimum")]),
    ('"column":0', '"column":-2', [("/raw/table/rows/0/cells/0/column", "minimum")]),
    ('"column":0', '"column":null', []),
    ('{"text":"u"', '{"txt":"u"', [("/raw/table/rows/0/cells/1", "additionalProperties"), ("/raw/table/rows/0/cells/1", "required")]),
    ('{"x":2,"y":1,"width":1,"height":1}', "null", [("/raw/table/rows/0/cells/1/bbox", "type")]),
    ('"rows":[', '"rows":[{"page":1,"cells":{}},', [("/raw/table/rows/0/cells", "type")]),
    ('"height":1}}]}]}}}', '"height":1}}]}]}}', [("", "json")]),
]


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in values)


@query(
    "income_schema_findings",
    f"""WITH b(kind, path, keyword) AS (VALUES {_rows([(k, *f) for k, (_, _, found) in enumerate(_BROKEN) for f in found])})
SELECT doc_id, path, keyword FROM documents JOIN b ON b.kind = doc_id % {len(_BROKEN)}""",
)
def income_schema_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever breaks the schema of a computation in records made of all documents, tables and boxes included."""
    lines = F.to_json(F.split(F.coalesce("text", F.lit("")), "\n"))
    whole = F.concat(F.lit(_COMPUTED[0]), lines, F.lit(_COMPUTED[1]))
    kind = F.col("doc_id") % len(_BROKEN)
    made = F.col("json")
    for k, (there, put, _) in reversed(list(enumerate(_BROKEN))):
        if there:
            made = F.when(kind == k, F.replace("json", F.lit(there), F.lit(put))).otherwise(made)
    records = texts(spark, sf_dir, "documents").select("doc_id", whole.alias("json"))
    return schema.findings(records.select(F.col("doc_id").alias("id"), made.alias("json")), schema.COMPUTATION).withColumnRenamed("id", "doc_id")
