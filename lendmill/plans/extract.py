"""Queries of line flags, text grids, uploads and table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators import extract as x
from lendmill.registry import fold_sql, query
from lendmill.sources import layout as s
from lendmill.sources.tables import select_sql, table

_LABELS = ("Tax on 7,00,001 @10%", "Gross Total Income", "Interest on F.D.R. (as per Annexure)", "Annexure", "Deduction u/s 80CCD for pension", "Rebate 87a", "Self-occupied property", "Let out flat", "New regime u/s 115BAC", "Old tax regime chosen", "Net Pay", "u/s 10(13A) exempt", "plain line")
LINE = {
    "doc_id": "l_orderkey",
    "line_no": s.SEQ,
    "label": f"CASE (l_partkey + l_suppkey * 3) % {len(_LABELS)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_LABELS)) + " END",
    "has_amount": "l_partkey % 3 <> 0",
}
LINES_SQL = f"WITH lines AS ({select_sql(LINE, 'lineitem')})"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in LINE.items()))


@query(
    "income_line_flags",
    f"""{LINES_SQL} SELECT label, has_amount, regexp_matches(upper(label), '^TAX ON |EXEMPTION LIMIT :|@(5|10|15|20|30)%') AS slab,
regexp_matches(replace(upper(label), ' ', ''), '{"|".join(x.SUMMARY)}') OR (NOT has_amount AND regexp_matches(replace(upper(label), ' ', ''), '{"|".join(x.HEADINGS)}')) AS boundary,
nullif(upper(regexp_extract(label, '(?i)\\b(80[A-Z]{{1,3}}\\b|87A|89|24\\(b\\)|10\\([0-9]+[A-Z]*\\))', 1)), '') AS code, regexp_matches(upper(label), '{x.TOTALS}') AS total, count(*) AS lines FROM lines GROUP BY ALL""",
)
def income_line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    counted = _lines(spark, sf_dir).groupBy("label", "has_amount").agg(F.count("*").alias("lines"))
    return counted.select("label", "has_amount", x.slab_working(label).alias("slab"), x.block_boundary(label, F.col("has_amount")).alias("boundary"), x.section_code(label).alias("code"), F.upper("label").rlike(x.TOTALS).alias("total"), "lines")


@query(
    "income_regime",
    f"""{LINES_SQL} SELECT doc_id, arg_min(CASE WHEN contains(upper(label), '115BAC') THEN '115BAC (New Tax Regime)' ELSE 'Old Regime' END, line_no) FILTER (WHERE regexp_matches(upper(label), '115BAC|OLD (TAX )?REGIME')) AS regime,
arg_min(CASE WHEN regexp_matches(upper(label), 'SELF[ -]OCC') THEN 'self_occupied' ELSE 'let_out' END, line_no) FILTER (WHERE regexp_matches(upper(label), 'SELF[ -]OCCUPIED|LET[ -]OUT')) AS occupancy FROM lines GROUP BY doc_id""",
)
def income_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return x.first_line_wins(lines, x.regime(F.col("label")), "regime").join(x.first_line_wins(lines, x.occupancy(F.col("label")), "occupancy"), "doc_id")


_BLOCK = "concat('History', chr(10), CAST(2000 + o_orderkey % 25 AS STRING), ' STD | 030 ', CASE o_orderkey % 4 WHEN 0 THEN 'sub' WHEN 1 THEN 'n/a' WHEN 2 THEN '*' ELSE '000' END, ' XXX', chr(10), '  ', CAST(2001 + o_orderkey % 25 AS STRING), ' dbt', chr(10), '1999 STD')"
_NOTE = "concat('REPORT', chr(10), '  Member Name : Holder ', CAST(o_orderkey AS STRING), chr(10), 'score: ', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(600 + o_orderkey % 300 AS STRING) END, chr(10), 'Payslip for the month of ', CASE o_orderkey % 3 WHEN 0 THEN 'March 2024' WHEN 1 THEN 'Sept-2023' ELSE 'none' END)"


@query(
    "grid_text_rows",
    f"""WITH b AS (SELECT o_orderkey AS block_id, unnest(string_split({_BLOCK}, chr(10))) AS line FROM orders), y AS (SELECT block_id, trim(line) AS line, regexp_extract(trim(line), '^(20[0-9]{{2}})', 1) AS year FROM b),
t AS (SELECT block_id, CAST(year AS INT) AS year, list_filter(regexp_split_to_array(line, '[\\s|]+'), lambda t: t <> '' AND t <> year) AS tokens FROM y WHERE year <> ''),
e AS (SELECT block_id, year, unnest(tokens) AS raw, unnest(range(1, len(tokens) + 1)) AS place FROM t)
SELECT block_id, year, ['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC'][place] AS month, CASE WHEN upper(raw) IN ('STD', 'SUB', 'DBT', 'LSS', 'SMA', 'XXX', 'NA', '*') THEN upper(raw) WHEN regexp_matches(raw, '^[0-9]+$') THEN raw END AS token FROM e WHERE place <= 12""",
)
def grid_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.text_grid(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS block_id", f"{_BLOCK} AS block"))


@query("bureau_inline_fields", f"SELECT o_orderkey AS note_id, 'Holder ' || o_orderkey AS member_name, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(600 + o_orderkey % 300 AS VARCHAR) END AS score, CAST(NULL AS VARCHAR) AS missing FROM orders WHERE length({_NOTE}) > 0")
def bureau_inline_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS note_id", f"{_NOTE} AS note")
    return notes.select("note_id", x.inline_field(F.col("note"), "member name").alias("member_name"), x.inline_field(F.col("note"), "SCORE").alias("score"), x.inline_field(F.col("note"), "control").alias("missing"))


@query("payslip_period", "SELECT o_orderkey AS note_id, CASE o_orderkey % 3 WHEN 0 THEN 'Mar' WHEN 1 THEN 'Sep' END AS month, CASE o_orderkey % 3 WHEN 0 THEN 2024 WHEN 1 THEN 2023 END AS year FROM orders")
def payslip_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS note_id", f"{_NOTE} AS note")
    month, year = x.pay_period(F.col("note"))
    return notes.select("note_id", month.alias("month"), year.alias("year"))


@query(
    "layout_label_value_pairs",
    """WITH r AS (SELECT o_orderkey AS row_id, list_filter(['Name', o_orderstatus, 'Prio', o_orderpriority, 'Odd'], lambda c: c <> o_orderstatus OR o_orderkey % 2 = 0) AS cells FROM orders),
p AS (SELECT row_id, cells, unnest(range(0, (len(cells) + 1) // 2)) AS pair_no FROM r) SELECT row_id, CAST(pair_no AS INT) AS pair_no, cells[pair_no * 2 + 1] AS label, cells[pair_no * 2 + 2] AS value FROM p""",
)
def layout_label_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.filter(F.array(F.lit("Name"), "o_orderstatus", F.lit("Prio"), "o_orderpriority", F.lit("Odd")), lambda c: (c != F.col("o_orderstatus")) | (F.col("o_orderkey") % 2 == 0))
    return x.label_value_pairs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), cells.alias("cells")))


ROW = {
    "doc_id": "l_orderkey",
    "row_no": s.SEQ,
    "member": "CASE WHEN l_partkey % 3 <> 0 THEN concat('M', CAST(l_suppkey AS STRING)) END",
    "date_text": "CASE WHEN l_partkey % 3 <> 0 THEN '01/02/2024' END",
    "purpose": "CASE WHEN l_partkey % 7 <> 0 OR l_partkey % 3 = 0 THEN concat('p', CAST(l_partkey AS STRING)) END",
    "amount": "CASE WHEN l_partkey % 3 = 1 THEN l_partkey END",
}


@query(
    "layout_wrapped_purpose",
    f"""WITH rows_ AS ({select_sql(ROW, 'lineitem')}), n AS (SELECT *, sum(CASE WHEN purpose IS NOT NULL AND member IS NULL AND date_text IS NULL AND amount IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry FROM rows_)
SELECT doc_id, entry::BIGINT AS entry, arg_min(member, row_no) AS member, arg_min(date_text, row_no) AS date_text, min(amount) AS amount, coalesce(string_agg(purpose, ' ' ORDER BY row_no), '') AS purpose FROM n WHERE entry > 0 GROUP BY doc_id, entry""",
)
def layout_wrapped_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.fold_wrapped(table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in ROW.items())))


_UPLOAD = (
    "CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN concat('<html>', o_orderpriority) WHEN 2 THEN '%PDF-1.4 /Type /Page cut' ELSE concat('  %PDF-1.7 /Type /Page ', repeat('/Type /Page ', CAST(o_orderkey % 5 AS INT)), "
    "CASE o_orderkey % 13 WHEN 3 THEN '/Encrypt 5 0 R ' WHEN 4 THEN '/Type /Pages /Kids [] /Count 500 ' WHEN 5 THEN '/Length 400000000 ' WHEN 6 THEN '/Length 90000 ' WHEN 7 THEN '/JavaScript (x) /OpenAction ' WHEN 8 THEN '/URI (http) /xfa ' WHEN 9 THEN '/type/Pages/Count 3 /Type /Pages /Count 7 ' WHEN 10 THEN '/EncryptX ' ELSE '' END, "
    "CASE WHEN o_orderkey % 13 = 11 THEN '' ELSE '%%EOF' END) END"
)
_ACTIVE_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(data, '{p}') THEN '{n}' END" for n, p in x.ACTIVE.items()) + "], lambda v: v IS NOT NULL), ',')"


@query(
    "src_firewall_flags",
    f"""WITH u AS (SELECT o_orderkey AS file_id, {_UPLOAD} AS data FROM orders), k AS (SELECT *, length(data) AS size, list_transform(regexp_extract_all(data, '(?is)/Type\\s*/Pages\\b.{{0,200}}?/Count\\s+([0-9]+)', 1), lambda v: CAST(v AS BIGINT)) AS counts,
coalesce(list_sum(list_transform(regexp_extract_all(data, '/Length\\s+([0-9]{{1,12}})\\b', 1), lambda v: CAST(v AS BIGINT))), 0) AS declared FROM u),
p AS (SELECT *, CASE WHEN len(counts) > 0 THEN list_max(counts) ELSE len(regexp_extract_all(data, '(?i)/Type\\s*/Page[^s]')) END AS pages FROM k)
SELECT file_id, CASE WHEN size = 0 THEN 'EMPTY_UPLOAD' WHEN NOT starts_with(ltrim(data), '%PDF-') THEN 'NOT_A_PDF' WHEN NOT contains(data, '%%EOF') THEN 'CORRUPT' WHEN regexp_matches(data, '(?i)/Encrypt\\b') THEN 'ENCRYPTED' WHEN pages = 0 THEN 'CORRUPT' WHEN pages > 120 THEN 'TOO_MANY_PAGES'
WHEN declared > 314572800 OR declared / greatest(size, 1) > 500 THEN 'DECOMPRESSION_BOMB' END AS threat, pages::BIGINT AS pages, {_ACTIVE_SQL} AS active FROM p""",
)
def src_firewall_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS file_id", f"{_UPLOAD} AS data")
    return files.select("file_id", *(c.alias(n) for n, c in x.upload_verdict(F.col("data"), F.octet_length("data")).items()))


@query(
    "report_confidence",
    f"""{s.WITH}, e AS (SELECT doc_id, CASE WHEN l % 6 = 0 THEN 'lost ' || chr(65533) || chr(65533) ELSE text END AS text, CASE WHEN l % 4 <> 0 THEN 0.9 + l % 10 / 97.0 END AS layout FROM (SELECT *, seq AS l FROM elements)),
r AS (SELECT doc_id, sum(strlen(text)) AS whole, sum(length(text) - length(replace(text, chr(65533), ''))) AS lost, avg(layout) AS layout FROM e GROUP BY doc_id),
k AS (SELECT doc_id, (whole - lost) / whole AS c, coalesce(layout, 0.97) AS l, greatest(0.5, 1 - doc_id % 8 * 0.1) AS r FROM r) SELECT doc_id, round(c, 4) AS character, round(l, 4) AS layout, round(r, 4) AS relation, round((c + l + r) / 3, 4) AS overall FROM k""",
)
def report_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.elements(spark, sf_dir)
    text = F.when(F.col("seq") % 6 == 0, F.lit("lost ��")).otherwise(F.col("text"))
    elements = found.select("doc_id", text.alias("text"), F.when(F.col("seq") % 4 != 0, 0.9 + F.col("seq") % 10 / 97.0).alias("layout"))
    return x.confidence(elements, found.select("doc_id", (F.col("doc_id") % 8).alias("mismatches")).distinct())


@query("pii_structure_keys", "SELECT c_custkey AS k, 'account [Aadhaar Redacted]' AS masked_key, CASE WHEN c_custkey % 2 = 0 THEN 'id [Aadhaar Redacted] ok' ELSE 'none' END AS masked_value FROM customer")
def pii_structure_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.lit("4321 8765 "), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    entries = F.create_map(F.concat(F.lit("account "), number), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("id "), number, F.lit(" ok"))).otherwise("none"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(x.redact_map(entries)).alias("masked_key", "masked_value"))


_BANDS_SQL = "bands AS (SELECT DISTINCT doc_id, floor(x0 / 100) * 100 AS x0 FROM elements)"


@query(
    "layout_cell_band",
    f"""{s.WITH}, {_BANDS_SQL} SELECT e.doc_id, e.seq, arg_min(b.x0, abs(e.x0 - b.x0)) AS edge FROM elements e JOIN bands b ON b.doc_id = e.doc_id AND abs(e.x0 - b.x0) <= 6 GROUP BY e.doc_id, e.seq""",
)
def layout_cell_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.elements(spark, sf_dir)
    return x.cells_to_bands(found, found.select("doc_id", (F.floor(F.col("x0") / 100) * 100).cast("double").alias("x0")).distinct())


@query("layout_column_bands", f"{s.WITH}, {fold_sql('SELECT DISTINCT doc_id, x0 AS seq, x0 AS edge FROM elements', 'seq', 'r.edge - g.edge <= 6', 'edge')} SELECT doc_id, seq AS x0, grp AS band, edge FROM g")
def layout_column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands anchored at their first edge."""
    return x.column_bands(s.elements(spark, sf_dir))
