"""Queries of income sheets, payslips and positioned text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators import income, layout
from lendmill.registry import fold_sql, query
from lendmill.sources import layout as s
from lendmill.sources.tables import select_sql, table

_SUM = " + ".join(f"coalesce({h}, 0)" for h in income.HEADS)
_COUNT = " + ".join(f"({h} IS NOT NULL)::INT" for h in income.HEADS)
RECONCILE_SQL = f"""{s.WITH}, k AS (SELECT *, {_SUM} AS heads, {_COUNT} AS stated, gross_total - coalesce(deductions_total, 0) AS rest,
tax_due + coalesce(surcharge, 0) + coalesce(cess, 0) + coalesce(interest, 0) - coalesce(rebate, 0) - coalesce(relief, 0) - coalesce(credits, 0) AS due FROM sheets),
f AS (SELECT sheet_id, 'AY_FY_CONSISTENCY' AS rule, CASE WHEN fy_source = 'stated' AND ay_start - fy_start <> 1 THEN 'error' ELSE 'skipped' END AS severity, CAST(NULL AS BIGINT) AS expected, CAST(NULL AS BIGINT) AS actual FROM k
UNION ALL SELECT sheet_id, 'GTI_EQUALS_HEADS', CASE WHEN stated > 0 AND abs(heads - gross_total) > 100 THEN 'error' ELSE 'skipped' END, heads, gross_total FROM k
UNION ALL SELECT sheet_id, 'TTI_EQUALS_GTI_MINUS_VIA', CASE WHEN abs(rest - total_income) > 100 AND NOT (abs(rest - total_income) < 1000 AND total_income % 1000 = 0) THEN 'error' ELSE 'skipped' END, rest, total_income FROM k
UNION ALL SELECT sheet_id, 'VIA_ITEMS_SUM_TO_TOTAL', 'warning', NULL, NULL FROM k WHERE deduction_items > 0 AND abs(deduction_items - deductions_total) > 100 AND gross_total IS NOT NULL AND total_income IS NOT NULL
UNION ALL SELECT sheet_id, 'NET_TAX_RECONCILES', CASE WHEN abs(due - net_tax) > 100 THEN 'warning' ELSE 'skipped' END, due, net_tax FROM k)"""


@query("income_reconcile", f"{RECONCILE_SQL} SELECT sheet_id, rule, severity, CASE WHEN severity <> 'skipped' THEN expected END::BIGINT AS expected, CASE WHEN severity <> 'skipped' THEN actual END::BIGINT AS actual FROM f")
def income_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return income.reconcile(s.sheets(spark, sf_dir))


@query("income_finding_counts", f"{RECONCILE_SQL} SELECT rule, severity, count(*) AS sheets FROM f GROUP BY ALL")
def income_finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return income.reconcile(s.sheets(spark, sf_dir)).groupBy("rule", "severity").agg(F.count("*").alias("sheets"))


@query("income_heads_sums", f"{s.WITH} SELECT sheet_id, ({_SUM})::BIGINT AS heads, ({_COUNT})::INT AS stated FROM sheets")
def income_heads_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, count = income.stated_heads()
    return s.sheets(spark, sf_dir).select("sheet_id", total.alias("heads"), count.alias("stated"))


HEAD_SQL = """CASE WHEN regexp_matches(replace(upper(label), ' ', ''), 'INCOMEFROMSALAR|SALARYINCOME') THEN 'salary' WHEN contains(replace(upper(label), ' ', ''), 'HOUSEPROPERTY') THEN 'house_property'
WHEN regexp_matches(replace(upper(label), ' ', ''), 'BUSINESS|PROFESSION') THEN 'business' WHEN contains(replace(upper(label), ' ', ''), 'CAPITALGAIN') THEN 'capital_gains' WHEN contains(replace(upper(label), ' ', ''), 'OTHERSOURCE') THEN 'other_sources' END"""
_FIRSTS = ", ".join(f"arg_min(paise, line_no) FILTER (WHERE head = '{h}') AS {h}" for h in income.HEADS)


@query("income_head_totals", f"{s.WITH} SELECT doc_id, {_FIRSTS} FROM (SELECT *, {HEAD_SQL} AS head FROM lines) WHERE head IS NOT NULL AND paise IS NOT NULL GROUP BY doc_id")
def income_head_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return income.head_totals(s.lines(spark, sf_dir))


# Long sheets: a head is about every 40th line, so that blocks end by heads, boundaries and length.
_SHEET_LINE = {
    "doc_id": "l_suppkey", "line_no": s.SEQ, "paise": "CASE WHEN l_orderkey % 5 <> 0 THEN CAST(floor(l_extendedprice) AS BIGINT) * 100 END",
    "label": "CASE l_partkey * 7 % 200 WHEN 0 THEN 'Income from Salaries' WHEN 1 THEN 'Income from House Property' WHEN 2 THEN 'Profits of Business' WHEN 3 THEN 'Capital Gains' WHEN 4 THEN 'Income from Other Sources' "
    "WHEN 5 THEN 'Gross Total Income' WHEN 6 THEN 'Details of rent' WHEN 7 THEN 'Dividend' WHEN 8 THEN 'Dividend' WHEN 9 THEN 'Basic pay' ELSE concat('Item ', CAST(l_partkey % 50 AS STRING)) END",
}


@query(
    "income_components",
    f"""WITH lines AS ({select_sql(_SHEET_LINE, "lineitem")}), n AS (SELECT *, {HEAD_SQL} AS own, label = 'Gross Total Income' OR label = 'Details of rent' AND paise IS NULL AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM lines),
o AS (SELECT *, max(place) FILTER (WHERE own IS NOT NULL OR stop) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS start FROM n),
h AS (SELECT o.doc_id, o.label, o.line_no, o.paise, m.own AS head FROM o JOIN n m ON m.doc_id = o.doc_id AND m.place = o.start WHERE o.own IS NULL AND NOT o.stop AND m.own IS NOT NULL AND o.place - o.start <= 40
AND (o.paise IS NOT NULL OR o.label = 'Dividend' AND m.own = 'other_sources' OR o.label = 'Basic pay' AND m.own = 'salary'))
SELECT doc_id, head, label, min(line_no) AS line_no, arg_min_null(paise, line_no) AS paise FROM h GROUP BY doc_id, head, label""",
)
def income_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return income.components(table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in _SHEET_LINE.items())))


_MARKERS = {"EARNINGS": "earning", "DEDUCTIONS": "deduction"}
SECTIONS_SQL = """opened AS (SELECT *, CASE WHEN contains(upper(label), 'EARNINGS') THEN 'earning' WHEN contains(upper(label), 'DEDUCTIONS') THEN 'deduction' END AS marker FROM lines),
sectioned AS (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM opened)"""


@query("payslip_section_items", f"{s.WITH}, {SECTIONS_SQL} SELECT doc_id, line_no, label, paise, section FROM sectioned WHERE marker IS NULL AND section IS NOT NULL")
def payslip_section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return income.sections(s.lines(spark, sf_dir), _MARKERS)


@query(
    "payslip_balance",
    f"""{s.WITH}, k AS (SELECT doc_id AS slip_id, line_no, paise, CASE label WHEN 'Basic pay' THEN 'earning' WHEN 'Interest' THEN 'deduction' WHEN 'Gross Total Income' THEN 'gross' WHEN 'DEDUCTIONS' THEN 'total_deductions' WHEN 'EARNINGS' THEN 'net' END AS section FROM lines),
t AS (SELECT slip_id, coalesce(sum(paise) FILTER (WHERE section = 'earning'), 0)::BIGINT AS earnings, coalesce(sum(paise) FILTER (WHERE section = 'deduction'), 0)::BIGINT AS deductions,
arg_min(paise, line_no) FILTER (WHERE section = 'gross' AND paise IS NOT NULL) AS gross, arg_min(paise, line_no) FILTER (WHERE section = 'total_deductions' AND paise IS NOT NULL) AS total_deductions, arg_min(paise, line_no) FILTER (WHERE section = 'net' AND paise IS NOT NULL) AS net FROM k GROUP BY slip_id)
SELECT *, gross - total_deductions = net AS balances FROM t""",
)
def payslip_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("label") == "Basic pay", "earning").when(F.col("label") == "Interest", "deduction").when(F.col("label") == "Gross Total Income", "gross").when(F.col("label") == "DEDUCTIONS", "total_deductions").when(F.col("label") == "EARNINGS", "net")
    lines = s.lines(spark, sf_dir).filter("paise is not null or label not in ('Gross Total Income', 'DEDUCTIONS', 'EARNINGS')")
    known = lines.select(F.col("doc_id").alias("slip_id"), "line_no", "paise", kind.alias("section"))
    slips = s.lines(spark, sf_dir).select(F.col("doc_id").alias("slip_id")).distinct()
    found = slips.join(income.payslip_totals(known), "slip_id", "left")
    return found.fillna(0, ["earnings", "deductions"])


@query(
    "layout_bands",
    f"""{s.WITH}, m AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM elements),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR y0 > before + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM m)
SELECT doc_id, page, band::BIGINT AS band, min(y0) AS top, max(y1) AS bottom, count(*) AS elements FROM b GROUP BY ALL""",
)
def layout_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bands(s.dealt_elements(spark, sf_dir), 20.0).groupBy("doc_id", "page", "band").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.count("*").alias("elements"))


@query("layout_page_offset", f"{s.WITH} SELECT doc_id, page, height, coalesce(sum(height + 100) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM pages")
def layout_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_offsets(s.pages(spark, sf_dir))


@query(
    "layout_header_footer",
    f"""{s.WITH} SELECT doc_id, regexp_replace(upper(trim(text)), '[0-9]', 'X', 'g') AS norm, count(DISTINCT page) AS pages, count(*) AS elements FROM elements JOIN pages USING (doc_id, page) WHERE y0 < 60 OR y1 > height - 60 GROUP BY ALL HAVING count(DISTINCT page) >= 2""",
)
def layout_header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repeated_margins(s.elements(spark, sf_dir), s.pages(spark, sf_dir))


def _nearest_sql(most: str) -> str:
    return f"""{s.WITH}, j AS (SELECT v.doc_id, v.row, v.seq, l.text AS label, l.seq AS label_seq, abs((v.x0 + v.x1) / 2 - (l.x0 + l.x1) / 2) AS gap FROM elements v JOIN elements l ON v.doc_id = l.doc_id AND v.row = l.row WHERE NOT v.is_label AND l.is_label {most})
SELECT doc_id, row, seq, (min((gap, label_seq, label)))[3] AS label, min(gap) AS gap FROM j GROUP BY doc_id, row, seq"""


@query("layout_nearest_month", _nearest_sql("AND abs((v.x0 + v.x1) / 2 - (l.x0 + l.x1) / 2) <= 20"))
def layout_nearest_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.elements(spark, sf_dir)
    return layout.nearest_label(found.filter("not is_label"), found.filter("is_label"), 20.0)


@query("layout_nearest_column", _nearest_sql(""))
def layout_nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.elements(spark, sf_dir)
    return layout.nearest_label(found.filter("not is_label"), found.filter("is_label"), None)


@query(
    "layout_card_asof",
    f"""{s.WITH}, starts AS (SELECT doc_id, y0, CAST(y0 AS INT) AS start_no FROM elements WHERE is_label)
SELECT e.doc_id, e.seq, max(start_no) AS region FROM elements e LEFT JOIN starts s ON s.doc_id = e.doc_id AND s.y0 <= e.y0 WHERE NOT is_label GROUP BY e.doc_id, e.seq, e.y0, e.x0, e.page""",
)
def layout_card_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.elements(spark, sf_dir)
    return layout.regions(found.filter("not is_label"), found.filter("is_label").select("doc_id", "y0", F.col("y0").cast("int").alias("start_no")))


@query(
    "layout_card_regions",
    f"""{s.WITH}, starts AS (SELECT DISTINCT doc_id, y0 FROM elements WHERE is_label) SELECT doc_id, y0 AS top, lead(y0) OVER (PARTITION BY doc_id ORDER BY y0) AS bottom FROM starts""",
)
def layout_card_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    starts = s.dealt_elements(spark, sf_dir).filter("is_label").select("doc_id", "y0").distinct()
    return starts.select("doc_id", F.col("y0").alias("top"), F.lead("y0").over(Window.partitionBy("doc_id").orderBy("y0")).alias("bottom"))


@query(
    "layout_stacked_pairs",
    f"""{s.WITH}, n AS (SELECT *, lead(text) OVER w AS value, lead(x0) OVER w AS bx0, lead(x1) OVER w AS bx1 FROM elements WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, seq)) SELECT doc_id, page, seq, text, value FROM n WHERE bx0 < x1 AND bx1 > x0""",
)
def layout_stacked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.stacked_pairs(s.dealt_elements(spark, sf_dir))


@query(
    "layout_column_slices",
    f"""{s.WITH} SELECT doc_id, seq, 'first' AS slice FROM elements WHERE x0 < 250 UNION ALL SELECT doc_id, seq, 'second' FROM elements WHERE x0 >= 250 AND x0 < 450 UNION ALL SELECT doc_id, seq, 'third' FROM elements WHERE x0 >= 400 AND x0 < 580
UNION ALL SELECT doc_id, seq, 'fourth' FROM elements WHERE x0 >= 550""",
)
def layout_column_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_slices(s.elements(spark, sf_dir))


@query("layout_interval_overlap", f"{s.WITH} SELECT l.doc_id, l.page, l.seq AS label_seq, e.seq FROM elements l JOIN elements e ON l.doc_id = e.doc_id AND l.page = e.page WHERE l.is_label AND l.y0 < e.y1 AND l.y1 > e.y0 AND e.x0 >= l.x1")
def layout_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.elements(spark, sf_dir)
    return layout.overlapping_right(found.filter("is_label"), found)


@query("layout_source_pages", f"{s.WITH} SELECT doc_id, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM elements GROUP BY doc_id")
def layout_source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.dealt_elements(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ",").alias("pages"))


@query("layout_sorted_runs", f"{s.WITH} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY page, (y0 + y1) / 2, x0, seq) AS place FROM elements")
def layout_sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("page", (F.col("y0") + F.col("y1")) / 2, "x0", "seq")
    return s.dealt_elements(spark, sf_dir).select("doc_id", "seq", F.row_number().over(order).alias("place"))


_OVERLAP = "r.page = g.page AND least(r.{1}, g.{1}) - greatest(r.{0}, g.{0}) > 0.4 * greatest(r.{1} - r.{0}, g.{1} - g.{0})"


def _grouped_sql(begin: str, end: str) -> str:
    return f"""{s.WITH}, {fold_sql("SELECT * FROM elements", f"page, {begin}, seq", _OVERLAP.format(begin, end), f"page, {begin}, {end}")} SELECT doc_id, seq, grp AS "group" FROM g"""


@query("layout_column_cluster", _grouped_sql("x0", "x1"))
def layout_column_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns anchored at their first element."""
    return layout.anchored_groups(s.elements(spark, sf_dir), begin="x0", end="x1")


@query(
    "layout_margin_suppression",
    f"""{s.WITH}, m AS (SELECT e.*, y0 < 60 OR y0 > height - 60 AS inside, regexp_replace(upper(trim(text)), '[0-9]+', 'X', 'g') AS norm FROM elements e JOIN pages USING (doc_id, page)),
t AS (SELECT *, min(page) OVER (PARTITION BY doc_id) < max(page) OVER (PARTITION BY doc_id) AS many, count(*) OVER (PARTITION BY doc_id, norm, inside) AS times FROM m)
SELECT doc_id, page, seq, text FROM t WHERE NOT (inside AND (contains(norm, 'PAGE X') OR many AND strlen(norm) > 3 AND times > 1))""",
)
def layout_margin_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements but for headers and footers."""
    runs = s.elements(spark, sf_dir).join(s.pages(spark, sf_dir).withColumnRenamed("height", "page_height"), ["doc_id", "page"])
    return layout.without_margins(runs).select("doc_id", "page", "seq", "text")


@query("layout_row_cluster", _grouped_sql("y0", "y1"))
def layout_row_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows anchored at their first element."""
    return layout.anchored_groups(s.elements(spark, sf_dir).select("doc_id", "seq", "page", "y0", "y1"))
