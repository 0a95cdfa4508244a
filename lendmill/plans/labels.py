"""Queries of labelled blocks, deductions and pre-extracted text blocks; their SQL knows each kind of line by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendmill.operators import labels, relational
from lendmill.registry import query
from lendmill.sources import layout as s
from lendmill.sources.layout import block_json
from lendmill.sources.tables import dealt, pieces, select_sql, table, texts

#: Documents in a dealt piece, about.
DOCUMENTS = 1 << 11
_N = "CAST(l_partkey % 9000 + 1000 AS STRING)"


def _kind(kinds: list) -> str:
    return f"(l_partkey + l_suppkey * 5) % {len(kinds)}"


def _dealt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"), "l_orderkey")


def _lines(spark: SparkSession, sf_dir: str, kinds: list[tuple[str, ...]]) -> DataFrame:
    """Lines of three cells, dealt by document before they are made: the kind of each by key arithmetic."""
    cells = [[*cells, *["''"] * (3 - len(cells))] for cells in kinds]
    shown = [f"CASE {_kind(kinds)} " + " ".join(f"WHEN {k} THEN {c[i]}" for k, c in enumerate(cells)) + f" END AS s{i}" for i in range(3)]
    rows = _dealt_items(spark, sf_dir).selectExpr("l_orderkey AS doc_id", f"{s.SEQ} AS line_no", *shown)
    return rows.select("doc_id", "line_no", F.array("s0", "s1", "s2").alias("segs"))


def _from(kinds: list) -> str:
    return f"FROM (SELECT l_orderkey AS doc_id, {s.SEQ} AS line_no, {_kind(kinds)} AS kind, l_partkey % 9000 + 1000 AS n FROM lineitem)"


def _first(value: str, *kinds: int) -> str:
    return f"arg_min({value}, line_no) FILTER (WHERE kind IN ({', '.join(map(str, kinds))}))"


_ASSESSEE = [
    ("'Name of Assessee :'", f"concat('A', {_N})"), ("'Father''s Name'", f"concat(' B', {_N})"), ("'Residential Status'", "'Resident'"), ("'Status'", "'Individual'"), ("'PAN No'", f"concat('abcde', {_N}, 'f')"),
    ("'Name'", "'nobody'"), ("'E-Mail'", "' '"), ("'Email ID'", "'x@y'"), ("'see PQRST1234Z'",), ("'PAN'", "'stray'"), ("'Bank Name:'", "'Some Bank'"),
]
_NONE = "CAST(NULL AS VARCHAR)"


@query(
    "income_assessee",
    f"""SELECT doc_id, {_first("'A' || n", 0)} AS name, {_first("'B' || n", 1)} AS fathers_name, {_NONE} AS address, {_first("'x@y'", 7)} AS email, {_first("'Individual'", 3)} AS status,
CASE {_first("kind", 4, 9)} WHEN 4 THEN 'ABCDE' || {_first("n", 4)} || 'F' WHEN 9 THEN NULL ELSE {_first("'PQRST1234Z'", 8)} END AS pan, {_NONE} AS date_of_birth, {_first("'Resident'", 2)} AS residential_status,
{_NONE} AS gender, {_NONE} AS ward, {_NONE} AS nature_of_business, {_NONE} AS filing_status, {_first("'Some Bank'", 10)} AS bank {_from(_ASSESSEE)} GROUP BY doc_id""",
)
def income_assessee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assessee block of each sheet."""
    return labels.assessee(_lines(spark, sf_dir, _ASSESSEE))


_EMPLOYEE = [
    (f"concat('Emp Name : E', {_N})",), ("'Name'", "' : '", f"concat('F', {_N})"), ("'Employee Code:'", _N), ("'x'", "'Designation'", "'Clerk'"), ("'Pan Number'", f"concat('AAAAA', {_N}, 'B')"),
    (f"concat('has ccccc', {_N}, 'd inside')",), ("'UAN no: 123456781234'",), ("'DOJ'",), ("'Bank Name'", "'Some'"), ("'PF Account : '", "'77'"), ("'Name'", "'G'", "'PAN : H'"),
]


@query(
    "payslip_employee",
    f"""SELECT doc_id, {_first("CASE kind WHEN 0 THEN 'E' || n WHEN 1 THEN 'F' || n ELSE 'G' END", 0, 1, 10)} AS name, {_first("n::VARCHAR", 2)} AS employee_id, {_first("'Clerk'", 3)} AS designation, {_NONE} AS department,
coalesce({_first("CASE kind WHEN 4 THEN 'AAAAA' || n || 'B' ELSE 'H' END", 4, 10)}, {_first("'CCCCC' || n || 'D'", 5)}) AS pan, {_first("'123456781234'", 6)} AS uan, {_first("'77'", 9)} AS pf_number,
{_NONE} AS esi_number, {_NONE} AS bank_account, {_NONE} AS date_of_joining {_from(_EMPLOYEE)} GROUP BY doc_id""",
)
def payslip_employee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The employee block of each pay slip, values on the label's own line."""
    return labels.employee(_lines(spark, sf_dir, _EMPLOYEE))


#: Lines of grid slips: (text, x, width) of each cell; n is the document's own number.
_GRID = [
    (("concat('Emp Name : E', n)", 0, 90), ("''", 0, 0), ("''", 0, 0)),
    (("'Name'", 0, 100), ("''", 150, 50), ("' '", 300, 50)),
    (("concat('F', n)", 20, 100), ("'Clerk'", 180, 60), ("'77'", 420, 50)),
    (("'x'", 0, 20), ("'Designation:'", 150, 100), ("''", 400, 10)),
    (("''", 0, 0), ("' '", 100, 5), ("'PF Account :'", 400, 80)),
    (("'PAN'", 0, 50), ("' : '", 100, 10), ("''", 0, 0)),
    (("'UAN no: 123456781234'", 0, 200), ("''", 0, 0), ("''", 0, 0)),
    (("concat('G', n)", 300, 200), ("'Employee Code:'", 500, 100), ("''", 0, 0)),
    (("concat('has ccccc', n, 'd inside')", 10, 500), ("''", 0, 0), ("''", 0, 0)),
    (("'DOJ'", 0, 40), ("'DOJ'", 450, 60), ("''", 0, 0)),
    (("''", 0, 0), ("'Esi No'", 240, 60), ("' '", 0, 0)),
    (("'Department'", 0, 30), ("''", 0, 0), ("'Department'", 430, 30)),
]
_GRID_LINES = "doc_id, n, i, 1 + i // 5 AS page, (doc_id * 7 + i * 5 + (i // 4) * 3) % 12 AS kind"


def _grid(place: int, part: int) -> str:
    return f"CASE kind {' '.join(f'WHEN {k} THEN {cells[place][part]}' for k, cells in enumerate(_GRID))} END"


def _document_pieces(spark: SparkSession, sf_dir: str) -> int:
    """Documents are dealt in pieces of so many at most, as ids and counts of lines are small and their lines are not."""
    return pieces(table(spark, sf_dir, "documents"), DOCUMENTS)


_NAMES = list(dict.fromkeys(labels.EMPLOYEE.values()))
_GRID_SQL = f"""
WITH l AS (SELECT {_GRID_LINES} FROM (SELECT doc_id, CAST(doc_id % 9000 + 1000 AS VARCHAR) AS n, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))) + 6)) AS i FROM documents)),
c AS ({" UNION ALL ".join(f"SELECT doc_id, i, page, {k} AS place, {_grid(k, 0)} AS cell, {_grid(k, 1)} AS x, {_grid(k, 2)} AS w FROM l" for k in range(3))}),
p AS (SELECT *, trim(rtrim(trim(upper(cell)), ':')) AS plain FROM c),
k(label, field) AS (VALUES {", ".join(f"('{w}', '{f}')" for w, f in labels.EMPLOYEE.items())}),
h AS (SELECT p.*, label, field FROM p JOIN k ON starts_with(plain, label) QUALIFY row_number() OVER (PARTITION BY doc_id, i, place ORDER BY length(label) DESC) = 1),
b AS (
    SELECT h.doc_id, h.i, h.place, h.label, h.field, coalesce(nullif(trim(regexp_extract(any_value(h.cell), '(?s)^[^:]*:(.*)$', 1)), ''),
           arg_min(trim(ltrim(trim(q.cell), ':')), q.place) FILTER (WHERE trim(ltrim(trim(q.cell), ':')) <> '')) AS value, 0 AS below
    FROM h LEFT JOIN p q ON q.doc_id = h.doc_id AND q.i = h.i AND q.place > h.place GROUP BY h.doc_id, h.i, h.place, h.label, h.field
    UNION ALL
    SELECT h.doc_id, h.i, h.place, h.label, h.field, arg_min(trim(q.cell), q.place), 1
    FROM (SELECT * FROM h WHERE plain = label QUALIFY row_number() OVER (PARTITION BY doc_id, i, label ORDER BY place) = 1) h
    JOIN p q ON q.doc_id = h.doc_id AND q.i = h.i + 1 AND q.page = h.page AND h.x < q.x + q.w AND q.x < h.x + h.w AND trim(q.cell) <> ''
    GROUP BY h.doc_id, h.i, h.place, h.label, h.field
),
f AS (SELECT doc_id, {", ".join(f"arg_min(value, (i, -length(label), below, place)) FILTER (WHERE field = '{f}') AS {f}" for f in _NAMES)} FROM b WHERE value IS NOT NULL GROUP BY doc_id),
o AS (
    SELECT doc_id, arg_min(nullif(regexp_extract(upper(t), '{labels.PAN}', 1), ''), i) FILTER (WHERE regexp_matches(upper(t), '{labels.PAN}')) AS other_pan,
           arg_min(regexp_extract(t, '{labels.UAN}', 1), i) FILTER (WHERE regexp_matches(t, '{labels.UAN}')) AS other_uan
    FROM (SELECT doc_id, i, string_agg(cell, ' ' ORDER BY place) AS t FROM c GROUP BY doc_id, i) GROUP BY doc_id
)
SELECT o.doc_id, {", ".join(f"coalesce({f}, other_{f}) AS {f}" if f in ("pan", "uan") else f for f in _NAMES)} FROM o LEFT JOIN f USING (doc_id)
"""


@query("payslip_employee_grid", _GRID_SQL)
def payslip_employee_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The employee block of grid slips, one for each document: values beside, below and in both."""
    count = F.size(F.split(F.coalesce("text", F.lit("")), "\n")) + 6
    # Dealt before the lines are made: windows and aggregates by document need no other shuffle.
    docs = texts(spark, sf_dir, "documents").select("doc_id", count.alias("many")).repartition(_document_pieces(spark, sf_dir), "doc_id")
    docs = docs.select("doc_id", (F.col("doc_id") % 9000 + 1000).cast("string").alias("n"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("i"))
    rows = docs.selectExpr(*(x.strip() for x in _GRID_LINES.replace("i // 5", "i div 5").replace("i // 4", "i div 4").split(", ")))
    cells = F.array(*(F.expr(_grid(k, 0)) for k in range(3)))
    boxes = F.array(*(F.struct(F.expr(_grid(k, 1)).cast("double").alias("x"), F.expr(_grid(k, 2)).cast("double").alias("width")) for k in range(3)))
    return labels.employee(rows.select("doc_id", F.col("i").alias("line_no"), "page", cells.alias("segs"), boxes.alias("boxes")))


_LETTERHEAD = [("'Acme Works'",), ("'North Road'", "'East'"), ("'ab'",), ("'Plot 12'",), ("'Rs 1,200.50'",), ("'Salary Slip'",), ("'Payslip for May'",), ("'Unit of Acme'",)]
_TEXTS = "CASE kind WHEN 0 THEN 'Acme Works' WHEN 1 THEN 'North Road East' WHEN 5 THEN 'Salary Slip' WHEN 7 THEN 'Unit of Acme' END"


@query(
    "payslip_employer",
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS place {_from(_LETTERHEAD)}),
e AS (SELECT doc_id, greatest(coalesce(min(place) FILTER (WHERE kind IN (5, 6)), 4), 1) AS stop FROM l GROUP BY doc_id),
h AS (SELECT doc_id, list({_TEXTS} ORDER BY place) FILTER (WHERE place < stop AND kind IN (0, 1, 5, 7)) AS head FROM l JOIN e USING (doc_id) GROUP BY doc_id)
SELECT doc_id, head[1] AS name, head[2] AS address FROM h""",
)
def payslip_employer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The employer in each pay slip's letterhead."""
    return labels.employer(_lines(spark, sf_dir, _LETTERHEAD))


_TAX = [
    ("'TDS / TCS'", _N), ("'Advance  Tax'", "'by challan'", _N), ("'Interest u/s 234 A'", _N), ("'Interest U/S 234B'", "''", f"concat('(', {_N}, ')')"), ("'Tax on total income'", _N), ("'Income from Salaries'", _N),
    ("'TaxDue'", _N), ("'Rebate u/s 87A'", _N), ("'Capital Gains'", f"concat('-', {_N})"), ("'Surcharge'", "'nil'"), ("'Other Sources @5%'", _N), (f"concat('Education  Cess ', {_N})",),
]
_ABSENT = "CAST(NULL AS BIGINT)"


@query(
    "income_tax_figures",
    f"""SELECT doc_id, {_first("n * 100", 2)} AS interest_234a, {_first("-n * 100", 3)} AS interest_234b, {_ABSENT} AS interest_234c, {_first("n * 100", 5)} AS salary, {_ABSENT} AS house_property, {_ABSENT} AS business,
{_first("-n * 100", 8)} AS capital_gains, {_ABSENT} AS other_sources, {_first("n * 100", 6)} AS tax_due, {_ABSENT} AS surcharge, {_first("n * 100", 11)} AS cess, {_first("n * 100", 7)} AS rebate, {_ABSENT} AS relief,
{_ABSENT} AS net_tax, {_first("n * 100", 0)} AS tds, {_first("n * 100", 0)} AS tcs, {_first("n * 100", 1)} AS advance_tax, {_ABSENT} AS self_assessment {_from(_TAX)} GROUP BY doc_id""",
)
def income_tax_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of income, tax, credits and interest of each sheet; labels match whatever their spaces."""
    return labels.tax_figures(_lines(spark, sf_dir, _TAX))


_DEDUCTIONS = [
    ("'Deductions under Chapter VI-A'",), ("'80C LIC'", _N), ("'80D Mediclaim'", _N, "'5,500'"), ("'80G donation'",), ("'Total Income'", _N), ("'87A rebate'", _N), ("'Total Deductions'", f"concat('-', {_N})"),
    (f"concat('80TTA of ', {_N})",), ("'nothing'", _N),
]


@query(
    "income_deduction_entries",
    f"""WITH l AS (SELECT *, coalesce(last_value(CASE WHEN kind IN (0, 6) THEN true WHEN kind = 4 THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside {_from(_DEDUCTIONS)})
SELECT doc_id, line_no, CASE kind WHEN 1 THEN '80C' WHEN 2 THEN '80D' WHEN 3 THEN '80G' ELSE '80TTA' END AS section, CASE kind WHEN 1 THEN '80C LIC' WHEN 2 THEN '80D Mediclaim' WHEN 3 THEN '80G donation' ELSE '80TTA of ' || n END AS label,
CASE kind WHEN 2 THEN 550000 WHEN 3 THEN NULL ELSE n * 100 END AS amount, CASE kind WHEN 2 THEN n * 100 END AS gross, CASE kind WHEN 2 THEN 550000 WHEN 3 THEN NULL ELSE n * 100 END AS deductible
FROM l WHERE kind IN (1, 2, 7) OR kind = 3 AND inside""",
)
def income_deduction_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section lines of each sheet's deductions with their gross and deductible amounts."""
    return labels.deductions(_lines(spark, sf_dir, _DEDUCTIONS))


@query("income_deduction_totals", f"SELECT doc_id, {_first('n * 100', 6)} AS total {_from(_DEDUCTIONS)} GROUP BY doc_id")
def income_deduction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated total of each sheet's deductions, without its dash."""
    return labels.deduction_totals(_lines(spark, sf_dir, _DEDUCTIONS))


#: Head, label, slot.
_COMPONENTS = [
    ("salary", "Less: Standard Deduction u/s 16(ia)", "standard_deduction_16ia"), ("salary", "House Rent  Allowance", "hra"), ("salary", "Special allowance", "allowances"), ("salary", "Basic pay", "basic"),
    ("salary", "GrossSalary", "gross_salary"), ("house_property", "Standard deduction 30%", "standard_deduction_24a"), ("house_property", "Interest on housing loan u/s 24(b)", "interest_24b"),
    ("business", "PROFIT DEEMED U/S 44AD @ 8%", "deemed_profit"), ("business", "Presumptive u/s 44ADA", "presumptive_44ada"), ("business", "Turnover u/s 44AD", "gross_receipts"), ("capital_gains", "Long term u/s 112A", "long_term_112a"),
    ("capital_gains", "Short term", "short_term"), ("other_sources", "Saving Bank interest", "savings_bank_interest"), ("other_sources", "Basic pay", None), ("other_sources", "Dividend on F.D.R", "fixed_deposit_interest"), (None, "Basic pay", None),
]


def _of_component(i: int) -> str:
    return f"CASE {_kind(_COMPONENTS)} " + " ".join(f"WHEN {k} THEN '{c[i]}'" for k, c in enumerate(_COMPONENTS) if c[i] is not None) + " END"


@query("income_component_slots", f"SELECT l_orderkey AS doc_id, {s.SEQ} AS line_no, {_of_component(2)} AS slot FROM lineitem")
def income_component_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of each component under its head."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", f"{s.SEQ} AS line_no", f"{_of_component(0)} AS head", f"{_of_component(1)} AS label")
    return rows.select("doc_id", "line_no", labels.component_slot(F.col("head"), F.col("label")).alias("slot"))


_PAISE = "CAST(floor(l_extendedprice) AS BIGINT) * 100"


def _detail_sql() -> str:
    kinds: dict[str, list[str]] = {slot: [] for slots in labels.SLOTS.values() for slot in slots}
    for k, (_, _, slot) in enumerate(_COMPONENTS):
        if slot is not None:
            kinds[slot].append(str(k))
    shown = (f"arg_min(paise, line_no) FILTER (WHERE kind IN ({', '.join(k)})) AS {slot}" if k else f"CAST(NULL AS BIGINT) AS {slot}" for slot, k in kinds.items())
    held = "arg_min(CASE WHEN n % 5 = 0 THEN 'self_occupied' ELSE 'let_out' END, line_no) FILTER (WHERE n % 5 < 2) AS occupancy"
    return f"SELECT doc_id, {', '.join(shown)}, {held} FROM (SELECT l_orderkey AS doc_id, {s.SEQ} AS line_no, {_kind(_COMPONENTS)} AS kind, {_PAISE} AS paise, l_partkey AS n FROM lineitem) GROUP BY doc_id"


@query("income_slot_details", _detail_sql())
def income_slot_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named fields of each sheet's heads, and how a house is held."""
    held = "CASE l_partkey % 5 WHEN 0 THEN 'Self-Occupied flat' WHEN 1 THEN 'flat let out' ELSE 'flat' END AS held"
    rows = _dealt_items(spark, sf_dir).selectExpr("l_orderkey AS doc_id", f"{s.SEQ} AS line_no", f"{_of_component(0)} AS head", f"{_of_component(1)} AS label", f"{_PAISE} AS paise", held)
    return labels.head_details(rows, rows.select("doc_id", "line_no", F.col("held").alias("label")))


_SHEET = {
    "sheet_id": "o_orderkey", "source": "CASE WHEN o_orderkey % 7 <> 0 THEN 'a.pdf' ELSE '' END", "format": "CASE o_orderkey % 5 WHEN 0 THEN 'Pdf' WHEN 1 THEN 'Rtf' WHEN 2 THEN 'pdf' WHEN 3 THEN 'Pdf' END",
    "pan": "CASE o_orderkey % 4 WHEN 0 THEN 'ABCDE1234F' WHEN 1 THEN 'ABCDE12345' WHEN 2 THEN 'xABCDE1234F' END", "aadhaar": "CASE o_orderkey % 3 WHEN 0 THEN '[Aadhaar Redacted]' WHEN 1 THEN '1234' END",
    "ay0": "CASE WHEN o_orderkey % 6 <> 0 THEN 1985 + o_orderkey % 120 END", "fy_source": "CASE o_orderkey % 8 WHEN 0 THEN 'stated' WHEN 1 THEN 'derived' WHEN 2 THEN 'guess' END", "code": "CASE o_orderkey % 9 WHEN 0 THEN '8' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE '80C' END",
}


@query(
    "income_schema_flags",
    f"""SELECT sheet_id, source = '' AS bad_source, format IS NULL OR format = 'pdf' AS bad_format, sheet_id % 4 IN (1, 2) AS bad_pan, sheet_id % 3 = 1 AS bad_aadhaar, coalesce(ay0 NOT BETWEEN 1990 AND 2100, false) AS bad_assessment_year,
coalesce(ay0 - 1 NOT BETWEEN 1990 AND 2100, false) AS bad_financial_year, sheet_id % 8 = 2 AS bad_year_source, CASE WHEN sheet_id % 9 < 3 THEN 1 ELSE 0 END AS bad_sections FROM ({select_sql(_SHEET, "orders")})""",
)
def income_schema_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What in a computation breaks its schema."""
    rows = table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in _SHEET.items()))
    span = lambda first: F.when(F.col("ay0").isNotNull(), F.struct(first.alias("start"), (first + 1).alias("end")))
    return labels.sheet_schema_flags(rows.withColumns({"ay": span(F.col("ay0")), "fy": span(F.col("ay0") - 1), "sections": F.array(F.lit("80D"), "code")}))


@query(
    "src_block_json",
    f"""SELECT l_orderkey AS doc_id, {s.SEQ} AS seq, 'run ' || l_partkey AS text, (l_partkey % 600)::DOUBLE AS x0, (l_suppkey % 700)::DOUBLE AS y0, (l_partkey % 600 + 30)::DOUBLE AS x1, (l_suppkey % 700 + 8)::DOUBLE AS y1,
CAST(l_linenumber AS INT) AS page, CASE WHEN l_partkey % 4 = 0 THEN 600.0 ELSE 842.0 END::DOUBLE AS page_height FROM lineitem WHERE l_partkey % 9 <> 0""",
)
def src_block_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks that were extracted before, one JSON object a block; a page's height has a default, broken JSON is left out."""
    number: Column = F.when(F.col("l_partkey") % 4 == 0, F.lit(600.0))
    box = F.array(*(F.expr(e).cast("double") for e in ("l_partkey % 600", "l_suppkey % 700", "l_partkey % 600 + 30", "l_suppkey % 700 + 8")))
    block = F.struct(F.concat(F.lit("run "), F.col("l_partkey").cast("string")).alias("raw_text"), box.alias("bounding_box"), F.col("l_linenumber").alias("page_number"), number.alias("page_height"))
    text = F.when(F.col("l_partkey") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(block))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(s.SEQ).alias("seq"), text.alias("json"))
    return rows.select("doc_id", "seq", block_json(F.col("json")).alias("b")).filter("b.text is not null").select("doc_id", "seq", "b.*")


#: Lines of a sheet: text cells and, for the SQL, what the line is: head that it opens, whether it closes a block, slot under
#: each head, figure, amount of the line, amount as a deduction, section. n is the document's own number.
_RELATED = [
    (("'Income from Salaries'", "n"), {"opens": "salary", "figure": "salary", "amount": "n * 100"}),
    (("'Basic  pay'", "n"), {"salary": "basic", "amount": "n * 100"}),
    (("'House Rent Allowance'",), {"salary": "hra"}),
    (("'Less: Standard Deduction u/s 16(ia)'", "'(500)'"), {"salary": "standard_deduction_16ia", "house_property": "standard_deduction_24a", "amount": "-50000"}),
    (("'Income from House Property'",), {"opens": "house_property"}),
    (("'Interest on housing loan u/s 24(b)'", "n"), {"house_property": "interest_24b", "amount": "n * 100", "section": "24(B)"}),
    (("'Annual value, self occupied'", "n"), {"house_property": "annual_value", "amount": "n * 100", "held": "self_occupied"}),
    (("'Capital Gains'", "'nil'"), {"opens": "capital_gains"}),
    (("'Long term u/s 112A'", "'x'", "n"), {"capital_gains": "long_term_112a", "amount": "n * 100"}),
    (("'Income from Other Sources'", "n"), {"opens": "other_sources", "figure": "other_sources", "amount": "n * 100"}),
    (("'Saving Bank interest'", "n"), {"other_sources": "savings_bank_interest", "amount": "n * 100"}),
    (("'Some row'", "n"), {"amount": "n * 100"}),
    (("'plain words'", "''", "'more'"), {}),
    (("'Gross Total Income'", "n"), {"closes": True, "figure": "gross_total_income", "amount": "n * 100", "block": False}),
    (("'Details of assets'",), {"closes": True}),
    (("'Deductions under Chapter VI-A'",), {"closes": True, "block": True}),
    (("'80C LIC'", "n"), {"amount": "n * 100", "section": "80C"}),
    (("'80D Mediclaim'", "n", "'5,500'"), {"amount": "550000", "section": "80D", "gross": "n * 100"}),
    (("'80G donation'",), {"section": "80G"}),
    (("'Total Deductions'", "concat('-', n)"), {"amount": "-n * 100", "block": True, "figure": "total_deductions"}),
    (("'Total Income'", "n"), {"closes": True, "figure": "total_income", "amount": "n * 100", "block": False}),
    (("'T.D.S.'", "n"), {"amount": "n * 100", "figure": "tds"}),
    (("'Surcharge'", "n"), {"amount": "n * 100", "figure": "surcharge"}),
    (("'Net Tax Payable'", "n"), {"closes": True, "amount": "n * 100", "figure": "net_tax"}),
    (("'Refundable'", "concat('(', n, ')')"), {"amount": "-n * 100", "figure": "refundable"}),
    (("'87A rebate'", "n"), {"amount": "n * 100", "figure": "rebate"}),
    (("'Let out flat'",), {"held": "let_out"}),
]
_RELATED_LINES = f"doc_id, n, i, 1 + i // 5 AS page, (doc_id * 7 + i * 5 + (i // 4) * 3 + (i // 9) * (doc_id % 4)) % {len(_RELATED)} AS kind"


def _related(name: str, text: bool = True) -> str:
    hits = " ".join(f"WHEN {k} THEN " + (f"'{v[name]}'" if text else str(v[name])) for k, (_, v) in enumerate(_RELATED) if name in v)
    return f"CASE kind {hits} END"


def _relational_sql() -> str:
    cells = [f"CASE kind {' '.join(f'WHEN {k} THEN {c[i]}' for k, (c, _) in enumerate(_RELATED) if i < len(c))} ELSE '' END" for i in range(3)]
    figure = lambda f: f"CAST(arg_min({'abs(amount)' if f in ('total_deductions', 'refundable') else 'amount'}, i) FILTER (WHERE figure = '{f}') AS BIGINT)"
    figures = ", ".join(f"{figure(f)} AS f_{f}" for f in dict.fromkeys(o[0] for o in relational._options()))
    heads = []
    for head, chapter in relational.CHAPTERS.items():
        slots = ", ".join(f"{s}: (SELECT arg_min(amount, i) FROM c WHERE c.doc_id = f.doc_id AND c.head = '{head}' AND c.slot = '{s}')" for s in labels.SLOTS[head])
        held = "occupancy: occupancy, " if head == "house_property" else ""
        heads.append(f"{head}: {{head: '{head}', chapter: '{chapter}', reported: f_{head} IS NOT NULL OR list_{head} IS NOT NULL, total: f_{head}, detail: {{{held}{slots}}}, components: coalesce(list_{head}, [])}}")
    lists = ", ".join(f"list({{label: label, amount: amount, slot: slot, page: page, raw_line: raw}} ORDER BY i) FILTER (WHERE head = '{h}') AS list_{h}" for h in relational.CHAPTERS)
    matrix = ", ".join(f"{n}: f_{f}" for f, n in (relational.MATRIX | {i: i for i in labels.INTEREST}).items())
    credits = ", ".join(f"{n}: f_{f}" for f, n in relational.CREDITS.items())
    slot = "CASE open " + " ".join(f"WHEN '{h}' THEN {_related(h)}" for h in relational.CHAPTERS if any(h in v for _, v in _RELATED)) + " END"
    return f"""
WITH l AS (SELECT {_RELATED_LINES} FROM (SELECT doc_id, CAST(doc_id % 9000 + 1000 AS VARCHAR) AS n, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))) + 9)) AS i FROM documents)),
k AS (SELECT doc_id, i, page, kind, {cells[0]} AS label, concat({cells[0]}, ' ', {cells[1]}, ' ', {cells[2]}) AS raw, {_related("amount", False).replace("n * 100", "CAST(n AS BIGINT) * 100")} AS amount, {_related("gross", False).replace("n * 100", "CAST(n AS BIGINT) * 100")} AS gross,
             {_related("opens")} AS opens, {_related("opens")} IS NOT NULL OR coalesce({_related("closes", False)}, false) AS own, {_related("section")} AS section, {_related("figure")} AS figure, {_related("held")} AS held, {_related("block", False)} AS block FROM l),
o AS (SELECT *, last_value(CASE WHEN own THEN coalesce(opens, '-') END IGNORE NULLS) OVER w AS open, last_value(CASE WHEN own THEN i END IGNORE NULLS) OVER w AS start, coalesce(last_value(block IGNORE NULLS) OVER w, false) AS inside
      FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT doc_id, i, page, open AS head, label, amount, raw, {slot} AS slot FROM o WHERE NOT own AND open <> '-' AND i - start <= 40 AND (amount IS NOT NULL OR {slot} IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY doc_id, open, raw ORDER BY i) = 1),
h AS (SELECT doc_id, {lists} FROM c GROUP BY doc_id),
d AS (SELECT doc_id, list({{section: section, label: label, gross_amount: gross, deductible_amount: amount, raw_line: raw}} ORDER BY i) AS entries, sum(coalesce(amount, 0)) AS total FROM o
      WHERE section IS NOT NULL AND (amount IS NOT NULL OR inside) GROUP BY doc_id),
f AS (SELECT doc_id, max(page) AS pages, arg_min(held, i) FILTER (WHERE held IS NOT NULL) AS occupancy, {figures} FROM o GROUP BY doc_id)
SELECT f.doc_id, CAST(to_json({{metadata: {{schema_version: '{relational.VERSION}', page_count: pages}}, income_heads: {{{", ".join(heads)}}},
    tax_computation: {{gross_total_income: f_gross_total_income, total_deductions: f_total_deductions, total_income: f_total_income, {matrix}, credits: {{{credits}, total: {" + ".join(f"coalesce(f_{f}, 0)" for f in relational.CREDITS)}}}, refundable: f_refundable}},
    chapter_vi_a: {{entries: coalesce(entries, []), total_claimed: f_total_deductions, sum_of_entries: CAST(coalesce(d.total, 0) AS BIGINT)}}}}) AS VARCHAR) AS document
FROM f LEFT JOIN h USING (doc_id) LEFT JOIN d USING (doc_id)
"""


@query("income_relational_document", _relational_sql())
def income_relational_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole nested document of a sheet for each document."""
    count = F.size(F.split(F.coalesce("text", F.lit("")), "\\n")) + 9
    # Dealt before the lines are made: windows and aggregates by document need no other shuffle.
    docs = texts(spark, sf_dir, "documents").select("doc_id", count.alias("many")).repartition(_document_pieces(spark, sf_dir), "doc_id")
    docs = docs.select("doc_id", (F.col("doc_id") % 9000 + 1000).cast("string").alias("n"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("i"))
    rows = docs.selectExpr(*(x.strip() for x in _RELATED_LINES.replace(" // ", " div ").split(", ")))
    cells = F.array(*(F.expr(f"CASE kind {' '.join(f'WHEN {k} THEN {c[i]}' for k, (c, _) in enumerate(_RELATED) if i < len(c))} ELSE '' END") for i in range(3)))
    lines = rows.select("doc_id", F.col("i").alias("line_no"), "page", cells.alias("segs"))
    return relational.relational_documents(lines).select("doc_id", relational.as_json(F.col("document")).alias("document"))
