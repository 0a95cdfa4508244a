"""Rows are dealt into stated numbers of pieces before they grow, and nothing exploded is broadcast."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lendmill.operators import labels, nested, reports
from lendmill.sources import tables


def plan(frame) -> str:
    return frame._jdf.queryExecution().toString()


def test_pieces_grow_with_the_rows(spark, sf):
    rows = tables.table(spark, sf, "lineitem")
    many = tables.pieces(rows, 100)
    assert many == -(-rows.count() // 100) and tables.pieces(rows.limit(0), 100) >= 1
    assert tables.dealt(rows, "l_orderkey", each=100).rdd.getNumPartitions() == many


def test_cards_are_not_broadcast(spark, sf):
    """a card's elements are exploded from two numbers of an order, so their size is far from its estimate."""
    found = entry.queries()["bureau_card_fields"](spark, sf)
    assert "BroadcastHashJoin" not in plan(found) and "BroadcastHashJoin" not in plan(entry.queries()["bureau_metadata_identity"](spark, sf))


def test_growing_rows_are_dealt_by_number(spark, sf):
    """F3, F4, F6 to F8, F10 to F16."""
    names = "income_relational_document payslip_employee_grid pii_redact_nested income_slot_details src_rtf_runs pii_mask_nested bureau_triage_decision bureau_triage_rules_long".split()
    for name in names + "bureau_worst_dpd_account_window layout_bands income_deduction_entries payslip_employee income_tax_figures".split():
        if name != "src_rtf_runs":
            assert "REPARTITION_BY_NUM" in plan(entry.queries()[name](spark, sf)), name


def test_equal_lines_of_deductions_without_a_join(spark):
    """the first line with an item's text is an item's line, so a window over those finds it."""
    lines = [(1, 2, ["80C LIC", "700"]), (1, 1, ["80C LIC", "700"]), (1, 3, ["80D Mediclaim", "100", "50"]), (2, 1, ["plain", "5"]), (None, 1, ["80C LIC", "700"])]
    found = labels.deductions(spark.createDataFrame(lines, "doc_id long, line_no long, segs array<string>"))
    assert "Join" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "80C", "80C LIC", 70000, None, 70000), (1, 2, "80C", "80C LIC", 70000, None, 70000), (1, 3, "80D", "80D Mediclaim", 5000, 10000, 5000)]


def test_label_of_a_cell_is_looked_up_once(spark):
    """shapes of a line's text are looked for on its line, before its cells are rows."""
    lines = spark.createDataFrame([(1, 1, ["Emp Name :", "A", ""]), (1, 2, ["x ABCDE1234F", "uan 123456781234"]), (1, 3, [])], "doc_id long, line_no long, segs array<string>")
    found = labels.employee(lines)
    row = found.first()
    assert (row["name"], row.pan, row.uan) == ("A", "ABCDE1234F", "123456781234")
    assert plan(found).split("== Optimized")[1].split("== Physical")[0].count("UAN\\s") <= 2


def test_pieces_of_records_are_few(spark):
    """F5, F8: escapes are no rows of their own, and a backslash at the end stays; a string left open is closed, as before."""
    raw = r'{"a\"b":"x\\","n":["\n\n\"\n",1]} "open \\\"' + "\\"
    records = spark.createDataFrame([(1, raw), (2, ""), (3, None), (4, '"'), (5, "\\")], "id long, json string")
    assert {r.id: r.json for r in nested.masked(records, lambda text, name, is_name: F.lit(None).cast("string")).collect()} == {1: raw + '"', 2: "", 3: None, 4: '""', 5: "\\"}
    assert "regexp_extract_all" not in plan(nested.pieces(records))


def test_cards_are_read_without_joins_and_lambdas(spark, sf):
    """labels are looked for in many cards at once; a card is grouped where its elements and its start meet."""
    found = plan(entry.queries()["bureau_card_fields"](spark, sf)).split("== Physical")[1]
    assert "Join" not in found and "lambdafunction" not in found and found.count("MapInArrow") == 1


def test_cards_of_odd_starts(spark):
    """two starts at one height (the later has the elements), elements above all starts, no text, no page, no right edge."""
    starts = spark.createDataFrame([(1, 5, 100.0, "7. Account"), (1, 6, 100.0, "x"), (1, 7, 300.0, None), (2, 1, 0.0, "12. ACCOUNT")], "doc_id long, start_no long, y0 double, text string")
    cells = [
        (1, 1, 1, 20.0, 50.0, 100.0, 60.0, "TYPE: Above"), (1, 1, 2, 20.0, 100.0, 100.0, 110.0, "TYPE"), (1, 2, 3, 120.0, 100.0, 200.0, 110.0, ": Car 1234 5678 9012"), (1, None, 4, 260.0, 130.0, 340.0, 140.0, "Sanctioned: 1,200"),
        (1, 1, 5, 260.0, 160.0, None, 170.0, "CURRENT: 9"), (1, 3, 6, 20.0, 310.0, 100.0, 320.0, None), (2, 1, 1, 560.0, 10.0, 640.0, 20.0, "Settlement"), (2, 1, 2, 560.0, 22.0, 640.0, 32.0, "450"), (2, 1, 3, 20.0, 40.0, 100.0, 50.0, "Closed: 01-02-2020"),
    ]
    elements = spark.createDataFrame(cells, "doc_id long, page int, seq long, x0 double, y0 double, x1 double, y1 double, text string")
    found = sorted(reports.account_cards(elements, starts).select("doc_id", "card_no", "account_type", "status", "date_closed", "sanctioned", "balance", "settlement", "source_pages").collect())
    assert [tuple(r) for r in found] == [
        (1, 2, "Car [Aadhaar Redacted]", "Unknown", None, 1200, 9, None, [1, 2]), (1, 3, "UNKNOWN TYPE", "Unknown", None, None, None, None, None),
        (1, 7, "UNKNOWN TYPE", "Unknown", None, None, None, None, None), (2, 12, "UNKNOWN TYPE", "Inactive", "01-02-2020", None, None, 450, [1]),
    ]
