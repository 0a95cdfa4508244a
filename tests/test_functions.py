"""Boundary tables and plain models of what SQL in DuckDB cannot express."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendmill.functions import coerce, money, pii
from lendmill.operators import bureau, layout, policy


def values(spark, function, texts):
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in data.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def test_payment_cells(spark):
    tokens = ["STD", " xxx ", "*", "-", "", "120", "45.9", "+7", "120d", "SMA", "sub", None, "1e3", "nan", "-5"]
    assert values(spark, coerce.dpd_strict, tokens) == [0, 0, 0, 0, 0, 120, 45, 7, None, None, None, None, None, None, -5]
    assert values(spark, coerce.dpd_lenient, tokens) == [0, 0, 0, 0, 0, 120, 45, 7, 0, 0, 0, 0, 0, 0, 0]
    assert values(spark, coerce.dpd_token, ["std", " 030", "na", "abc", "", None]) == ["STD", "030", "NA", None, None, None]


def test_amounts(spark):
    texts = ["14,15,039", "1,23,234.00", "(1,200)", "-500", "500 DR", "Rs 75", "Rs. 75", "1.2.3", "Tax on 7,00,001", "", "5", "1.5", "1.559", "99999999999999999999", "₹ 12", "()"]
    assert values(spark, money.money, texts) == [141503900, 12323400, -120000, -50000, -50000, 7500, None, None, None, None, 500, 150, 155, None, 1200, None]
    assert values(spark, money.first_money, ["cess 4.00% 4,929", "no 12 here 1234.", "x", "a 1.2.3 b 9,9"]) == [400, 123400, None, 9900]
    assert values(spark, money.last_money, ["cess 4.00% 4,929", "1234 and 12", "1234."]) == [492900, 123400, 123400]


def test_years(spark):
    texts = ["2024-25", "2024-2025", "FY 2024/25", "1999-00", "2024-24", "1989-90", "12 2024 25", "2099-2100", "none", "2024-26 2025-26"]
    assert values(spark, money.year_range, texts) == [2024, 2024, 2024, 1999, None, None, 2024, 2099, None, 2025]


def test_dates_roll_over(spark):
    found = values(spark, bureau.civil_date, ["31/02/2025", "05-01-2024", "32/01/2024", "1/13/2024", "x", "1/1", None])
    assert [str(x) if x else None for x in found] == ["2025-03-03", "2024-01-05", None, None, None, None, None]


def verhoeff(digits):
    group, turns, c = pii.GROUP, pii.PLACES, 0
    for i, ch in enumerate(reversed(digits)):
        c = group[c * 10 + turns[i % 8 * 10 + int(ch)]]
    return c == 0


def test_checksum_finds_single_errors_and_swaps(spark):
    own = random.Random(4)
    good = []
    while len(good) < 20:
        body = str(own.randint(2, 9)) + "".join(own.choice("0123456789") for _ in range(10))
        good.extend(body + d for d in "0123456789" if verhoeff(body + d))
    wrong = [g[:5] + str((int(g[5]) + 3) % 10) + g[6:] for g in good] + [g[:4] + g[5] + g[4] + g[6:] for g in good if g[4] != g[5]]
    assert all(values(spark, pii.verhoeff_valid, good)) and not any(values(spark, pii.verhoeff_valid, [*wrong, "1" + good[0][1:], "12", ""]))


def redacted(text):
    out = re.sub(r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)", "************", text)
    out = re.sub(r"(?<![A-Z0-9])[A-Z]{5}\d{4}[A-Z](?![A-Z0-9])", lambda m: "*****" + m[0][5:], out)
    out = re.sub(r"[\w.+-]+@[\w-]+\.[\w.]+", lambda m: "***@" + m[0].split("@", 1)[1], out, flags=re.ASCII)
    return re.sub(r"(?<!\d)(?:\+91[- ]?)?[6-9]\d{9}(?!\d)", lambda m: "*******" + m[0][-3:], out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["1234 5678 9012", "123456789012", "1234567890123", "ABCDE1234F", "XABCDE1234F", "a.b@c.de", "+91 9876543210", "9876543210", " ", "-", "x", "0"]), max_size=6), min_size=1, max_size=30))
def test_redaction_as_a_model(spark, parts):
    texts = ["".join(p) for p in parts]
    assert values(spark, pii.redact_text, texts) == [redacted(t) for t in texts]


def test_strict_redaction_masks_valid_numbers_only(spark):
    good = next(f"2345678901{a}{b}" for a in "0123456789" for b in "0123456789" if verhoeff(f"2345678901{a}{b}"))
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    assert values(spark, pii.redact_strict, [f"id {good} no {bad} {good}"]) == [f"id ************ no {bad} ************"]
    assert values(spark, pii.leaks, [f"{good} {bad} 1{good} {good}.5 x"]) == [2]


def test_policy_boundaries(spark):
    """One applicant that all pass but for one field at a time."""
    names = policy.normalized.__doc__ and "app_id long, age long, entity_type string, business_entity_type string, occupation string, cibil_score long, currently_overdue boolean, write_off_amount double, write_off_type string, cc_write_off boolean, pl_write_off boolean, is_nri boolean, nri_years double, nri_days long, net_monthly_salary double, salary_payment_mode string, prev_company_joining date, minimum_work_experience_years double, current_company_tenure_months long, no_income_proof_segment boolean, form_16_years int, income_proof string, existing_car_loan_bank string, age_at_last_emi long, current_itr double, previous_itr double, itr_filed boolean, business_proof boolean, business_itr_years int, business_experience_years int, property_status string, guarantor_provided boolean, has_loan_enquiry boolean, loan_enquiry_count int, existing_account_bank string, account_bank_known boolean, rental_income_class string, sibling_co_applicant boolean, selected_bank string, tenant_id string"
    fields = [n.split()[0] for n in names.split(", ")]
    cases = [
        ({}, [], set()), ({"cibil_score": 700}, [], {"BUR-405"}), ({"cibil_score": 701}, [], set()), ({"age": 20}, [], {"DEM-101"}), ({"age": 21}, [], set()), ({"write_off_type": "CC", "write_off_amount": 4999.99}, [], set()),
        ({"write_off_type": "CC", "write_off_amount": 5000.0}, [], {"BUR-401B"}), ({"write_off_type": "PL", "write_off_amount": 1.0}, [], {"BUR-401"}), ({"write_off_type": "XX", "write_off_amount": 1.0}, [], {"BUR-401D"}),
        ({}, ["1"], {"BUR-402"}), ({}, ["STD", None, "000"], set()), ({"is_nri": True}, [], {"DEM-104"}), ({"net_monthly_salary": 24999.0}, [], {"EMP-SAL-202"}), ({"entity_type": "Company", "net_monthly_salary": 1.0}, [], set()),
        ({"entity_type": "HUF"}, [], {"ENT-501"}), ({"tenant_id": "tenant_alpha", "cibil_score": 719}, [], {"ALPHA-RSK-001"}), ({"property_status": "RESI_CUM_OFFICE_RENTED"}, [], {"RES-205"}),
        ({"property_status": "resi_cum_office_rented", "guarantor_provided": True}, [], set()), ({"age_at_last_emi": 61}, [], {"DEM-102"}), ({"salary_payment_mode": "CASH"}, [], {"EMP-SAL-203"}), ({}, ["SMA"], None),
    ]
    apps = spark.createDataFrame([tuple({"app_id": i, **given}.get(f) for f in fields) for i, (given, _, _) in enumerate(cases)], names)
    cells = spark.createDataFrame([(i, t) for i, (_, tokens, _) in enumerate(cases) for t in tokens], "app_id long, token string")
    facts = policy.normalized(apps, policy.worst_dpd(cells), "2025-01-01")
    found = policy.outcomes(policy.offers(facts, policy.policy_table(spark)).filter("bank_code = 'BOI'"))
    failed = {i: set() for i, (_, _, want) in enumerate(cases) if want is not None}
    seen = set()
    for r in found.collect():
        seen.add(r.app_id)
        if not r.passed:
            failed[r.app_id].add(r.rule_id)
    assert seen == set(failed) and failed == {i: want for i, (_, _, want) in enumerate(cases) if want is not None}
    counted = policy.verdicts(policy.offers(facts, policy.policy_table(spark)).filter("bank_code = 'BOI'")).collect()
    assert {r.app_id: r.failures for r in counted} == {i: len(f) for i, f in failed.items()}


def test_rules_with_one_applicant_stay_in_the_jvm(spark, sf):
    from lendmill.plans.policy import policy_bank_map

    text = policy_bank_map(spark, sf)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in text and not re.search("Python|Pandas|ArrowEval|Cartesian", text)


def test_row_clusters_as_a_loop(spark):
    own = random.Random(2)
    rows = [(d, s, own.randint(1, 2), float(own.randint(0, 300)), 0.0) for d in range(12) for s in range(40)]
    rows = [(d, s, p, y, y + own.randint(5, 14)) for d, s, p, y, _ in rows]
    got = {(r.doc_id, r.seq): r.group for r in layout.anchored_groups(spark.createDataFrame(rows, "doc_id long, seq long, page int, y0 double, y1 double")).collect()}
    for doc in range(12):
        number, anchor = 0, None
        for d, s, p, a, b in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[2], r[3], r[1])):
            if anchor is None or anchor[0] != p or min(b, anchor[2]) - max(a, anchor[1]) <= 0.4 * max(b - a, anchor[2] - anchor[1]):
                number, anchor = number + 1, (p, a, b)
            assert got[d, s] == number


@pytest.mark.parametrize("seed", [1, 2])
def test_first_wins_as_a_sequence(spark, seed):
    from lendmill.operators.duplicates import first_wins

    own = random.Random(seed)
    texts = ["word " * 60, "Word  " * 60, "other " * 60, "short", "Short", None, ""]
    rows = [(i, own.choice(texts)) for i in range(60)]
    seen, want = {}, {}
    for i, t in rows:
        text = t or ""
        key = " ".join(text.split()).upper() if sum(c.isalnum() for c in text) >= 200 else "s" + text
        want[i] = (seen.setdefault(key, (i, text))[0], "New" if seen[key][0] == i else "Exact" if seen[key][1] == text else "Content")
    assert {r.doc_id: (r.original_id, r.kind) for r in first_wins(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_column_bands_as_a_loop(spark):
    from lendmill.operators.extract import column_bands

    own = random.Random(5)
    edges = {(d, float(own.randint(0, 90))) for d in range(8) for _ in range(25)}
    got = {(r.doc_id, r.x0): (r.band, r.edge) for r in column_bands(spark.createDataFrame(sorted(edges), "doc_id long, x0 double")).collect()}
    for doc in range(8):
        number, start = 0, None
        for x in sorted(x for d, x in edges if d == doc):
            if start is None or x - start > 6:
                number, start = number + 1, x
            assert got[doc, x] == (number, start)


def test_audit_tables_replace_their_own_run(spark, sf, tmp_path):
    from lendmill.plans.policy import facts, offers
    from lendmill.sources import sinks

    applications, rules = sinks.application_rows(facts(spark, sf), offers(spark, sf)), sinks.rule_rows(offers(spark, sf))
    audit = sinks.audit_rows(applications, applications.select("app_id", F.lit("ABCDE1234F").alias("pan_no")))
    for run in ("1", "2", "2"):
        sinks.write_audit(applications, rules, audit, str(tmp_path), run)
    assert spark.read.parquet(f"{tmp_path}/application").count() == 2 * applications.count()
    assert spark.read.parquet(f"{tmp_path}/rule_execution").count() == 2 * rules.count()
    assert "ABCDE1234F" not in str(spark.read.parquet(f"{tmp_path}/audit_log").select("details").distinct().collect())


def test_runs_and_starts_as_loops(spark):
    from lendmill.operators import runs

    own = random.Random(9)
    rows = [(d, own.randint(1, 2), s, float(own.randint(0, 40)), 0.0, float(own.randint(0, 12)), float(own.choice((8, 10, 20))), f"t{s}") for d in range(6) for s in range(60)]
    rows = [(d, p, s, x, x + own.randint(3, 15), b, z, t) for d, p, s, x, _, b, z, t in rows]
    got = {(r.doc_id, r.text) for r in runs.assemble_runs(spark.createDataFrame(rows, "doc_id long, page int, seq long, x0 double, x1 double, baseline double, size double, text string")).collect()}
    want, group = set(), []
    for r in [*sorted(rows, key=lambda r: r[:3]), None]:
        if group and r is not None:
            a = group[0]
            right = max(g[4] for g in group)
            joins = a[:2] == r[:2] and abs(a[5] - r[5]) <= min(a[6], r[6]) * 0.5 and max(a[6], r[6]) / min(a[6], r[6]) <= 1.6 and r[3] - right <= r[6] and r[3] >= a[3] - r[6]
            if joins:
                group.append(r)
                continue
        if group:
            want.add((group[0][0], " ".join(g[7] for g in group)))
        group = [r]
    assert got == want
    marks = [(d, own.randint(1, 3), float(own.randint(0, 700)), s) for d in range(6) for s in range(30)]
    kept = {tuple(r) for r in runs.account_starts(spark.createDataFrame(marks, "doc_id long, page int, y0 double, seq long")).collect()}
    expected = set()
    for doc in range(6):
        last = None
        for m in sorted(m for m in marks if m[0] == doc):
            if last and (m[1] == last[1] and m[2] - last[2] < 100 or m[1] == last[1] + 1 and abs(m[3] - last[3]) < 20):
                continue
            last = m
            expected.add(m)
    assert kept == expected
