"""Report rows of all rules against a plain model of the reference's texts."""

import __spark_entry__ as entry
from lendmill.plans import policy as plans


def texts(r: dict) -> dict[str, tuple[str, str, str]]:
    """What a report says for each rule id of an applicant (facts) at a lender (policy)."""
    num = lambda x: str(int(x)) if x == int(x) else str(x)
    rupees = lambda x, n: f"Rs {x:,.{n}f}"
    least = lambda name, unit="": f">= {num(r[name])}{unit}" if r[name] is not None else None
    kind, rental = str(r["write_off_class"]), r["rental_class"]
    kind_flag = r.get(f"allow_{kind.lower()}_write_off")
    rental_flag = r.get(f"allow_rental_{rental.lower()}")
    many = lambda name: f"{num(r[name])} yrs"
    two = lambda name: f"{r[name]:.2f} yrs" if r[name] is not None else None
    both = r["se_combined_itr_rule"]
    return {
        "DEM-101": lambda: ("Minimum Age", num(r["age"]), least("min_age")),
        "DEM-104": lambda: ("NRI/PIO Accepted", "NRI/PIO", str(r["allow_nri"])),
        "DEM-105": lambda: ("NRI Minimum Stay", two("nri_stay_years"), least("min_nri_stay_years", " yrs")),
        "BUR-404": lambda: ("Currently Outstanding", str(r["currently_overdue"]), "False"),
        "BUR-405": lambda: ("CIBIL Score", num(r["cibil"]), least("min_cibil")),
        "BUR-406": lambda: ("Loan Enquiries", "Yes" if r["has_loan_enquiry"] else "No", "Any" if r["allow_loan_enquiry"] else "No"),
        "BUR-403": lambda: ("DPD History", num(r["dpd"]), "<= 0"),
        "BUR-402": lambda: ("DPD History", num(r["dpd"]), f"<= {num(r['max_dpd'])}"),
        "BUR-401D": lambda: ("Unclassified Write-off", rupees(r["write_off_amount"], 2), "classified type required"),
        "BUR-401": lambda: (f"{kind} Write-off", kind, str(kind_flag)),
        "BUR-401B": lambda: ("Credit Card Write-off Amount", rupees(r["write_off_amount"], 2), f"< {rupees(r['max_cc_write_off_amount'], 2)}"),
        "ENT-501": lambda: ("HUF Accepted", "HUF", str(r["allow_huf"])),
        "ENT-502": lambda: ("Agriculture Sector", "Agriculture", str(r["allow_agriculture"])),
        "INC-601": lambda: ("Rental Income Configuration", rental, str(rental_flag)),
        "EMP-SAL-202": lambda: ("Minimum Salary", rupees(r["salary"], 2), f">= {rupees(r['min_salary'], 0)}"),
        "EMP-SAL-203": lambda: ("Salary Payment Mode", r["salary_mode"], "Bank Credit"),
        "EMP-SAL-204": lambda: ("Total Work Experience", f"{r['work_exp_years']:.2f}", least("min_total_experience_years", " yrs")),
        "EMP-SAL-205": lambda: ("Current Company Tenure", f"{r['current_company_years']:,.2f} yrs", least("min_current_company_tenure_years", " yrs")),
        "EMP-SAL-207": lambda: ("No Income Proof Segment", "No Income Proof", str(r["allow_no_income_proof"])),
        "EMP-SAL-206": lambda: ("Form-16 History", many("form_16_years"), least("form16_years_required", " yrs")),
        "DEM-102": lambda: ("Age at Last EMI (Salaried)", num(r["age_emi"]), f"<= {num(r['max_age_emi_salaried'])}"),
        "EMP-SE-301": lambda: ("Business ITR Years", many("business_itr_years"), least("min_business_itr_years", " yrs")),
        "EMP-SE-304": lambda: ("ITR Filed", "Not Filed", str(r["allow_itr_not_filed"])),
        "EMP-SE-302": lambda: ("Current-Year ITR", rupees(r["itr_now"], 0), f">= {rupees(r['se_min_current_itr'], 0)}"),
        "EMP-SE-303": lambda: ("Combined ITR", rupees(r["itr_now"] + r["itr_before"], 0), ">= Rs 600,000") if both else ("Previous-Year ITR", rupees(r["itr_before"], 0), f">= {rupees(r['se_min_prev_itr'], 0)}"),
        "BUS-302": lambda: ("Business Proof", str(r["business_proof"]), "Mandatory"),
        "DEM-103": lambda: ("Age at Last EMI (Self-Employed)", num(r["age_emi"]), f"<= {num(r['max_age_emi_self_employed'])}"),
        "RES-206": lambda: ("Rented Premises With Guarantor", "With a Guarantor", str(r["allow_with_guarantor"])),
        "RES-205": lambda: ("Rented Premises Without Guarantor", "Without a Guarantor", str(r["allow_without_guarantor"])),
        "REL-502": lambda: ("Separate Premises Both Rented", "Residence + separate office both rented", str(r["allow_separate_both_rented"])),
        "COA-801": lambda: ("Sibling Co-Applicant", "Brother/Sister", str(r["allow_sibling_coapplicant"])),
        "REL-501": lambda: ("Existing Account Holder", r["existing_account_bank"] or "None", f"not {r['bank_code']}"),
        "EXB-702": lambda: ("Existing Car Loan", r["car_loan_bank"], f"not {r['bank_code']}"),
        "ALPHA-RSK-001": lambda: ("Tenant CIBIL Floor", num(r["cibil"]), ">= 720"),
    }


def test_report_rows_of_all_rules(spark, sf):
    offered = {r.app_id: r.asDict() for r in plans.offers(spark, sf).filter("bank_code = selected_bank").collect()}
    applied = plans.p.outcomes(plans.offers(spark, sf).filter("bank_code = selected_bank")).collect()
    got = entry.queries()["report_rows_all"](spark, sf).collect()
    assert sorted((r.app_id, r.bank_code, r.rule_no, r.rule_id, "PASS" if r.passed else "FAIL") for r in applied) == sorted((r.app_id, r.bank_code, r.rule_no, r.rule_id, r.status) for r in got)
    wrong = [(r, want) for r in got if (r.parameter_name, r.user_value, r.limit_value) != (want := texts(offered[r.app_id])[r.rule_id]())]
    assert not wrong, (len(wrong), wrong[:5])
    assert len({r.rule_id for r in got}) > 20
