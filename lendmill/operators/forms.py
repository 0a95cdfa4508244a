"""Application forms: derived fields and violations, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendmill.functions import pii

# What a residence and a workplace make of the property; a missing part stands for no answer.
PROPERTY = [
    ("Owned", None, None, "OWNED"), ("Rented", None, None, "RENTED"), ("Owned", "Same", None, "RESI_CUM_OFFICE_OWNED"), ("Rented", "Same", None, "RESI_CUM_OFFICE_RENTED"), ("Owned", "Separate", None, "OWNED"),
    ("Rented", "Separate", None, "RENTED"), ("Owned", "Separate", "Owned", "OWNED"), ("Owned", "Separate", "Rented", "OWNED"), ("Rented", "Separate", "Owned", "RENTED"), ("Rented", "Separate", "Rented", "SEPARATE_BOTH_RENTED"),
]
WRITE_OFF_ORDER = (("pl", "PL"), ("home", "HL"), ("consumer", "CONSUMER"), ("agri", "AGRI"), ("msme", "MSME"), ("auto", "AUTO"), ("cc", "CC"))
TENURE = {"Upto 6 months": 0, "6 months to 1 year": 6, "1 year to 2 years": 12, "2 years and above": 24}
PARTNERS = {"Bank of Baroda": "BOB", "Indian Bank": "INDIAN_BANK", "Indian Overseas Bank": "IOB", "Bank of India": "BOI", "Bank of Maharashtra": "BOM", "HDFC Bank": "HDFC", "Axis Bank": "AXIS", "Kotak Mahindra Bank": "KOTAK"}
LOAN_YEARS, PROXY_AGE, LAST_AGE = 7, 35, 60


def property_status(forms: DataFrame) -> DataFrame:
    """The form with its property status: a null-safe broadcast join of ten rows."""
    rows = forms.sparkSession.createDataFrame(PROPERTY, "p_residence string, p_office string, p_premises string, property_status string")
    same = F.col("residence").eqNullSafe(F.col("p_residence")) & F.col("office").eqNullSafe(F.col("p_office")) & F.col("premises").eqNullSafe(F.col("p_premises"))
    return forms.join(F.broadcast(rows), same, "left").drop("p_residence", "p_office", "p_premises")


def write_off(amount: Column) -> tuple[Column, Column]:
    """The class that counts when several boxes are ticked, and its amount: one rupee where none is given."""
    kind = F.coalesce(*(F.when(F.col(box), name) for box, name in WRITE_OFF_ORDER))
    given = F.coalesce(amount, F.lit(0.0))
    return kind, F.when(given > 0, given).when(kind.isNotNull(), 1.0).otherwise(0.0)


def lookup(value: Column, table: dict) -> Column:
    return reduce(lambda out, item: out.when(value == item[0], item[1]), list(table.items())[1:], F.when(value == next(iter(table)), next(iter(table.values()))))


def days_of_answers(missed: Column, over_90: Column) -> Column:
    """Days past due of two yes/no answers."""
    return F.when(missed & over_90, 90).when(missed, 30).otherwise(0)


def violations(forms: DataFrame) -> DataFrame:
    """Every form with the list of what is wrong with it, in a fixed order."""
    c = F.col
    broken = {
        "stay_months required": (c("identity") == "NRI") & c("stay_months").isNull(),
        "form_16 contradicts income_proof": (c("income_proof") == "Form 16") & ~F.coalesce("has_form_16", F.lit(False)),
        "previous employer required": (c("occupation") == "Salaried") & c("tenure").isin("Upto 6 months", "6 months to 1 year") & c("previous_employer").isNull(),
        "premises required": (c("office") == "Separate") & (c("identity") != "HUF") & c("premises").isNull(),
        "pl_score required": c("has_pl_score") & c("pl_score").isNull(),
        "write-off amount required": c("cc") & (F.coalesce("write_off_amount", F.lit(0.0)) <= 0),
        "score out of range": ~F.coalesce(c("score").between(300, 900), F.lit(False)),
        "pan malformed": ~F.coalesce(c("pan").rlike(pii.PAN), F.lit(False)),
        "pincode malformed": ~F.coalesce(c("pincode").rlike(pii.PINCODE), F.lit(False)),
    }
    return forms.select("form_id", F.array_compact(F.array(*(F.when(bad, name) for name, bad in broken.items()))).alias("violations"))


def engine_payload(forms: DataFrame) -> DataFrame:
    """A form flattened to the fields that policies read."""
    kind, amount = write_off(F.col("write_off_amount"))
    person = F.when(F.col("identity").isin("Company", "HUF"), PROXY_AGE).otherwise(F.col("age"))
    bank = lookup(F.col("account_bank"), PARTNERS)
    form = property_status(forms)
    return form.select(
        "form_id", F.when(F.col("identity") == "Company", "Company").when(F.col("identity") == "HUF", "HUF").otherwise("Individual").alias("entity_type"), (F.col("identity") == "NRI").alias("is_nri"),
        F.when(F.col("identity") == "NRI", F.col("stay_months") / 12.0).alias("nri_years"), person.alias("age"), (person + LOAN_YEARS).alias("age_at_last_emi"), "occupation", lookup(F.col("tenure"), TENURE).alias("current_company_tenure_months"),
        F.col("score").alias("cibil_score"), days_of_answers(F.col("missed"), F.col("over_90")).alias("dpd"), kind.alias("write_off_type"), amount.alias("write_off_amount"), F.coalesce(bank, F.lit("BOI")).alias("selected_bank"),
        bank.alias("existing_account_bank"), "property_status",
    )
