"""Acceptance rows: one small input, one expected finding."""

from datetime import date

import pytest
from conftest import severities
from pyspark.sql import functions as F

from ledgersieve.checks import conformance, cross_source as cross, universal
from ledgersieve.checks.registry import REGISTRY, register_check, run_checks
from ledgersieve.context import ColumnMeta, Context, TransactionTypes
from ledgersieve.findings import SCHEMA, emit, finding
from ledgersieve.operators import profile as prof

CHARGES, COMBINED = Context("billing_charges"), Context("billing_combined")


def blanks(n, total):
    return [("" if i < n else "x",) for i in range(total)]


@pytest.mark.parametrize("column, blank, expected", [
    ("PatientGender", 12, ["CRITICAL"]), ("PatientGender", 1, ["HIGH"]), ("CptCodeDesc", 3, ["MEDIUM"]),
    ("CptCodeDesc", 2, []), ("PatientRace", 6, ["INFO"]), ("PatientRace", 4, []),
])
def test_missing_values(rows, column, blank, expected):
    df = rows(column, *blanks(blank, 20))
    ctx = Context("billing_charges", columns=(ColumnMeta(column),))
    assert severities(universal.missing_values(prof.profile(df, ctx), ctx)) == [("null_blank", s) for s in expected]


def test_values_of_one_table(rows):
    df = rows("RenderingProviderNpi PostDate ChargeAmountOriginal BillLocationName",
              ("1234567890", "1970-01-01", "1,000.50", "CafÃ©"), ("12", "99/99/9999", "12x", "a\x01b"), ("1000000001", "2026-01-05", "", "ok"))
    ctx = Context("billing_charges", columns=(
        ColumnMeta("RenderingProviderNpi"), ColumnMeta("PostDate", sql_type="date"),
        ColumnMeta("ChargeAmountOriginal", sql_type="decimal", precision=14, scale=2), ColumnMeta("BillLocationName", max_length=3)))
    profile = prof.profile(df, ctx).cache()
    judged = {r.staging_column: r for r in conformance.judged(profile).collect()}
    assert judged["RenderingProviderNpi"].off_domain == 1 and judged["RenderingProviderNpi"].severity == "CRITICAL"
    assert judged["ChargeAmountOriginal"].bad_type == 1
    assert judged["PostDate"].bad_type == 0 and judged["PostDate"].dates == 2 and judged["PostDate"].mixed_dates
    assert judged["BillLocationName"].too_long == 1 and judged["BillLocationName"].longest == 5
    found = severities(universal.profile_findings(profile, ctx))
    assert ("epoch_dates", "MEDIUM") in found and ("encoding_issues", "MEDIUM") in found
    assert severities(universal.placeholder_findings(df, ctx)) == [("placeholder_data", "HIGH")]


def test_empty_table_and_absent_columns(rows, spark):
    empty = rows("PostDate ChargeAmountOriginal").where("false")
    ctx = Context("billing_charges", window=(date(2026, 1, 1), date(2026, 1, 31)), columns=(ColumnMeta("PostDate", sql_type="date"),))
    assert severities(universal.universal_findings(empty, ctx)) == []
    found = run_checks(empty, ctx)
    assert set(found.columns) == set(SCHEMA)
    got = {r.check_id: r for r in found.collect()}
    assert "skipped" in got["B3"].message and "B4" not in got


def test_billing(rows):
    types = TransactionTypes(frozenset({"CHG"}), frozenset(), frozenset({"PMT"}), frozenset())
    ctx = Context("billing_combined", types=types)
    only_charges = rows("TransactionType", ("CHG",), ("CHG",))
    assert severities(run_checks(only_charges, ctx, ["B1"])) == [("B1", "CRITICAL")]
    df = rows(
        "TransactionType CptCode WorkRvuOriginal Units PrimaryIcdCode ChargeAmountOriginal",
        ("CHG", "99213", "0", "1", "250.00,401.9", "0"), ("void", "80053", "0", "1", "250.0", "-5"), ("CHG", "99213-25", "1", "-2", "E11.9", "200000"))
    got = severities(run_checks(df, CHARGES, ["B3", "B4", "B7", "B8", "B10"]))
    assert got.count(("B10", "MEDIUM")) == 2
    assert ("B3", "HIGH") in got and ("B7", "MEDIUM") in got and ("B8", "HIGH") in got and ("B8", "MEDIUM") in got
    assert ("B4", "HIGH") in got and ("B4", "INFO") in got and ("B4", "MEDIUM") not in got  # the negative row is a void


def test_code_sets(rows):
    cpt = rows("CptCode WorkRvu StatusIndicator", ("99213", "1.3", "A"), ("99214", "1.9", "D"))
    df = rows("CptCode WorkRvuOriginal", ("99213", "1.3"), ("99213", "9"), ("99213", "9"), ("99214", "1.9"), ("99999", "1"))
    found = run_checks(df, Context("billing_charges", ref_cpt=cpt), ["B13"])
    rows_ = {(r.severity, r.affected) for r in found.collect()}
    assert rows_ == {("HIGH", 1), ("MEDIUM", 1)}  # unknown code; one retired, one off by more than 20 %
    assert found.count() == 3


def test_scheduling(rows):
    ctx = Context("scheduling", test_month="2026-01")
    df = rows("ApptStatus ApptSchdLength CheckInDate CheckOutDate ApptDate CancellationDate",
              ("COMP", "0", "2026-01-02 10:00", "2026-01-02 09:00", "2026-01-02", ""), ("COMP", "30", "", "", "2026-02-02", ""),
              ("Cancelled", "15", "", "", "2026-01-03", ""), ("???", "15", "", "", "bad", ""))
    got = severities(run_checks(df, ctx, ["S1", "S2", "S3", "S4", "S7", "S8"]))
    assert ("S1", "HIGH") in got and ("S2", "HIGH") in got and ("S3", "MEDIUM") in got and ("S4", "MEDIUM") in got
    assert ("S7", "HIGH") in got and ("S8", "MEDIUM") in got  # no no-show
    assert severities(run_checks(rows("ApptStatus", ("COMP",)), ctx, ["S8"]), "S8") == ["HIGH", "INFO", "MEDIUM"]


def test_payroll(rows):
    df = rows("EmployeeId PayPeriodStartDate PayPeriodEndDate Hours AmountOrig EarningsCodeDesc JobCodeDesc",
              ("1", "2026-01-01", "2026-01-14", "-40", "100", "REG PAY", "Physician"), ("1", "2026-01-01", "2026-01-14", "540", "100", "REG PAY", "Physician"),
              ("2", "2026-01-14", "2026-01-01", "-8", "-5", "Pay adjustment", "Front Desk"))
    got = severities(run_checks(df, Context("payroll")))
    assert got.count(("P1", "HIGH")) == 1 and got.count(("P1", "MEDIUM")) == 2  # row over 200, period over 400
    assert ("P3", "CRITICAL") in got and ("P7", "CRITICAL") in got
    assert ("P2", "MEDIUM") not in got


def test_ledger(rows):
    df = rows("CostCenterNumberOrig CostCenterNameOrig AcctNumber AcctDesc AmountOrig YearMonth",
              ("1", "North", "10", "Gross charges", "100", "202601"), ("1", "North A", "20", "Physician compensation", "-60", "202601"),
              ("2", "South", "20", "Physician compensation", "-60", "999999"))
    got = severities(run_checks(df, Context("gl", test_month="2025-12")))
    assert ("G2", "HIGH") in got and ("G4", "HIGH") in got and ("G6", "HIGH") in got and ("G6", "MEDIUM") in got
    assert got.count(("G7", "MEDIUM")) == 2  # charges without adjustments; compensation without charges
    no_charge = df.where("AcctNumber = '20'")
    assert "CRITICAL" in severities(run_checks(no_charge, Context("gl"), ["G4"]), "G4")


def test_quality_and_surveys(rows):
    df = rows("Performance~Rate Numerator Denominator", ("105", "80", "50"), ("", "1", "0"))
    found = run_checks(df, Context("quality"), ["Q1", "Q2"])
    assert severities(found, "Q1") == ["HIGH", "HIGH"] and severities(found, "Q2") == ["HIGH", "MEDIUM", "MEDIUM"]
    survey = rows("Provider~NPI Question~Order Score", ("1", "1", "4"), ("1", "2", "5"), ("1", "4", "0"), ("2", "0", "3"), ("2", "0", "3"))
    got = {(r.check_id, r.severity, r.affected) for r in run_checks(survey, Context("patient_satisfaction"), ["PS1", "PS3", "PS4"]).collect()}
    assert ("PS3", "MEDIUM", 2) in got and ("PS1", "HIGH", 1) in got and ("PS4", "MEDIUM", 5) in got


def test_links_and_balances(rows):
    charges = rows("ChargeId ChargeAmountOriginal", *[(f"c{i}", "10") for i in range(10)])
    moves = [(f"c{i}", "-10") for i in range(6)] + [("x1", "-1"), ("x2", "-1")]
    txn = rows("ChargeId PaymentOriginal", *moves)
    found = cross.transaction_match_rate(charges, txn, CHARGES).first()
    assert (found.severity, found.pct) == ("MEDIUM", 75.0)
    assert cross.transaction_match_rate(charges, rows("ChargeId", *[(m,) for m, _ in moves], ("x3",)), CHARGES).first().severity == "HIGH"
    balance = cross.payment_balance(charges, txn, CHARGES).first()
    assert balance.severity == "HIGH" and balance.affected == 6 and balance.metrics["outstanding"] == 40.0


def test_patient_ids_without_leading_zeros(rows):
    billing = rows("PatientId", ("00123",), ("00124",), ("00125",))
    sched = rows("PatIdOrig", ("123",), ("124",), ("125",), ("126",))
    found = cross.patient_coverage(billing, sched, CHARGES).first()
    assert (found.severity, found.affected) == ("INFO", 3)
    both = cross.patient_coverage(billing, rows("PatIdOrig", ("00123",), ("124",)), CHARGES).first()
    assert (both.affected, both.severity) == (1, "MEDIUM")


def test_department_offset(rows):
    ids = [f"88{n}000" for n in range(18744, 18749)] + ["lost"]
    payroll = rows("DepartmentId", *[(i,) for i in ids], *[("lost",)] * 100)
    ledger = rows("CostCenterNumberOrig CostCenterNameOrig", *[(str(n), f"C{n}") for n in range(18740, 18750)], ("", "blank"))
    match = {r.dept: r for r in cross.department_match(payroll, ledger).collect()}
    assert match["8818748000"].matched and (match["8818748000"].start, match["8818748000"].size) == (2, 5)
    assert not match["lost"].matched and match["lost"].rows == 101
    found = cross.payroll_ledger_departments(payroll, ledger, Context("payroll")).first()
    assert found.severity == "HIGH" and "2 to 7" in found.message
    few = rows("DepartmentId", *[(i,) for i in ids[:3]])
    assert cross.payroll_ledger_departments(few, ledger, Context("payroll")).first().severity == "MEDIUM"


def test_registered_check_runs(rows):
    def too_many(df, ctx):
        return emit(df.agg(F.count("*").alias("n")), ctx, [finding("X1", F.when(F.col("n") > 1, "LOW"), "many")])

    register_check("X1", ["billing_charges"], too_many)
    try:
        assert severities(run_checks(rows("a", ("1",), ("2",)), CHARGES, ["X1"])) == [("X1", "LOW")]
    finally:
        REGISTRY.pop("X1")


def test_eligibility():
    assert cross.eligible(["billing_charges", "gl"]) and not cross.eligible(["billing_charges", "billing_transactions", "quality"])
