"""Facts read back through every foreign key: which member each role points to, with its rows and sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import star
from . import bindings as b
from .registered import query

_NONE = "'zzNull'"


def _by_role(rows: DataFrame, fact: star.Fact, measure: str, lookup_rows: int = star.LOOKUP_ROWS) -> DataFrame:
    """``fk, member, rows, amount``: the fact's rows per foreign key and the attributes of the member behind it."""
    members, built = star.load_fact(rows, fact, lookup_rows=lookup_rows)
    links = F.array(*[F.struct(F.lit(fk).alias("fk"), F.lit(name).alias("dimension"), F.col(fk).alias("key")) for fk, (name, _) in fact.links.items()])
    sums = built.select(F.explode(links).alias("link"), F.col(measure).alias("amount")).groupBy("link.fk", "link.dimension", "link.key").agg(
        F.count("*").alias("rows"), F.sum("amount").alias("amount")
    )
    named = sums.join(members, ["dimension", "key"], "left")
    return named.select("fk", F.array_join("attributes", "|", "-").alias("member"), "rows", F.col("amount").cast("double").alias("amount"))


def _sql(cte: str, source: str, measure: str, roles: dict[str, list[str]]) -> str:
    parts = [
        f"SELECT '{fk}' AS fk, " + " || '|' || ".join(f"coalesce(CAST({a} AS VARCHAR), '-')" for a in attributes)
        + f" AS member, count(*) AS rows, CAST(sum({measure}) AS DOUBLE) AS amount FROM {source} GROUP BY 2"
        for fk, attributes in roles.items()
    ]
    return f"WITH {cte} " + " UNION ALL ".join(parts)


# The driver's charges have one provider; the other roles get their attributes from columns that differ from it.
_EXTRA = {
    "BillingProviderNpi": "BillDepartmentName", "BillingProviderFullName": "BillLocationName", "ReferringProviderNpi": "BillLocationName",
    "ReferringProviderFullName": "BillDepartmentName", "RenderingProviderSpecialty": "BillLocationName", "BillingProviderSpecialty": "PatientGender",
    "ReferringProviderSpecialty": "TransactionType", "ChargePayerName": "BillLocationName", "ChargePayerFinancialClass": "TransactionType",
    "InvoiceNumber": "PatientId", "CptCode": "BillDepartmentId", "Modifier1": "TransactionType", "PrimaryIcdCode": "BillDepartmentName",
    "PlaceOfServiceCode": "BillDepartmentId", "BillingProviderTaxId": "BillLocationName", "PatientAge": "PatientRace", "PatientState": "BillLocationName",
}


def _charges(spark, folder) -> DataFrame:
    rows = b.charges(spark, folder)
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.withColumns({new: blank(old) for new, old in _EXTRA.items()})


def _n(column: str) -> str:
    """The derived attribute: null where the column is blank, and the null key for it."""
    return f"coalesce(nullif({column}, ''), {_NONE})"


def _person(npi: str, full: str, first: str = _NONE) -> list[str]:
    return [first, _NONE, _NONE, full, _NONE, npi, _NONE]


_CHARGE_ROLES = {
    "ChrgIdFnbr": ["ChargeId"], "TransactionPostDateFnbr": ["posted"], "ChargePostDateFnbr": ["posted"], "DateOfServiceFnbr": ["served"],
    "TranTypeFnbr": [_NONE] * 2, "PatAgeFnbr": [_n("PatientRace")], "GenderFnbr": ["PatientGender"], "BillDeptFnbr": ["BillDepartmentId", "BillDepartmentName"],
    "BillLocFnbr": [_NONE, "BillLocationName", *[_NONE] * 4], "BillPracFnbr": [_NONE] * 2,
    "ChargePayerFnbr": [_n("BillLocationName"), _NONE, _n("TransactionType")], "TransactionPayerFnbr": [_n("BillLocationName"), _NONE, _n("TransactionType")],
    "PatFnbr": ["PatientId", _NONE, _n("BillLocationName"), _NONE, _NONE], "PatRaceFnbr": ["PatientRace"], "PatMarStatusFnbr": [_NONE],
    "PosFnbr": [_n("BillDepartmentId"), _NONE, _NONE], "CptFnbr": [_n("BillDepartmentId"), _NONE, "year(served)", _n("TransactionType"), *[_NONE] * 3],
    "BillProvSpecialtyFnbr": [_n("PatientGender")], "RenderProvSpecialtyFnbr": [_n("BillLocationName")], "ReferProvSpecialtyFnbr": [_n("TransactionType")],
    "BillProvFnbr": _person(_n("BillDepartmentName"), _n("BillLocationName")),
    "RenderProvFnbr": _person("RenderingProviderNpi", "RenderingProviderFullName", "RenderingProviderFirstName"),
    "ReferProvFnbr": _person(_n("BillLocationName"), _n("BillDepartmentName")),
    "PrimaryIcdCodeFnbr": [_n("BillDepartmentName"), _NONE], "SecondaryIcdCodeFnbr": [_NONE] * 2, "InvoiceFnbr": [_n("PatientId")],
    "ReasonCodeFnbr": [_NONE] * 3, "TinFnbr": [_n("BillLocationName")],
}


@query("fact_charge_roles", _sql(b.CHARGES, "charges", "charged", _CHARGE_ROLES), stores=True)
def fact_charge_roles(spark, folder) -> DataFrame:
    return _by_role(_charges(spark, folder), star.CHARGES, "ChargeAmtOrig")


@query("fact_charge_roles_joined", _sql(b.CHARGES, "charges", "charged", _CHARGE_ROLES), stores=True)
def fact_charge_roles_joined(spark, folder) -> DataFrame:
    """The same where every dimension is too large to be looked up in memory."""
    return _by_role(_charges(spark, folder), star.CHARGES, "ChargeAmtOrig", lookup_rows=0)


_TRANSACTION_ROLES = {
    "TransactionPostDateFnbr": ["posted"], "DateOfServiceFnbr": ["posted"], "TranTypeFnbr": ["TransactionType", _NONE],
    "ChargePayerFnbr": [_NONE] * 3, "TransactionPayerFnbr": [_NONE] * 3, "ReasonCodeFnbr": ["CptCode", _NONE, _NONE], "InvoiceFnbr": ["ChargeId"],
}


@query("fact_transaction_roles", _sql(b.TRANSACTIONS, "transactions", "paid", _TRANSACTION_ROLES).replace("sum(paid)", "sum(CAST(paid AS DECIMAL(14,2)))"), stores=True)
def fact_transaction_roles(spark, folder) -> DataFrame:
    rows = b.transactions(spark, folder).withColumns({"DateOfService": F.col("PostDate"), "ReasonCode": F.col("CptCode"), "InvoiceNumber": F.col("ChargeId")})
    return _by_role(rows, star.TRANSACTIONS, "PaymentOrig")


_PAYROLL_ROLES = {
    "PayEmpFnbr": ["EmployeeId", _NONE, _NONE, _NONE, "EmployeeFullName", "EmployeeNpi"], "PayDeptFnbr": ["DepartmentId", "DepartmentName"],
    "JobCodeFnbr": [_NONE, "job"], "PayCodeFnbr": [f"{_NONE} || '_' || EarningsCode", "job || ': ' || EarningsCodeDesc"],
    "PayPeriodStartDateFnbr": ["period_end - (period_days - 1)"], "PayPeriodEndDateFnbr": ["period_end"], "PayChkDateFnbr": ["period_end + CASE WHEN early_check THEN -1 ELSE 5 END"],
}


@query("fact_payroll_roles", _sql(f"{b.PAYROLL}, paid AS (SELECT *, CASE WHEN job_class = 'Unclassified' THEN 'none' ELSE job_class END AS job FROM payroll)",
                                  "paid", "CAST(amount AS DECIMAL(10,2))", _PAYROLL_ROLES), stores=True)
def fact_payroll_roles(spark, folder) -> DataFrame:
    classes = {"Groundskeeper": "none", "Physician": "Physician", "Registered Nurse": "RN"}
    rows = b.payroll(spark, folder).withColumn("JobCodeDesc", b.case("JobCodeDesc", classes, "Admin/Patient Access"))
    return _by_role(rows, star.PAYROLL, "AmountOrig")


_APPOINTMENT_ROLES = {
    "SchdLocFnbr": [_NONE, "BillLocNameOrig"], "SchdDeptFnbr": [_NONE] * 2, "SchdProvFnbr": ["ApptProvNPI", *[_NONE] * 3], "ApptDateFnbr": ["CAST(appt AS DATE)"],
}


@query("fact_appointment_roles", _sql(b.SCHEDULING, "scheduling", "1", _APPOINTMENT_ROLES), stores=True)
def fact_appointment_roles(spark, folder) -> DataFrame:
    one = star.Fact(star.SCHEDULING.name, star.SCHEDULING.dimensions, star.SCHEDULING.links, {"one": star.Expression(lambda df: F.lit(1))})
    return _by_role(b.scheduling(spark, folder), one, "one")
