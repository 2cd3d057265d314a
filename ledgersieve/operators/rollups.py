"""Roll-ups over all sources, per cost center and per provider.

Every source is aggregated on its own, the small results are stacked and grouped
once: four outer joins become one shuffle of aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..checks.payroll import job_class
from ..context import Context
from ..functions import amount, classify, present, strip
from ..sources.steps import stored
from . import fuzzy
from .profile import charge_scope

MONEY = "decimal(30,4)"
NPI = r"^\d{10}$"

COST_CENTER_MEASURES = [
    "WorkRvu", "Charges", "Payment", "Adjustments", "CompletedAppointments", "ProviderHours", "ProviderAmount",
    "SupportStaffHours", "SupportStaffAmount", "GL_ProviderPayAmount", "GL_SupportStaffAmount",
    "GL_MedicalPracticeCharges", "GL_MedicalPracticeAdjustments", "QualityRecordCount",
]
PROVIDER_MEASURES = [
    "WorkRvu", "Charges", "Payment", "Adjustments", "CompletedAppointments", "PayrollHours", "PayrollAmount", "QualityRecordCount",
]
BILLING = ("billing_combined", "billing_charges", "billing_transactions")


def _sum(df: DataFrame, column: str, condition: Column | None = None) -> Column:
    if column not in df.columns:
        return F.lit(0).cast(MONEY)
    value = amount(column) if condition is None else F.when(condition, amount(column))
    return F.coalesce(F.sum(value), F.lit(0)).cast(MONEY)


def _first(df: DataFrame, column: str) -> Column:
    """First non-blank value in order."""
    if column not in df.columns:
        return F.lit(None).cast("string")
    return F.min(F.when(present(column), strip(column)))


def _charge(df: DataFrame, ctx: Context) -> Column:
    if ctx.source == "billing_transactions":
        return F.lit(False)
    return charge_scope(df, ctx, fallback="keyword")


def _billing(df: DataFrame, ctx: Context, by: Column, name: str, name_as: str) -> DataFrame:
    charge = _charge(df, ctx)
    return df.groupBy(by.alias("id")).agg(
        _first(df, name).alias(name_as),
        _sum(df, "WorkRvuOriginal", charge).alias("WorkRvu"),
        _sum(df, "ChargeAmountOriginal", charge).alias("Charges"),
        _sum(df, "PaymentOriginal", ~charge).alias("Payment"),
        _sum(df, "AdjustmentOriginal", ~charge).alias("Adjustments"),
    )


def _done(df: DataFrame) -> DataFrame:
    return df.where(F.lower(strip("ApptStatus")) == "completed") if "ApptStatus" in df.columns else df


def _npi(c: Column) -> Column:
    return F.when(strip(c).rlike(NPI), strip(c))


def _stack(parts: list[DataFrame], measures: list[str], names: list[str]) -> DataFrame:
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where(present("id"))
    for column in [*measures, *names]:
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(MONEY if column in measures else "string"))
    return rows.groupBy("id").agg(
        *[F.min(n).alias(n) for n in names],
        *[F.coalesce(F.sum(F.col(m).cast(MONEY)), F.lit(0)).cast("double").alias(m) for m in measures],
    )


def provider_centers(billing: list[tuple[DataFrame, Context]]) -> DataFrame:
    """``npi, id``: the first cost center a provider charges to."""
    parts = [
        df.where(_charge(df, ctx)).select(_npi(F.col("RenderingProviderNpi")).alias("npi"), strip("BillDepartmentId").alias("id"))
        for df, ctx in billing if {"RenderingProviderNpi", "BillDepartmentId"} <= set(df.columns)
    ]
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts).where(F.col("npi").isNotNull() & present("id"))
    return rows.groupBy("npi").agg(F.min("id").alias("id"))


def ledger_centers(df: DataFrame) -> DataFrame:
    """Cost-center sums of the four ledger categories the roll-up shows.

    Descriptions are classified once per center and description, after summing.
    """
    sums = df.groupBy(strip("CostCenterNumberOrig").alias("id"), F.col("AcctDesc").alias("desc")).agg(
        _first(df, "CostCenterNameOrig").alias("gl_name"), _sum(df, "AmountOrig").alias("amount"),
    )
    category = classify("desc", rules.LEDGER_CATEGORIES)

    def of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(category == name, F.col("amount"))), F.lit(0)).cast(MONEY)

    return sums.groupBy("id").agg(
        F.min("gl_name").alias("gl_name"),
        of("Provider Compensation").alias("GL_ProviderPayAmount"),
        of("Support Staff Compensation").alias("GL_SupportStaffAmount"),
        of("Charges").alias("GL_MedicalPracticeCharges"),
        of("Adjustments").alias("GL_MedicalPracticeAdjustments"),
    )


def payroll_centers(df: DataFrame) -> DataFrame:
    sums = df.groupBy(strip("DepartmentId").alias("id"), F.col("JobCodeDesc").alias("JobCodeDesc")).agg(
        _first(df, "DepartmentName").alias("pay_name"), _sum(df, "Hours").alias("hours"), _sum(df, "AmountOrig").alias("amount"),
    )
    label = job_class()

    def of(names: list[str], column: str) -> Column:
        return F.coalesce(F.sum(F.when(label.isin(names), F.col(column))), F.lit(0)).cast(MONEY)

    return sums.groupBy("id").agg(
        F.min("pay_name").alias("pay_name"),
        of(rules.PROVIDER_JOBS, "hours").alias("ProviderHours"),
        of(rules.PROVIDER_JOBS, "amount").alias("ProviderAmount"),
        of(rules.SUPPORT_JOBS, "hours").alias("SupportStaffHours"),
        of(rules.SUPPORT_JOBS, "amount").alias("SupportStaffAmount"),
    )


def appointment_places(scheduling: DataFrame, centers: DataFrame | None, scorer: str = "composite") -> DataFrame:
    """``id, place, CompletedAppointments``: completed appointments on the most similar cost center.

    Places below the threshold keep a row of their own, ``SCH:`` and the name.
    """
    places = _done(scheduling).select(strip("BillLocNameOrig").alias("place")).where(present("place")).groupBy("place").agg(
        F.count("*").alias("CompletedAppointments")
    )
    own = F.concat(F.lit("SCH:"), F.col("place"))
    if centers is None:
        return places.select(own.alias("id"), F.col("place"), "CompletedAppointments")
    places = stored(places, "places")
    names = stored(centers.where(present("gl_name")).groupBy(F.col("gl_name").alias("best")).agg(F.min("id").alias("center")), "centers")
    best = fuzzy.best_match(
        places.select(F.col("place").alias("text")), names.select(F.col("best").alias("text")), rules.LOCATION_FUZZY, scorer
    ).select(F.col("text").alias("place"), "best")
    matched = places.join(best, "place", "left").join(names, "best", "left")
    return matched.select(
        F.coalesce("center", own).alias("id"), F.when(F.col("center").isNull(), F.col("place")).alias("place"), "CompletedAppointments"
    )


def cost_centers(tables: dict[str, DataFrame], contexts: dict[str, Context], scorer: str = "composite") -> DataFrame:
    """One row per cost center over billing, scheduling, payroll, ledger and quality."""
    billing = [(tables[s], contexts[s]) for s in BILLING if s in tables]
    parts = [
        _billing(df, ctx, strip("BillDepartmentId"), "BillDepartmentName", "bill_name")
        for df, ctx in billing if "BillDepartmentId" in df.columns
    ]
    ledger = stored(ledger_centers(tables["gl"]), "ledger-centers") if "gl" in tables else None
    if ledger is not None:
        parts.append(ledger)
    if "payroll" in tables:
        parts.append(payroll_centers(tables["payroll"]))
    if "scheduling" in tables and "BillLocNameOrig" in tables["scheduling"].columns:
        parts.append(appointment_places(tables["scheduling"], ledger, scorer).withColumnRenamed("place", "place_name"))
    linked = provider_centers(billing)
    if "quality" in tables and linked is not None:
        records = tables["quality"].select(_npi(F.col("Provider NPI")).alias("npi")).where(F.col("npi").isNotNull()).groupBy(
            "npi"
        ).agg(F.count("*").alias("QualityRecordCount"))
        parts.append(records.join(linked, "npi").groupBy("id").agg(F.sum("QualityRecordCount").alias("QualityRecordCount")))
    names = ["gl_name", "bill_name", "pay_name", "place_name"]
    rows = _stack(parts, COST_CENTER_MEASURES, names)
    return rows.select(
        F.col("id").alias("CostCenterNumber"), F.coalesce(*names, F.lit("")).alias("CostCenterName"), *COST_CENTER_MEASURES
    )


def providers(tables: dict[str, DataFrame], contexts: dict[str, Context]) -> DataFrame:
    """One row per ten-digit NPI over billing, scheduling, payroll and quality."""
    parts = []
    for source in BILLING:
        if source in tables and "RenderingProviderNpi" in tables[source].columns:
            parts.append(_billing(
                tables[source], contexts[source], _npi(F.col("RenderingProviderNpi")), "RenderingProviderFullName", "name1"
            ))
    if "scheduling" in tables and "ApptProvNPI" in tables["scheduling"].columns:
        df = _done(tables["scheduling"])
        parts.append(df.groupBy(_npi(F.col("ApptProvNPI")).alias("id")).agg(
            _first(df, "ApptProvFullNameOrig").alias("name2"), F.count("*").alias("CompletedAppointments"),
        ))
    if "payroll" in tables and "EmployeeNpi" in tables["payroll"].columns:
        df = tables["payroll"]
        if "JobCodeDesc" in df.columns:
            df = df.where(job_class().isin(rules.PROVIDER_JOBS))
        parts.append(df.groupBy(_npi(F.col("EmployeeNpi")).alias("id")).agg(
            _first(df, "EmployeeFullName").alias("name3"), _sum(df, "Hours").alias("PayrollHours"), _sum(df, "AmountOrig").alias("PayrollAmount"),
        ))
    if "quality" in tables and "Provider NPI" in tables["quality"].columns:
        df = tables["quality"]
        parts.append(df.groupBy(_npi(F.col("Provider NPI")).alias("id")).agg(
            _first(df, "Provider Name").alias("name4"), F.count("*").alias("QualityRecordCount"),
        ))
    names = ["name1", "name2", "name3", "name4"]
    rows = _stack(parts, PROVIDER_MEASURES, names)
    return rows.select(F.col("id").alias("ProviderNPI"), F.coalesce(*names, F.lit("")).alias("ProviderName"), *PROVIDER_MEASURES)
