"""Registered queries for details that the wider queries leave out: labels, patterns, absent categories, natural keys of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..checks import cross_source as cross, quality
from ..checks.registry import run_checks
from ..context import ColumnMeta, Context, TransactionTypes
from ..findings import report
from ..functions.classify import confidence
from ..operators import catalog, issues, profile as prof, star
from . import bindings as b
from .registered import found, query, row, when

GL = Context("gl")


def _run(df: DataFrame, ctx: Context, ids: list[str]) -> DataFrame:
    return report(run_checks(df, ctx, ids))


# Labels and how sure they are.

_JOBS = [("Groundskeeper", 0), ("Registered Nurse", 2500), ("Physician, Medical Assistant", 5000), ("Front Desk Clerk", 7500)]
_JOB_SQL = "CASE " + " ".join(f"WHEN s_acctbal < {limit} THEN '{name}'" for name, limit in _JOBS) + " ELSE 'Staff Nurse and Technician' END"
_HITS = " + ".join(f"CAST(regexp_matches(job, '(?i){pattern}') AS INTEGER)" for _, pattern in rules.JOB_CLASSES)


@query("class_confidence", f"""WITH j AS (SELECT {_JOB_SQL} AS job FROM supplier), h AS (SELECT job, {_HITS} AS hits FROM j)
 SELECT job, CASE WHEN hits = 1 THEN 'HIGH' WHEN hits > 1 THEN 'LOW' ELSE 'NONE' END AS confidence, count(*) AS suppliers FROM h GROUP BY ALL""")
def class_confidence(spark, folder) -> DataFrame:
    jobs = b.table(spark, folder, "supplier").select(F.expr(_JOB_SQL).alias("job"))
    return jobs.groupBy("job", confidence("job", rules.JOB_CLASSES).alias("confidence")).agg(F.count("*").alias("suppliers"))


# All patterns of values, each broken by some rows.

_SHAPES = {
    "CptCode": ("CASE p_size % 4 WHEN 0 THEN '9921' WHEN 1 THEN 'T' || lpad(CAST(p_size AS VARCHAR), 4, '0') ELSE lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') END", "p_size % 4 = 0"),
    "PrimaryIcdCode": ("CASE p_size % 5 WHEN 0 THEN 'U99' WHEN 1 THEN 'E11.9' ELSE 'A' || lpad(CAST(p_size AS VARCHAR), 3, '0') END", "p_size % 5 = 0"),
    "PlaceOfServiceCode": ("CASE WHEN p_size % 7 = 0 THEN '111' ELSE CAST(p_size AS VARCHAR) END", "p_size % 7 = 0"),
    "YearMonth": ("CASE WHEN p_size % 6 = 0 THEN '2026-01' ELSE CAST(202600 + p_size % 12 + 1 AS VARCHAR) END", "p_size % 6 = 0"),
    "Modifier1": ("CASE p_size % 3 WHEN 0 THEN '25x' ELSE lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') END", "p_size % 3 = 0"),
    "PatientZip": ("CASE WHEN p_size % 9 = 0 THEN '1234' ELSE lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') || '-0001' END", "p_size % 9 = 0"),
    "EmployeeNpi": ("CASE WHEN p_size % 8 = 0 THEN '12345' ELSE lpad(CAST(p_partkey AS VARCHAR), 10, '1') END", "p_size % 8 = 0"),
}


@query("value_patterns", " UNION ALL ".join(
    f"SELECT '{name}' AS staging_column, count(*) AS filled, count(*) FILTER ({odd}) AS off_domain FROM part" for name, (_, odd) in _SHAPES.items()
))
def value_patterns(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "part").selectExpr(*[f"{sql.replace('VARCHAR', 'STRING')} AS {name}" for name, (sql, _) in _SHAPES.items()])
    ctx = Context(columns=tuple(ColumnMeta(name) for name in _SHAPES))
    return prof.profile(df, ctx).select("staging_column", F.col("filled").cast("bigint").alias("filled"), F.col("off_domain").cast("bigint").alias("off_domain"))


# How billing was submitted.

# Every customer is a client, and what has become of its orders says which files it sent.

_SENT = {"F": "billing_charges", "O": "billing_transactions", "P": "billing_combined"}


@query("billing_formats", """SELECT CASE WHEN p THEN 'combined' WHEN f AND o THEN 'separate' WHEN f OR o THEN 'unknown' ELSE 'none' END AS format, p AND (f OR o) AS beside,
 count(*) AS clients FROM (SELECT o_custkey, bool_or(o_orderstatus = 'F' AND o_totalprice > 150000) AS f, bool_or(o_orderstatus = 'O' AND o_totalprice > 150000) AS o,
 bool_or(o_orderstatus = 'P' AND o_totalprice > 150000) AS p FROM orders GROUP BY 1) GROUP BY ALL""")
def billing_formats(spark, folder) -> DataFrame:
    sent = F.when(F.col("o_totalprice") > 150000, b.case("o_orderstatus", _SENT)).otherwise("payroll")
    sources = b.table(spark, folder, "orders").select(F.col("o_custkey").alias("client"), sent.alias("source"))
    found = catalog.billing_format(sources, "client")
    return found.groupBy("format", F.col("notes").contains("beside").alias("beside")).agg(F.count("*").alias("clients"))


@query("source_date_ranges", """WITH m AS (SELECT 'billing' AS g, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders
 UNION ALL SELECT 'billing', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)) FROM lineitem UNION ALL SELECT 'scheduling', min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) FROM events)
 SELECT g AS source_group, CAST(min(lo) AS VARCHAR) AS min_date, CAST(max(hi) AS VARCHAR) AS max_date FROM m GROUP BY 1""")
def source_date_ranges(spark, folder) -> DataFrame:
    def span(source: str, name: str, column: str) -> DataFrame:
        day = F.to_date(column)
        return b.table(spark, folder, name).agg(F.min(day).alias("min_date"), F.max(day).alias("max_date")).select(F.lit(source).alias("source"), "min_date", "max_date")

    months = span("billing_charges", "orders", "o_orderdate").unionByName(span("billing_transactions", "lineitem", "l_shipdate")).unionByName(span("scheduling", "events", "ts"))
    return issues.date_ranges(months).select("source_group", F.col("min_date").cast("string").alias("min_date"), F.col("max_date").cast("string").alias("max_date"))


# Absent categories of the ledger.

_GONE = {"Gross patient charges": "Charges", "Contractual allowance": "Adjustments", "Office supplies": "Other Operating Expenses"}


@query("absent_categories", " UNION ALL ".join(
    [f"SELECT 'G4' AS check_id, '{severity}' AS severity, '{name}' AS template_field WHERE EXISTS (SELECT 1 FROM lineitem)"
     for name, severity in rules.REQUIRED_CATEGORIES if name in _GONE.values()]
    + [f"SELECT 'G4', 'INFO', '{name}' WHERE EXISTS (SELECT 1 FROM lineitem)" for name in rules.RECOMMENDED_CATEGORIES]
))
def absent_categories(spark, folder) -> DataFrame:
    ledger = b.ledger(spark, folder)
    renamed = ledger.withColumn("AcctDesc", F.when(F.col("AcctDesc").isin(*_GONE), "Miscellany").otherwise(F.col("AcctDesc")))
    return run_checks(renamed, GL, ["G4"]).select("check_id", "severity", "template_field")


# Documented variants.

@query("same_provider", found(
    f"{b.CHARGES}, m AS (SELECT count(*) AS t, count(*) FILTER (CAST(ChargeId AS BIGINT) % 3 = 0) AS s FROM charges)",
    row("rendering_is_billing", when("t > 0", "INFO"), "RenderingProviderNpi", "s", "t"),
))
def same_provider(spark, folder) -> DataFrame:
    charges = b.charges(spark, folder)
    other = F.when(F.col("ChargeId").cast("bigint") % 3 == 0, F.col("RenderingProviderNpi")).otherwise("9999999999")
    return _run(charges.withColumn("BillingProviderNpi", other), Context("billing_charges"), ["B.same_npi"])


@query("visit_sequence", found(
    "m AS (SELECT count(*) AS t, count(*) FILTER (value < 20) AS e, count(*) FILTER (value > 150) AS s FROM events)",
    row("check_in_before_appointment", when("e > 0", "MEDIUM"), "CheckInDate", "e", "t"), row("check_in_without_check_out", when("s > 0", "INFO"), "CheckOutDate", "s", "t"),
))
def visit_sequence(spark, folder) -> DataFrame:
    value, stamp = F.col("value"), "yyyy-MM-dd HH:mm:ss"
    visits = b.table(spark, folder, "events").select(
        F.date_format("ts", stamp).alias("ApptDate"),
        F.date_format(F.when(value < 20, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")), stamp).alias("CheckInDate"),
        F.when(value > 150, "").otherwise(F.date_format("ts", stamp)).alias("CheckOutDate"),
    )
    return _run(visits, Context("scheduling"), ["S.visit"])


@query("leave_hours", found(
    f"""{b.PAYROLL}, p AS (SELECT EmployeeId, period_end, sum(hours) AS h, sum(hours) FILTER (EarningsCode = 'A') AS l FROM payroll GROUP BY 1, 2),
 m AS (SELECT count(*) AS t, count(*) FILTER (h > 400) AS x, count(*) FILTER (h = 0) AS z, count(*) FILTER (l > 80) AS v FROM p)""",
    row("P1", when("x > 0", "MEDIUM"), "Hours", "x", "t"), row("period_without_hours", when("z > 0", "INFO"), "Hours", "z", "t"),
    row("period_leave_hours", when("v > 0", "INFO"), "Hours", "v", "t"),
))
def leave_hours(spark, folder) -> DataFrame:
    named = F.when(F.col("EarningsCode") == "A", "Vacation").otherwise(F.col("EarningsCodeDesc"))
    return _run(b.payroll(spark, folder).withColumn("EarningsCodeDesc", named), Context("payroll"), ["P1.periods"])


# Facts, read back through the natural keys of their members.

def _named(rows: DataFrame, fact: star.Fact, wanted: dict[str, tuple[str, str]], measure: str) -> DataFrame:
    """Rows and sum of a fact per natural key; ``wanted`` names the foreign key's attribute."""
    members, built = star.load_fact(rows, fact)
    dims = {d.name: star.dimension_table(members, d) for d in fact.dimensions}
    sums = built.groupBy(*wanted).agg(F.count("*").alias("rows"), F.sum(measure).alias("amount"))
    keys = {d.name: d.key for d in fact.dimensions}
    for fk, (attribute, shown) in wanted.items():
        name = fact.links[fk][0]
        side = dims[name].select(F.col(keys[name]).alias(fk), F.col(attribute).cast("string").alias(shown))
        sums = sums.join(side, fk)
    shown = [s for _, s in wanted.values()]
    return sums.groupBy(*shown).agg(F.sum("rows").alias("rows"), F.sum("amount").cast("double").alias("amount"))


@query("payroll_by_member", f"""WITH {b.PAYROLL} SELECT EmployeeId AS employee, DepartmentId AS department, CAST(period_end AS VARCHAR) AS period_end,
 count(*) AS rows, CAST(sum(CAST(amount AS DECIMAL(10,2))) AS DOUBLE) AS amount FROM payroll GROUP BY ALL""", stores=True)
def payroll_by_member(spark, folder) -> DataFrame:
    wanted = {"PayEmpFnbr": ("PayEmpId", "employee"), "PayDeptFnbr": ("PayDeptId", "department"), "PayPeriodEndDateFnbr": ("date", "period_end")}
    return _named(b.payroll(spark, folder), star.PAYROLL, wanted, "AmountOrig")


# Combined billing files, flags and ages.

_COMBINED_TYPES = TransactionTypes(frozenset(), frozenset({"1-urgent", "2-high"}), frozenset(), frozenset({"5-low"}))


def _combined(spark, folder) -> DataFrame:
    return b.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("TransactionTypeDesc"), b.text(b.cents("o_totalprice")).alias("ChargeAmountOriginal"))


@query("combined_split", """SELECT part, count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS amount FROM (SELECT o_totalprice,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'charges' WHEN o_orderpriority = '5-LOW' THEN 'transactions' END AS part FROM orders) WHERE part IS NOT NULL GROUP BY 1""")
def combined_split(spark, folder) -> DataFrame:
    parts = cross.split_combined(_combined(spark, folder), Context("billing_combined", types=_COMBINED_TYPES))
    rows = [df.select(F.lit(name).alias("part"), F.col("ChargeAmountOriginal").cast("decimal(14,2)").alias("a")) for name, df in zip(("charges", "transactions"), parts)]
    return rows[0].unionByName(rows[1]).groupBy("part").agg(F.count("*").alias("rows"), F.sum("a").cast("double").alias("amount"))


@query("combined_keyword_scope", """SELECT count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS amount FROM orders WHERE o_orderstatus = 'F'""", stores=True)
def combined_keyword_scope(spark, folder) -> DataFrame:
    """No row has a type that is known as a charge, so the rows whose type is named like one are the charges."""
    named = b.case("o_orderstatus", {"F": "New CHARGE", "O": "Pay"}, "Refund")
    df = b.table(spark, folder, "orders").select(named.alias("TransactionTypeDesc"), b.cents("o_totalprice").alias("a"))
    ctx = prof.with_charge_fact(df, Context("billing_combined", types=_COMBINED_TYPES))
    return df.where(prof.charge_scope(df, ctx, "keyword")).agg(F.count("*").alias("rows"), F.sum("a").cast("double").alias("amount"))


@query("inverse_flag_values", """SELECT flag AS value, CASE flag WHEN 'maybe' THEN 'unknown' WHEN 'N' THEN 'not inverse' ELSE 'inverse' END AS meaning, count(*) AS rows
 FROM (SELECT CASE WHEN toxic = 1 THEN 'maybe' WHEN quality = 1 THEN 'N' ELSE 'Y' END AS flag FROM labels JOIN documents USING (doc_id)) GROUP BY ALL""")
def inverse_flag_values(spark, folder) -> DataFrame:
    return quality.inverse_flag_values(b.quality(spark, folder))


@query("patient_domains", found(
    """m AS (SELECT count(*) AS t, count(*) FILTER (p_size % 3 = 0) AS g, count(*) FILTER (p_size > 40 OR p_size % 10 = 7) AS a FROM part)""",
    row("gender_domain", when("g > 0", "MEDIUM"), "PatientGender", "g", "t"), row("age_domain", when("a > 0", "MEDIUM"), "PatientAge", "a", "t"),
))
def patient_domains(spark, folder) -> DataFrame:
    size = F.col("p_size")
    rows = b.table(spark, folder, "part").select(
        F.when(size % 3 == 0, "n/a").when(size % 3 == 1, "Female").otherwise("").alias("PatientGender"),
        F.when(size % 10 == 7, "abc").when(size > 40, b.text(size * 3)).when(size % 10 == 3, "").otherwise(b.text(size)).alias("PatientAge"),
    )
    return _run(rows, Context("billing_charges"), ["B.domains"])
