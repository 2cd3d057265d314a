"""Extract roles bound to the driver's tables.

The tables are clean, so blanks, orphans, odd codes and the like are derived from
values the rows already have (a negative balance, a tax rate, a status).  Every
column is text under its staging name, as a reader would deliver it.  Each role
has a SQL twin for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


# Given with the read, so that planning opens no file.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def cents(c: str) -> Column:
    return F.col(c).cast("decimal(14,2)")


def case(c: str, values: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in values.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def sql_case(c: str, values: dict[str, str], default: str | None = None) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {c} {cases} ELSE {repr(default) if default is not None else 'NULL'} END"


# Charges: one row per order, with the customer's organisation.

def charges(spark: SparkSession, folder: str, org: bool = True) -> DataFrame:
    rows = table(spark, folder, "orders")
    columns = [
        text("o_orderkey").alias("ChargeId"),
        text("o_custkey").alias("PatientId"),
        iso("o_orderdate").alias("PostDate"),
        iso(F.date_add("o_orderdate", F.when(F.col("o_orderstatus") == "P", 2).otherwise(-2))).alias("DateOfService"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), "")
        .otherwise(text(cents("o_totalprice"))).alias("ChargeAmountOriginal"),
        F.col("o_orderstatus").alias("TransactionType"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("PatientGender"),
    ]
    if org:
        rows = rows.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
            table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        columns += [
            F.when(F.col("c_acctbal") < 0, "").otherwise(text("c_nationkey")).alias("BillDepartmentId"),
            F.when(F.col("c_acctbal") < 1000, "").otherwise(F.col("n_name")).alias("BillDepartmentName"),
            F.col("c_mktsegment").alias("BillLocationName"),
            F.lpad(text("o_custkey"), 10, "1").alias("RenderingProviderNpi"),
            F.col("c_name").alias("RenderingProviderFullName"),
            F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_name")).alias("RenderingProviderFirstName"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "").otherwise("x").alias("PatientRace"),
        ]
    return rows.select(*columns)


CHARGES = """charges AS (SELECT CAST(o_orderkey AS VARCHAR) AS ChargeId, CAST(o_custkey AS VARCHAR) AS PatientId,
 strftime(o_orderdate, '%Y-%m-%d') AS PostDate, CAST(o_orderdate AS DATE) AS posted,
 CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE -2 END AS served,
 CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) END AS ChargeAmountOriginal,
 CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_totalprice AS DECIMAL(14,2)) END AS charged,
 o_orderstatus AS TransactionType, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS PatientGender,
 CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS BillDepartmentId,
 CASE WHEN c_acctbal < 1000 THEN '' ELSE n_name END AS BillDepartmentName, c_mktsegment AS BillLocationName,
 lpad(CAST(o_custkey AS VARCHAR), 10, '1') AS RenderingProviderNpi, c_name AS RenderingProviderFullName,
 CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' ELSE c_name END AS RenderingProviderFirstName,
 CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '' ELSE 'x' END AS PatientRace
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

# Transactions: one row per order line.  A tax of 8 % stands for an unknown charge, 0 % for a blank id.
LINE_TYPES = {"R": "Void", "A": "Adjustment", "N": "Charge"}


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    price, discount = cents("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)")
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_tax") == 0.08, F.concat(F.lit("X"), text("l_orderkey")))
        .when(F.col("l_tax") == 0, "").otherwise(text("l_orderkey")).alias("ChargeId"),
        iso("l_shipdate").alias("PostDate"),
        text(-(price * (1 - discount))).alias("PaymentOriginal"),
        text(-(price * discount)).alias("AdjustmentOriginal"),
        case("l_returnflag", LINE_TYPES).alias("TransactionType"),
        text(F.when(F.col("l_linestatus") == "F", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int")).alias("Units"),
        F.lpad(text("l_suppkey"), 10, "1").alias("RenderingProviderNpi"),
        F.concat(F.lit("Supplier "), text("l_suppkey"), F.when(F.col("l_tax") == 0.08, " Jr").otherwise("")).alias("RenderingProviderFullName"),
        text(F.lit(50000) + F.col("l_suppkey")).alias("CptCode"),
        text(F.col("l_tax").cast("decimal(8,2)")).alias("WorkRvuOriginal"),
    )


TRANSACTIONS = f"""transactions AS (SELECT CASE WHEN l_tax = 0.08 THEN 'X' || l_orderkey WHEN l_tax = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS ChargeId,
 CAST(l_shipdate AS DATE) AS posted,
 -(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS paid,
 -(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2))) AS adjusted,
 {sql_case('l_returnflag', LINE_TYPES)} AS TransactionType,
 CASE WHEN l_linestatus = 'F' THEN -l_quantity ELSE l_quantity END AS units,
 lpad(CAST(l_suppkey AS VARCHAR), 10, '1') AS RenderingProviderNpi,
 'Supplier ' || l_suppkey || CASE WHEN l_tax = 0.08 THEN ' Jr' ELSE '' END AS RenderingProviderFullName,
 CAST(50000 + l_suppkey AS VARCHAR) AS CptCode, l_tax AS rvu FROM lineitem)"""



def centered_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions with the supplier's nation as department."""
    price, discount = cents("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)")
    return table(spark, folder, "lineitem").join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        text("s_nationkey").alias("BillDepartmentId"),
        F.lpad(text("l_suppkey"), 10, "1").alias("RenderingProviderNpi"),
        text(-(price * (1 - discount))).alias("PaymentOriginal"),
        text(-(price * discount)).alias("AdjustmentOriginal"),
    )


CENTERED = """centered AS (SELECT CAST(s_nationkey AS VARCHAR) AS dept, lpad(CAST(l_suppkey AS VARCHAR), 10, '1') AS npi,
 -(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS paid,
 -(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2))) AS adjusted FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

# Scheduling: one row per event.
EVENT_STATUS = {"signup": "Scheduled", "error": "No Show", "click": "Arrived", "view": "Canceled by patient", "purchase": "completed"}
EVENT_TYPE = {"signup": "New Patient", "error": "Follow-up", "click": "Return Visit", "view": "Consult", "purchase": "Est Pt"}


def scheduling(spark: SparkSession, folder: str) -> DataFrame:
    gone, value, k = F.col("event_type") == "view", F.col("value"), F.get_json_object("props", "$.k").cast("int")
    stamp = "yyyy-MM-dd HH:mm:ss"
    return table(spark, folder, "events").select(
        text("event_id").alias("ApptId"),
        F.date_format("ts", stamp).alias("ApptDate"),
        case("event_type", EVENT_STATUS).alias("ApptStatus"),
        case("event_type", EVENT_TYPE).alias("ApptType"),
        text(F.lpad(text("user_id"), 6, "0")).alias("PatIdOrig"),
        text(F.when(value < 5, F.lit(0).cast("decimal(12,2)")).otherwise(value.cast("decimal(12,2)"))).alias("ApptSchdLength"),
        F.when(gone & (value >= 10), iso("ts")).when(~gone & (value > 200), iso("ts")).otherwise("").alias("CancellationDate"),
        F.when(gone & (value >= 30), "changed plans").otherwise("").alias("CancelReason"),
        F.date_format(F.when(value > 120, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts") - F.expr("INTERVAL 7 DAYS")), stamp).alias("CreateDate"),
        F.date_format("ts", stamp).alias("CheckInDate"),
        F.date_format(
            F.when(value < 3, F.col("ts") - F.expr("INTERVAL 1 HOUR")).when(value > 200, F.col("ts") + F.expr("INTERVAL 13 HOURS"))
            .otherwise(F.col("ts") + F.expr("INTERVAL 1 HOUR")), stamp,
        ).alias("CheckOutDate"),
        F.when(k < 25, F.concat(F.lit("NATION_"), text(k))).when(k < 60, "Annex").otherwise("").alias("BillLocNameOrig"),
        F.lpad(text(k), 10, "1").alias("ApptProvNPI"),
        F.date_format("ts", "HH:mm").alias("ApptTime"),
    )


SCHEDULING = f"""scheduling AS (SELECT event_id, date_trunc('second', ts) AS appt, {sql_case('event_type', EVENT_STATUS)} AS ApptStatus,
 {sql_case('event_type', EVENT_TYPE)} AS ApptType, lpad(CAST(user_id AS VARCHAR), 6, '0') AS PatIdOrig,
 CASE WHEN value < 5 THEN 0 ELSE value END AS minutes, event_type = 'view' AS gone, event_type IN ('click', 'purchase') AS done,
 CASE WHEN event_type = 'view' AND value >= 10 THEN 'y' WHEN event_type <> 'view' AND value > 200 THEN 'y' ELSE '' END AS CancellationDate,
 CASE WHEN event_type = 'view' AND value >= 30 THEN 'y' ELSE '' END AS CancelReason,
 CASE WHEN value > 120 THEN date_trunc('second', ts) + INTERVAL 1 DAY ELSE date_trunc('second', ts) - INTERVAL 7 DAY END AS created,
 CASE WHEN value < 3 THEN -1 WHEN value > 200 THEN 13 ELSE 1 END AS stay_hours,
 CASE WHEN CAST(props->>'$.k' AS INTEGER) < 25 THEN 'NATION_' || CAST(props->>'$.k' AS INTEGER) WHEN CAST(props->>'$.k' AS INTEGER) < 60 THEN 'Annex' ELSE '' END AS BillLocNameOrig, lpad(CAST(CAST(props->>'$.k' AS INTEGER) AS VARCHAR), 10, '1') AS ApptProvNPI,
 hour(ts) AS hr FROM events)"""

# Payroll: one row per order line, the supplier is the employee.
EARNINGS = {"R": "Regular pay", "A": "Pay adjustment", "N": "Overtime"}


def payroll(spark: SparkSession, folder: str) -> DataFrame:
    balance = F.col("s_acctbal")
    job = (
        F.when(balance < 0, "Groundskeeper").when(balance < 2500, "Physician").when(balance < 5000, "Registered Nurse")
        .when(balance < 7500, "Front Desk Clerk").otherwise("Office Manager")
    )
    return table(spark, folder, "lineitem").join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        text("l_suppkey").alias("EmployeeId"),
        F.col("s_name").alias("EmployeeFullName"),
        F.when(balance < 1000, "").otherwise(F.lpad(text("s_suppkey"), 10, "1")).alias("EmployeeNpi"),
        job.alias("JobCodeDesc"),
        text("s_nationkey").alias("DepartmentId"),
        F.concat(F.lit("NATION_"), text("s_nationkey")).alias("DepartmentName"),
        iso(F.when(F.col("l_linestatus") == "F", F.date_add("l_shipdate", -13)).otherwise(F.date_add("l_shipdate", -9))).alias("PayPeriodStartDate"),
        iso("l_shipdate").alias("PayPeriodEndDate"),
        iso(F.date_add("l_shipdate", F.when(F.col("l_tax") == 0.08, -1).otherwise(5))).alias("CheckDate"),
        F.col("l_returnflag").alias("EarningsCode"),
        case("l_returnflag", EARNINGS).alias("EarningsCodeDesc"),
        text(F.when(F.col("l_tax") == 0.08, -cents("l_quantity")).otherwise(cents("l_quantity") * 5)).alias("Hours"),
        text(F.when(F.col("l_tax") == 0.08, -cents("l_extendedprice")).otherwise(cents("l_extendedprice"))).alias("AmountOrig"),
    )


PAYROLL = f"""payroll AS (SELECT CAST(l_suppkey AS VARCHAR) AS EmployeeId, s_name AS EmployeeFullName,
 CASE WHEN s_acctbal < 1000 THEN '' ELSE lpad(CAST(s_suppkey AS VARCHAR), 10, '1') END AS EmployeeNpi,
 CASE WHEN s_acctbal < 0 THEN 'Unclassified' WHEN s_acctbal < 2500 THEN 'Physician' WHEN s_acctbal < 5000 THEN 'RN'
 WHEN s_acctbal < 7500 THEN 'Admin/Patient Access' ELSE 'Admin/Patient Access' END AS job_class,
 CAST(s_nationkey AS VARCHAR) AS DepartmentId, 'NATION_' || s_nationkey AS DepartmentName,
 CASE WHEN l_linestatus = 'F' THEN 14 ELSE 10 END AS period_days, CAST(l_shipdate AS DATE) AS period_end, l_tax = 0.08 AS early_check,
 l_returnflag AS EarningsCode, {sql_case('l_returnflag', EARNINGS)} AS EarningsCodeDesc,
 CASE WHEN l_tax = 0.08 THEN -CAST(l_quantity AS DECIMAL(14,2)) ELSE CAST(l_quantity AS DECIMAL(14,2)) * 5 END AS hours,
 CASE WHEN l_tax = 0.08 THEN -CAST(l_extendedprice AS DECIMAL(14,2)) ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END AS amount
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

# Ledger: one row per order line; the part type is the account's description.
ACCOUNTS = {
    "ECONOMY": "Gross patient charges", "SMALL": "Contractual allowance", "STANDARD": "Physician compensation",
    "MEDIUM": "Staff salaries", "LARGE": "Office supplies", "PROMO": "Miscellany",
}
ACCOUNT_CATEGORY = {
    "ECONOMY": "Charges", "SMALL": "Adjustments", "STANDARD": "Provider Compensation",
    "MEDIUM": "Support Staff Compensation", "LARGE": "Other Operating Expenses", "PROMO": "Unclassified",
}


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    sign = F.when(F.col("p_type") == "ECONOMY", 1).otherwise(-1)
    return (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            text("s_nationkey").alias("CostCenterNumberOrig"),
            F.concat(F.lit("NATION_"), text("s_nationkey"), F.when(F.col("s_acctbal") < 0, " West").otherwise("")).alias("CostCenterNameOrig"),
            F.concat(F.col("p_type"), F.lit("-"), F.col("p_brand")).alias("AcctNumber"),
            case("p_type", ACCOUNTS).alias("AcctDesc"),
            text(cents("l_extendedprice") * sign).alias("AmountOrig"),
            F.date_format(F.add_months("l_shipdate", 120), "yyyyMM").alias("YearMonth"),
        )
    )


LEDGER = f"""ledger AS (SELECT CAST(s_nationkey AS VARCHAR) AS center,
 'NATION_' || s_nationkey || CASE WHEN s_acctbal < 0 THEN ' West' ELSE '' END AS center_name, p_type || '-' || p_brand AS account,
 {sql_case('p_type', ACCOUNTS)} AS descr, {sql_case('p_type', ACCOUNT_CATEGORY)} AS category,
 CAST(l_extendedprice AS DECIMAL(14,2)) * CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE -1 END AS amount,
 CAST(strftime(l_shipdate + INTERVAL 10 YEAR, '%Y%m') AS INTEGER) AS ym
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


# Quality measures: one row per labelled document.

def quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    n, good, bad = F.col("n_chars"), F.col("quality"), F.col("toxic")
    return rows.select(
        F.lpad(text("doc_id"), 10, "1").alias("Provider NPI"),
        F.concat(F.lit("Author "), text("doc_id")).alias("Provider Name"),
        case("lang", {"en": "CMS122v12", "fr": "MIPS-47", "de": "236", "es": "local measure"}).alias("Measure Number"),
        F.when(bad == 1, "maybe").when(good == 1, "N").otherwise("Y").alias("Is_Inverse"),
        text(n).alias("Denominator"),
        text(F.when(bad == 1, n).otherwise(F.lit(0))).alias("Exclusions/Exceptions"),
        text(F.when(good == 1, F.floor(n / 2)).otherwise(F.floor(n / 4))).alias("Numerator"),
        F.when((good == 0) & (bad == 1), "").when(bad == 1, "105").when(good == 1, "50").otherwise("40").alias("Performance Rate"),
        F.lit("2024-01-01").alias("Measurement Period Start Date"),
        case("lang", {"en": "2024-12-31", "fr": "2024-03-31", "de": "2023-12-31", "es": "2024-02-10"}).alias("Measurement Period End Date"),
    )


QUALITY = f"""quality AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '1') AS npi, lang, quality AS good, toxic AS bad, n_chars AS n,
 {sql_case('lang', {'en': 'CMS122v12', 'fr': 'MIPS-47', 'de': '236', 'es': 'local measure'})} AS measure,
 CASE WHEN toxic = 1 THEN n_chars ELSE 0 END AS excluded,
 CASE WHEN quality = 1 THEN n_chars // 2 ELSE n_chars // 4 END AS top,
 CASE WHEN quality = 0 AND toxic = 1 THEN NULL WHEN toxic = 1 THEN 105 WHEN quality = 1 THEN 50 ELSE 40 END AS rate,
 date_diff('day', DATE '2024-01-01', CAST({sql_case('lang', {'en': '2024-12-31', 'fr': '2024-03-31', 'de': '2023-12-31', 'es': '2024-02-10'})} AS DATE)) + 1 AS days
 FROM labels JOIN documents USING (doc_id))"""


# Surveys: one row per conversation turn.

def surveys(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length("text")
    start = F.date_add(F.lit("2024-01-01"), F.col("turn").cast("int"))
    return table(spark, folder, "conversations").select(
        F.when(F.col("role") == "system", text("conv_id")).otherwise(F.lpad(text("conv_id"), 10, "1")).alias("Provider NPI"),
        text(F.when(size > 600, F.col("turn") + 1).otherwise(F.col("turn"))).alias("Question Order"),
        F.when(F.col("role") == "system", "").otherwise(text(F.length("text") / 10)).alias("Score"),
        text(start).alias("Survey Date Range Start"),
        text(F.date_add(start, F.when(size > 800, 200).when(size < 60, -1).otherwise(30))).alias("Survey Date Range End"),
    )


SURVEYS = """surveys AS (SELECT CASE WHEN role = 'system' THEN CAST(conv_id AS VARCHAR) ELSE lpad(CAST(conv_id AS VARCHAR), 10, '1') END AS npi,
 CASE WHEN length(text) > 600 THEN turn + 1 ELSE turn END AS q, CASE WHEN role = 'system' THEN NULL ELSE length(text) / 10 END AS score,
 CASE WHEN length(text) > 800 THEN 200 WHEN length(text) < 60 THEN -1 ELSE 30 END AS days FROM conversations)"""
