"""Column profile, conformance and universal checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..checks import conformance, universal
from ..checks.registry import run_checks
from ..context import ColumnMeta, Context
from ..findings import report
from ..functions.formula import apply_transforms
from ..operators import frequency, months, profile as prof
from . import bindings as b
from .registered import found, over, pct, query, row, when


def _meta(*columns: str, **typed: tuple) -> tuple[ColumnMeta, ...]:
    out = [ColumnMeta(c) for c in columns]
    for name, spec in typed.items():
        out.append(ColumnMeta(name, sql_type=spec[0], max_length=spec[1] if len(spec) == 2 else None,
                              precision=spec[1] if len(spec) == 3 else None, scale=spec[2] if len(spec) == 3 else None))
    return tuple(out)


_NULL_COLUMNS = {
    "ChargeId": "required", "BillDepartmentId": "required", "BillDepartmentName": "required", "PatientGender": "required",
    "RenderingProviderFirstName": "recommended", "PatientRace": "optional",
}


def _null_severity(level: str) -> str:
    return {
        "required": over("p", (50, "CRITICAL"), above_zero="HIGH"),
        "recommended": over("p", (10, "MEDIUM")), "optional": over("p", (25, "INFO")),
    }[level]


@query("null_profile", found(
    b.CHARGES,
    *[
        row("null_blank", _null_severity(level), column, "n", "t",
            source=f"(SELECT *, {pct('n', 't')} AS p FROM (SELECT count(*) FILTER (trim({column}) = '') AS n, count(*) AS t FROM charges))")
        for column, level in _NULL_COLUMNS.items()
    ],
))
def null_profile(spark, folder) -> DataFrame:
    df = b.charges(spark, folder).select(*_NULL_COLUMNS)
    ctx = Context(columns=_meta(*_NULL_COLUMNS))
    return report(universal.missing_values(prof.profile(df, ctx), ctx))


_DUP = "SELECT l_orderkey, l_linenumber, {more} count(*) AS n FROM lineitem GROUP BY ALL"


@query("full_row_dups", found(
    "m AS (SELECT coalesce(sum(n) FILTER (n > 1), 0) AS d, sum(n) AS t, count(*) FILTER (n > 1) AS g FROM ("
    + _DUP.format(more="l_returnflag, l_linestatus,") + "))",
    row("full_row_duplicates", when("d > 0", "CRITICAL"), None, "d", "t", groups="g"),
))
def full_row_dups(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return report(universal.duplicate_rows(df, Context()), "groups")


@query("logical_key_dups", found(
    "m AS (SELECT coalesce(sum(n) FILTER (n > 1), 0) AS d, sum(n) AS t, count(*) FILTER (n > 1) AS g FROM (" + _DUP.format(more="") + "))",
    row("duplicate_records", when("d > 0", "HIGH"), None, "d", "t", groups="g"),
))
def logical_key_dups(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return report(universal.logical_key_duplicates(df, Context(), ["l_orderkey", "l_linenumber"]), "groups")


_WINDOW = (date(1996, 1, 1), date(2001, 6, 30))


@query("date_window", found(
    f"{b.CHARGES}, m AS (SELECT count(*) FILTER (posted NOT BETWEEN DATE '{_WINDOW[0]}' AND DATE '{_WINDOW[1]}') AS n, count(*) AS t FROM charges)",
    row("date_range", over(pct("n", "t"), (5, "HIGH"), above_zero="MEDIUM", otherwise="INFO"), "PostDate", "n", "t"),
    row("B11", over(pct("n", "t"), (10, "HIGH"), above_zero="MEDIUM", otherwise="INFO"), "PostDate", "n", "t"),
))
def date_window(spark, folder) -> DataFrame:
    df = b.charges(spark, folder, org=False).select("PostDate")
    ctx = Context(window=_WINDOW, columns=(ColumnMeta("PostDate", sql_type="date"),))
    universal_part = universal.date_findings(prof.profile(df, ctx), ctx)
    return report(universal_part.unionByName(run_checks(df, ctx, ["B11"])))


@query("impossible_dates", found(
    "m AS (SELECT count(*) FILTER (c_acctbal < -500) AS e, count(*) FILTER (c_acctbal BETWEEN -500 AND 0) AS o, "
    "count(*) FILTER (c_acctbal > 9500) AS f, count(*) AS t FROM customer)",
    row("invalid_dates", when("o > 0", "MEDIUM"), "PostDate", "o", "t"),
    row("epoch_dates", when("e > 0", "MEDIUM"), "PostDate", "e", "t"),
    row("future_dates", when("f > 0", "MEDIUM"), "PostDate", "f", "t"),
))
def impossible_dates(spark, folder) -> DataFrame:
    balance = F.col("c_acctbal")
    df = b.table(spark, folder, "customer").select(
        F.when(balance < -500, "1/1/1970").when(balance <= 0, "1850-06-30").when(balance > 9500, "2060/01/01").otherwise("20240115").alias("PostDate")
    )
    ctx = Context(test_month="2024-01", columns=(ColumnMeta("PostDate", sql_type="date"),))
    return report(universal.date_findings(prof.profile(df, ctx), ctx))


_OUTLIER = """SELECT '{c}' AS staging_column, count(v) AS numbers,
 count(*) FILTER (v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) AS outliers,
 round(max(q1), 6) AS q1, round(max(q2), 6) AS median, round(max(q3), 6) AS q3, min(v) AS smallest, max(v) AS largest
 FROM (SELECT {v} AS v FROM {t}), (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS q2, quantile_cont({v}, 0.75) AS q3 FROM {t})"""


@query("iqr_outliers", _OUTLIER.format(c="value", v="value", t="events"))
def iqr_outliers(spark, folder) -> DataFrame:
    return _rounded(prof.outliers(b.table(spark, folder, "events").select(b.text("value").alias("value")), ["value"]))


def _rounded(found_rows: DataFrame) -> DataFrame:
    return found_rows.select(
        "staging_column", "numbers", "outliers", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "smallest", "largest"
    )


@query("quartiles_per_column", " UNION ALL ".join(
    _OUTLIER.format(c=c, v=c, t="lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")
))
def quartiles_per_column(spark, folder) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    return _rounded(prof.outliers(b.table(spark, folder, "lineitem").select(*[b.text(c).alias(c) for c in columns]), columns))


@query("numeric_summary", """SELECT 'ChargeAmountOriginal' AS staging_column, count(*) AS numbers, min(v) AS smallest, max(v) AS largest,
 round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS deviation, count(*) FILTER (v = 0) AS zeros, count(*) FILTER (v < 0) AS negatives,
 round(quantile_cont(v, 0.5), 6) AS median FROM (SELECT c_acctbal AS v FROM customer)""")
def numeric_summary(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "customer").select(b.text("c_acctbal").alias("ChargeAmountOriginal"))
    ctx = Context(columns=(ColumnMeta("ChargeAmountOriginal", sql_type="decimal", precision=14, scale=2),))
    return universal.numeric_summary(df, ctx).select(
        "staging_column", "numbers", "smallest", "largest", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"),
        "zeros", "negatives", F.round("median", 6).alias("median"),
    )


@query("placeholder_values", """SELECT 'PatientCity' AS staging_column, value, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < -500 THEN 'Test'
 WHEN c_acctbal < 0 THEN 'N/A' WHEN c_acctbal > 9900 THEN ' unknown' END AS v, trim(v) AS value FROM customer) WHERE value IS NOT NULL GROUP BY ALL""")
def placeholder_values(spark, folder) -> DataFrame:
    balance = F.col("c_acctbal")
    df = b.table(spark, folder, "customer").select(
        F.when(balance < -500, "Test").when(balance < 0, "N/A").when(balance > 9900, " unknown").otherwise(F.col("c_mktsegment")).alias("PatientCity")
    )
    return prof.placeholder_values(df, ["PatientCity"])


_MOJIBAKE_SQL = rules.MOJIBAKE


@query("encoding_scan", found(
    f"""m AS (SELECT count(*) FILTER (regexp_matches(t, '{_MOJIBAKE_SQL}')) AS g, count(*) FILTER (regexp_matches(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS c,
 count(*) AS n FROM (SELECT CASE lang WHEN 'fr' THEN replace(text, 'é', 'Ã©') WHEN 'es' THEN replace(text, chr(10), chr(11)) ELSE text END AS t FROM documents))""",
    row("encoding_issues", when("g + c > 0", "MEDIUM"), "PatientCity", "g + c", "n", mojibake="g", control="c"),
))
def encoding_scan(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "documents").select(
        F.when(F.col("lang") == "fr", F.replace("text", F.lit("é"), F.lit("Ã©")))
        .when(F.col("lang") == "es", F.replace("text", F.lit("\n"), F.lit("\x0b"))).otherwise(F.col("text")).alias("PatientCity")
    )
    ctx = Context(columns=_meta("PatientCity"))
    return report(universal.encoding_findings(prof.profile(df, ctx), ctx), "mojibake", "control")


def _judged(df: DataFrame, ctx: Context) -> DataFrame:
    zero = F.lit(0)
    return conformance.judged(prof.profile(df, ctx)).select(
        "staging_column", "severity", "missing",
        *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("bad_type", "digit_overflow", "too_long", "off_domain")],
        "null_pct", "off_domain_pct", "mixed_dates", "date_format",
    )


def _judged_sql(column: str, severity: str, missing="0", bad_type="0", digit_overflow="0", too_long="0", off_domain="0",
                off_pct="NULL", mixed="false", fmt="NULL", source="m") -> str:
    return (
        f"SELECT '{column}' AS staging_column, {severity} AS severity, CAST({missing} AS BIGINT) AS missing, CAST({bad_type} AS BIGINT) AS bad_type, "
        f"CAST({digit_overflow} AS BIGINT) AS digit_overflow, CAST({too_long} AS BIGINT) AS too_long, CAST({off_domain} AS BIGINT) AS off_domain, "
        f"round({pct(missing, 't')}, 1) AS null_pct, CAST({off_pct} AS DOUBLE) AS off_domain_pct, {mixed} AS mixed_dates, CAST({fmt} AS VARCHAR) AS date_format FROM {source}"
    )


@query("type_conformance", "WITH m AS (SELECT count(*) AS t, count(*) FILTER (c_acctbal < 0) AS neg, count(*) FILTER (c_mktsegment = 'BUILDING') AS bld, "
       "count(*) FILTER (c_acctbal <> trunc(c_acctbal)) AS frac FROM customer) " + " UNION ALL ".join([
           _judged_sql("Units", "CASE WHEN frac > 0 THEN 'CRITICAL' END", bad_type="frac"),
           _judged_sql("ChargeAmountOriginal", "CASE WHEN bld > 0 THEN 'CRITICAL' END", bad_type="bld"),
           _judged_sql("ApptTime", "CASE WHEN neg > 0 THEN 'MEDIUM' END", bad_type="neg"),
       ]))
def type_conformance(spark, folder) -> DataFrame:
    whole = F.col("c_acctbal") == F.col("c_acctbal").cast("bigint")
    df = b.table(spark, folder, "customer").select(
        F.when(whole, b.text(F.col("c_acctbal").cast("bigint"))).otherwise(b.text("c_acctbal")).alias("Units"),
        F.when(F.col("c_mktsegment") == "BUILDING", "see note").otherwise("1,234.50").alias("ChargeAmountOriginal"),
        F.when(F.col("c_acctbal") < 0, "noonish").otherwise("9:30 AM").alias("ApptTime"),
    )
    ctx = Context(columns=(
        ColumnMeta("Units", sql_type="int"), ColumnMeta("ChargeAmountOriginal", sql_type="decimal", precision=14, scale=2),
        ColumnMeta("ApptTime", sql_type="time"),
    ))
    return _judged(df, ctx)


@query("decimal_overflow", "WITH m AS (SELECT count(*) AS t, count(*) FILTER (trunc(o_totalprice) >= 100000) AS big FROM orders) "
       + _judged_sql("ChargeAmountOriginal", "CASE WHEN big > 0 THEN 'CRITICAL' END", digit_overflow="big"))
def decimal_overflow(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "orders").select(b.text(b.cents("o_totalprice")).alias("ChargeAmountOriginal"))
    return _judged(df, Context(columns=(ColumnMeta("ChargeAmountOriginal", sql_type="decimal", precision=7, scale=2),)))


@query("int_overflow", "WITH m AS (SELECT count(*) AS t, count(*) FILTER (o_orderkey * 100000 > 2147483647) AS big FROM orders) "
       + _judged_sql("Units", "CASE WHEN big > 0 THEN 'CRITICAL' END"))
def int_overflow(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "orders").select(b.text(F.col("o_orderkey") * 100000).alias("Units"))
    return _judged(df, Context(columns=(ColumnMeta("Units", sql_type="int"),)))


@query("length_overflow", "WITH m AS (SELECT count(*) AS t, count(*) FILTER (length(text) > 2000) AS l FROM documents) "
       + _judged_sql("CptCodeDesc", f"CASE WHEN {pct('l', 't')} >= 5 THEN 'HIGH' WHEN l > 0 THEN 'MEDIUM' END", too_long="l"))
def length_overflow(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "documents").select(F.col("text").alias("CptCodeDesc"))
    return _judged(df, Context(columns=(ColumnMeta("CptCodeDesc", max_length=2000),)))


_OFF = f"round({pct('z', 't')}, 1)"


@query("domain_pattern", "WITH m AS (SELECT count(*) AS t, count(*) FILTER (c_acctbal < 0) AS z, count(*) FILTER (c_mktsegment IN ('BUILDING','FURNITURE')) AS n FROM customer) "
       + " UNION ALL ".join([
           _judged_sql("PatientZip", f"CASE WHEN z > 0 THEN 'CRITICAL' END", off_domain="z", off_pct=_OFF),
           _judged_sql("ReferringProviderNpi", f"CASE WHEN round({pct('n', 't')}, 1) >= 5 THEN 'HIGH' WHEN n > 0 THEN 'MEDIUM' END",
                       off_domain="n", off_pct=f"round({pct('n', 't')}, 1)"),
       ]))
def domain_pattern(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "customer").select(
        F.when(F.col("c_acctbal") < 0, "1234").otherwise("12345-6789").alias("PatientZip"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), F.col("c_name")).otherwise(F.lpad(b.text("c_custkey"), 10, "1")).alias("ReferringProviderNpi"),
    )
    return _judged(df, Context(columns=_meta("PatientZip", "ReferringProviderNpi")))


@query("date_formats", """WITH m AS (SELECT count(*) AS t, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
 count(*) FILTER (o_orderstatus = 'P') AS p FROM orders) """
       + _judged_sql("PostDate", "CASE WHEN p > 0 THEN 'CRITICAL' END", bad_type="p", mixed="f > 0 AND o > 0",
                     fmt="CASE WHEN f >= o THEN 'YYYY-MM-DD' ELSE 'M/D/YYYY' END"))
def date_formats(spark, folder) -> DataFrame:
    status = F.col("o_orderstatus")
    df = b.table(spark, folder, "orders").select(
        F.when(status == "F", b.iso("o_orderdate")).when(status == "O", F.date_format("o_orderdate", "M/d/yyyy"))
        .otherwise(F.date_format("o_orderdate", "MMM yyyy")).alias("PostDate")
    )
    return _judged(df, Context(columns=(ColumnMeta("PostDate", sql_type="date"),)))


@query("single_null_merge", """WITH m AS (SELECT count(*) AS t, count(*) FILTER (o_orderkey = 0) AS one, count(*) FILTER (o_orderpriority = '5-LOW') AS many FROM orders)
 SELECT 'BillLocationName' AS staging_column, 'CRITICAL' AS severity, CAST(3 AS DOUBLE) AS merged_columns, one AS missing FROM m WHERE one = 1
 UNION ALL SELECT 'PatientGender', 'CRITICAL', NULL, many FROM m WHERE many > 1""")
def single_null_merge(spark, folder) -> DataFrame:
    first = F.col("o_orderkey") == 0
    df = b.table(spark, folder, "orders").select(
        *[F.when(first, "").otherwise(F.lit("x")).alias(c) for c in ("PatientCity", "BillLocationName", "BillPracticeName")],
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("F").alias("PatientGender"),
    )
    ctx = Context(columns=_meta("PatientCity", "BillLocationName", "BillPracticeName", "PatientGender"))
    rows = conformance.merge_single_nulls(conformance.judged(prof.profile(df, ctx))).where(F.col("severity").isNotNull())
    return rows.select("staging_column", "severity", F.col("merged_columns").cast("double").alias("merged_columns"), "missing")


def _id_sql(column: str, source: str, expression: str) -> str:
    return f"""SELECT '{column}' AS staging_column, count(*) AS filled, count(*) FILTER (regexp_matches(v, '^\\d[\\d\\-.]*$')) AS code_rows,
 count(*) FILTER (length(v) <= 12 AND v NOT LIKE '% %' AND regexp_matches(v, '[\\d_\\-.]')) AS short_rows,
 count(*) FILTER (v NOT LIKE '% %' AND contains(v, '_') AND regexp_matches(v, '\\d')) AS compound_rows,
 greatest(code_rows, short_rows, compound_rows) >= 0.7 * count(*) AS id_like FROM (SELECT {expression} AS v FROM {source})"""


@query("id_like_columns", " UNION ALL ".join([
    _id_sql("p_name", "part", "p_name"), _id_sql("p_brand", "part", "p_brand"), _id_sql("p_partkey", "part", "CAST(p_partkey AS VARCHAR)"),
    _id_sql("p_code", "part", "p_type || '_' || p_brand || '_0000000000'"),
]))
def id_like_columns(spark, folder) -> DataFrame:
    part = b.table(spark, folder, "part").select(
        "p_name", "p_brand", b.text("p_partkey").alias("p_partkey"), F.concat("p_type", F.lit("_"), "p_brand", F.lit("_0000000000")).alias("p_code")
    )
    return frequency.id_like_columns(part, part.columns).withColumnRenamed("raw", "staging_column")


# Formulas over one column, and the same in plain SQL.
_FORMULAS = {
    "left_3": ("LEFT(x, 3)", "left(v, 3)"),
    "right_4": ("RIGHT(x, 4)", "right(v, 4)"),
    "right_0": ("RIGHT(x, 0)", "''"),
    "middle": ("SUBSTRING(x, 2, 4)", "substr(v, 2, 4)"),
    "before_start": ("SUBSTRING(x, 0, 4)", "''"),
    "before_hash": ("SUBSTRING(x, 1, CHARINDEX('#', x) - 1)", "CASE WHEN strpos(v, '#') > 1 THEN substr(v, 1, strpos(v, '#') - 1) ELSE '' END"),
    "after_hash": ("SUBSTRING(x, CHARINDEX('#', x) + 1, LEN(x))", "substr(v, strpos(v, '#') + 1)"),
    "part_2": ("SPLIT_PART(x, '#', 2)", "split_part(v, '#', 2)"),
    "part_0": ("SPLIT_PART(x, '#', 0)", "''"),
    "part_9": ("SPLIT_PART(x, '#', 9)", "''"),
    "at_hash": ("CHARINDEX('#', x)", "CAST(strpos(v, '#') AS VARCHAR)"),
    "size": ("LEN(x)", "CAST(length(v) AS VARCHAR)"),
    "loud": ("TRIM(UPPER(x))", "upper(trim(v))"),
    "quiet": ("LOWER(x)", "lower(v)"),
    "swapped": ("REPLACE(x, 'Customer', 'C')", "replace(v, 'Customer', 'C')"),
    "both": ("LEFT(x, 2) || '-' || RIGHT(x, 2)", "left(v, 2) || '-' || right(v, 2)"),
}


@query("formula_functions", "SELECT c_custkey AS id, " + ", ".join(f"{sql} AS {name}" for name, (_, sql) in _FORMULAS.items())
       + " FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ' ' || c_mktsegment || ' ' ELSE c_name END AS v FROM customer)")
def formula_functions(spark, folder) -> DataFrame:
    value = F.when(F.col("c_acctbal") < 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).otherwise(F.col("c_name"))
    df = b.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), *[value.alias(name) for name in _FORMULAS])
    return apply_transforms(df, [(name, rule) for name, (rule, _) in _FORMULAS.items()])


def _month_sql(source: str, column: str, table: str, fmt: str = "'%Y-%m'") -> str:
    return f"""SELECT '{source}' AS source, CAST(min(d) AS VARCHAR) AS min_date, CAST(max(d) AS VARCHAR) AS max_date,
 (SELECT m FROM (SELECT strftime({column}, {fmt}) AS m, count(*) AS n FROM {table} GROUP BY 1) ORDER BY n DESC, m LIMIT 1) AS implied_month
 FROM (SELECT CAST({column} AS DATE) AS d FROM {table})"""


_MONTHS = " UNION ALL ".join([
    _month_sql("billing_charges", "o_orderdate", "orders"), _month_sql("scheduling", "ts", "events"),
    _month_sql("payroll", "l_shipdate", "lineitem"),
    """SELECT 'gl' AS source, strftime(min(l_shipdate) + INTERVAL 10 YEAR, '%Y-%m') AS min_date, strftime(max(l_shipdate) + INTERVAL 10 YEAR, '%Y-%m') AS max_date,
 (SELECT m FROM (SELECT strftime(l_shipdate + INTERVAL 10 YEAR, '%Y-%m') AS m, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, m LIMIT 1) AS implied_month FROM lineitem""",
])


def _months(spark, folder) -> DataFrame:
    line = b.table(spark, folder, "lineitem")
    parts = [
        months.file_month(b.charges(spark, folder, org=False), "billing_charges"),
        months.file_month(b.scheduling(spark, folder), "scheduling"),
        months.file_month(line.select(b.iso("l_shipdate").alias("PayPeriodEndDate")), "payroll"),
        months.file_month(line.select(F.date_format(F.add_months("l_shipdate", 120), "yyyyMM").alias("YearMonth")), "gl"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("file_months", _MONTHS)
def file_months(spark, folder) -> DataFrame:
    return _months(spark, folder).select("source", "min_date", "max_date", "implied_month")


@query("month_consensus", f"""WITH f AS ({_MONTHS}), c AS (SELECT implied_month, count(*) AS n FROM f GROUP BY 1)
 SELECT (SELECT implied_month FROM c ORDER BY n DESC, implied_month LIMIT 1) AS test_month, (SELECT count(*) FROM c) = 1 AS aligned""")
def month_consensus(spark, folder) -> DataFrame:
    return months.consensus(_months(spark, folder))
