"""Checks every source gets: missing, duplicate, date, range, placeholder and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..context import Context
from ..findings import emit, finding, over, percent, union, when
from ..operators import keys, profile as prof



def null_severity(level: Column, pct: Column) -> Column:
    return (
        F.when((level == "required") & (pct > 50), "CRITICAL")
        .when((level == "required") & (pct > 0), "HIGH")
        .when((level == "recommended") & (pct > 10), "MEDIUM")
        .when((level == "optional") & (pct > 25), "INFO")
    )


def _column_findings(profile: DataFrame, ctx: Context, findings: list[Column]) -> DataFrame:
    return emit(profile, ctx, findings)


def missing_values(profile: DataFrame, ctx: Context) -> DataFrame:
    pct = percent(F.col("missing"), F.col("scoped_rows"))
    f = finding(
        "null_blank", null_severity(F.col("level"), pct),
        F.format_string("'%s' (%s) is blank or null on %,d rows (%.1f%%)", "staging_column", "level", "missing", pct),
        affected=F.col("missing"), total=F.col("scoped_rows"), column=F.col("staging_column"), level=F.col("level"),
        metrics={"null_count": F.col("nulls"), "blank_count": F.col("missing") - F.col("nulls")},
    )
    return _column_findings(profile.where("missing > 0"), ctx, [f])


def duplicate_rows(df: DataFrame, ctx: Context) -> DataFrame:
    counts = keys.full_row_duplicates(df)
    return emit(counts, ctx, [finding(
        "full_row_duplicates", when(F.col("rows") > 0, "CRITICAL"),
        F.format_string("%,d rows have a twin, equal in every column", "rows"),
        affected=F.col("rows"), total=F.col("total"), metrics={"groups": F.col("groups")},
    )])


def logical_key_duplicates(df: DataFrame, ctx: Context, columns: list[str] | None = None) -> DataFrame:
    columns = columns or rules.LOGICAL_KEYS[ctx.source]
    absent = [c for c in columns if c not in df.columns]
    if absent:
        text = f"repeated keys are not counted, since no header leads to '{absent[0]}'"
        return emit(df.sparkSession.range(1), ctx, [finding("duplicate_records", "INFO", text)])
    return emit(keys.duplicate_groups(df, columns), ctx, [finding(
        "duplicate_records", when(F.col("rows") > 0, "HIGH"),
        F.format_string(f"%,d rows share their key ({', '.join(columns)}) with others; %,d keys are repeated", "rows", "groups"),
        affected=F.col("rows"), total=F.col("total"), metrics={"groups": F.col("groups")},
    )])


def date_findings(profile: DataFrame, ctx: Context) -> DataFrame:
    column = F.col("staging_column")
    outside_pct = percent(F.col("dates_outside"), F.col("rows"))
    findings = [
        finding(
            "date_range",
            F.when((F.col("dates") > 0) & F.col("dates_outside").isNotNull(),
                   over(outside_pct, (5, "HIGH"), above_zero="MEDIUM", otherwise="INFO")),
            F.format_string("'%s': %,d rows (%.1f%%) are dated before or after the agreed window", column, "dates_outside", outside_pct),
            affected=F.col("dates_outside"), total=F.col("rows"), column=column,
        ),
        finding(
            "invalid_dates", when(F.col("dates_impossible") > 0, "MEDIUM"),
            F.format_string("'%s': %,d dates lie before 1900 or after 2099", column, "dates_impossible"),
            affected=F.col("dates_impossible"), total=F.col("dates"), column=column,
        ),
        finding(
            "epoch_dates", when(F.col("dates_epoch") > 0, "MEDIUM"),
            F.format_string("'%s': %,d values are 1970-01-01, where clocks of computers start", column, "dates_epoch"),
            affected=F.col("dates_epoch"), total=F.col("dates"), column=column,
        ),
        finding(
            "future_dates", when(F.col("dates_far_future") > 0, "MEDIUM"),
            F.format_string("'%s': %,d dates lie over ten years from now", column, "dates_far_future"),
            affected=F.col("dates_far_future"), total=F.col("dates"), column=column,
        ),
    ]
    return _column_findings(profile, ctx, findings)


def numeric_outliers(df: DataFrame, ctx: Context) -> DataFrame:
    found = prof.numeric_outliers(df, ctx)
    return emit(found, ctx, [finding(
        "numeric_outliers", when((F.col("numbers") >= 10) & (F.col("outliers") > 0), "MEDIUM"),
        F.format_string(
            "'%s': %,d extreme outliers (beyond Q1-3*IQR or Q3+3*IQR; range %.2f-%.2f)",
            "staging_column", "outliers", "smallest", "largest",
        ),
        affected=F.col("outliers"), total=F.col("numbers"), column=F.col("staging_column"),
        metrics={c: F.col(c) for c in ("q1", "q3", "smallest", "largest")},
    )])


def numeric_summary(df: DataFrame, ctx: Context) -> DataFrame:
    """Count, mean, median, deviation, zeros and negatives of every numeric column."""
    from ..operators.profile import outliers

    numeric = [m.staging for m in prof.mapped(df, ctx) if prof.is_numeric(m.sql_type.lower())]
    middle = outliers(df, numeric).select("staging_column", "q1", "median", "q3", "outliers")
    shape = prof.profile(df.select(*numeric), ctx).select(
        "staging_column", "numbers", "smallest", "largest", "mean", "deviation", "zeros", "negatives"
    )
    return shape.join(middle, "staging_column", "left")


def placeholder_findings(df: DataFrame, ctx: Context) -> DataFrame:
    levels = ctx.levels()
    columns = [m.staging for m in prof.mapped(df, ctx)]
    level = F.lit("unclassified")
    for name in columns:
        level = F.when(F.col("staging_column") == name, levels.get(name, "unclassified")).otherwise(level)
    # At most one group per column, and 31 literals in it.
    per_column = prof.placeholder_values(df, columns).groupBy("staging_column").agg(
        F.sum("n").alias("found"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), F.col("value").alias("v")))).alias("values"),
    ).withColumn("level", level)
    top = F.transform(
        F.slice("values", 1, 5), lambda s: F.struct(s["v"].alias("value"), (-s["r"]).cast("bigint").alias("count"))
    )
    return emit(per_column, ctx, [finding(
        "placeholder_data",
        F.when(F.col("level") == "required", "HIGH").when(F.col("level") == "recommended", "MEDIUM").otherwise("LOW"),
        F.format_string("'%s': %,d placeholder/test values detected (%s field)", "staging_column", "found", "level"),
        affected=F.col("found"), column=F.col("staging_column"), level=F.col("level"), samples=top,
    )])


def encoding_findings(profile: DataFrame, ctx: Context) -> DataFrame:
    bad = F.col("mojibake") + F.col("control")
    return _column_findings(profile, ctx, [finding(
        "encoding_issues", when(bad > 0, "MEDIUM"),
        F.format_string(
            "'%s': %,d rows with encoding issues (mojibake: %d, control chars: %d)",
            "staging_column", bad, "mojibake", "control",
        ),
        affected=bad, total=F.col("rows"), column=F.col("staging_column"),
        metrics={"mojibake": F.col("mojibake"), "control": F.col("control")},
    )])


def profile_findings(profile: DataFrame, ctx: Context) -> DataFrame:
    """Missing values, dates and encoding, all from the column profile."""
    return union([missing_values(profile, ctx), date_findings(profile, ctx), encoding_findings(profile, ctx)])


def universal_findings(df: DataFrame, ctx: Context) -> DataFrame:
    """All universal checks of a table as one plan."""
    parts = [profile_findings(prof.profile(df, ctx), ctx), duplicate_rows(df, ctx), placeholder_findings(df, ctx)]
    if any(prof.is_numeric(m.sql_type.lower()) for m in prof.mapped(df, ctx)):
        parts.append(numeric_outliers(df, ctx))
    return union(parts)
