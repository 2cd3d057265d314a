"""Which month a file covers, and whether the files agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..checks.ledger import period_counts
from ..findings import emit, finding
from ..functions.parse import day, month_label


def _modal(label: Column, n: Column) -> Column:
    """Most frequent label, the earliest on ties."""
    return F.min(F.struct((-n).alias("r"), label.alias("v")))["v"]


def month_of_dates(df: DataFrame, column: str) -> DataFrame:
    """One row: first and last date, modal month."""
    days = df.select(day(column).alias("d")).where(F.col("d").isNotNull()).groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last")
    )
    return days.agg(
        F.min("first").cast("string").alias("min_date"), F.max("last").cast("string").alias("max_date"),
        _modal(F.col("month"), F.col("n")).alias("implied_month"),
    ).withColumn("note", F.when(F.col("implied_month").isNull(), "Could not parse dates").otherwise(""))


def month_of_ledger(df: DataFrame) -> DataFrame:
    """The same for a ledger period: YYYYMM numbers if most values are, else dates."""
    low, high = rules.YEAR_MONTH_RANGE
    n, number, dated = F.col("n"), F.col("number"), F.col("dated")
    numeric = number.isNotNull()
    values = period_counts(df).where(F.col("value") != "")
    shares = values.agg(
        F.sum("n").alias("all"), F.sum(F.when(numeric, n)).alias("numbers"),
        F.sum(F.when(number.between(low, high), n)).alias("valid"),
    ).select(((F.col("numbers") > F.col("all") * 0.5) & (F.col("valid") > F.col("numbers") * 0.5)).alias("as_number"))
    as_number = F.coalesce(shares.scalar(), F.lit(False))
    ym = values.withColumn("as_number", as_number).select(
        F.when(F.col("as_number"), number).otherwise(dated).cast("int").alias("ym"), "as_number", "n"
    ).where(F.col("ym").isNotNull()).groupBy("ym", "as_number").agg(F.sum("n").alias("n"))
    row = ym.agg(
        F.min("ym").alias("low"), F.max("ym").alias("high"), _modal(F.col("ym"), F.col("n")).alias("mode"),
        F.bool_and("as_number").alias("as_number"),
    )
    note = F.when(F.col("as_number"), "given as year and month").when(
        F.col("mode").isNotNull(), "given as dates, read as their months"
    ).otherwise("neither dates nor months can be read")
    return row.select(
        month_label(F.col("low")).alias("min_date"), month_label(F.col("high")).alias("max_date"),
        month_label(F.col("mode")).alias("implied_month"), note.alias("note"),
    )


def file_month(df: DataFrame, source: str, file: str = "") -> DataFrame:
    """``file, source, filter_field, min_date, max_date, implied_month, note``."""
    column = rules.FILTER_DATE[source]
    if column not in df.columns:
        text = f"no header leads to {column}, by which files are dated"
        row = df.sparkSession.range(1).select(
            *[F.lit(None).cast("string").alias(c) for c in ("min_date", "max_date", "implied_month")], F.lit(text).alias("note")
        )
        column = None
    elif source == "gl":
        row = month_of_ledger(df)
    else:
        row = month_of_dates(df, column)
    return row.select(
        F.lit(file).alias("file"), F.lit(source).alias("source"), F.lit(column).cast("string").alias("filter_field"),
        "min_date", "max_date", "implied_month", "note",
    )


def consensus(months: DataFrame) -> DataFrame:
    """One row: the modal month of the core sources and whether all of them have it."""
    core = months.where(F.col("source").isin(rules.CORE_SOURCES) & F.col("implied_month").isNotNull())
    counts = core.groupBy("implied_month").agg(F.count("*").alias("n"))
    return counts.agg(
        _modal(F.col("implied_month"), F.col("n")).alias("test_month"), (F.count("*") == 1).alias("aligned"),
    )


def alignment_finding(months: DataFrame, ctx) -> DataFrame:
    return emit(consensus(months), ctx, [finding(
        "month_alignment", F.when(~F.col("aligned"), "HIGH"), "the files do not agree on one month"
    )], phase=1)
