"""Distinct values with their counts: the base of classification, code sets and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classify import Rules, classify
from ..functions.text import as_col, present, strip
from ..rules import ID_LIKE_SHARE


def frequencies(df: DataFrame, value: Column | str, *, blanks: bool = False) -> DataFrame:
    """``value, n`` of the trimmed values; the expensive rules then run once per distinct value."""
    values = df.select(strip(as_col(value).cast("string")).alias("value")).where(F.col("value").isNotNull())
    if not blanks:
        values = values.where(F.col("value") != "")
    return values.groupBy("value").agg(F.count("*").alias("n"))


def classified(df: DataFrame, value: Column | str, rules: Rules, default: str | None = None) -> DataFrame:
    """``value, n, label`` per distinct value."""
    return frequencies(df, value, blanks=True).withColumn("label", classify("value", rules, default))


def top_k(df: DataFrame, by: str, k: int, tie: str = "value") -> DataFrame:
    """The k largest rows; ties by value so the answer does not depend on the engine."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def outside_code_set(codes: DataFrame, reference: DataFrame, code: str) -> DataFrame:
    """Frequencies with ``known`` telling whether the reference table has the code."""
    ref = reference.select(as_col(code).cast("string").alias("value"), F.lit(True).alias("known")).distinct()
    return codes.join(ref, "value", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def shape_facts(df: DataFrame, value: str) -> DataFrame:
    """One row on the form of an id column: numeric or not, lengths, leading zeros."""
    text = strip(value)
    counts = (
        df.select(text.alias("v")).where(present("v"))
        .groupBy(
            F.length("v").alias("size"),
            F.col("v").rlike(r"^\d+$").alias("digits"),
            F.col("v").rlike(r"^[A-Za-z]+$").alias("letters"),
            F.col("v").rlike(r"^0\d+").alias("zeros"),
        )
        .agg(F.count("*").alias("n"))
    )
    facts = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("filled"),
        F.bool_and("digits").alias("all_digits"),
        F.bool_and("letters").alias("all_letters"),
        F.bool_or("zeros").alias("leading_zeros"),
        F.coalesce(F.sum(F.when(F.col("digits"), F.col("n"))), F.lit(0)).alias("digit_rows"),
        F.min("size").alias("shortest"),
        F.max("size").alias("longest"),
        F.expr("percentile(size, 0.5, n)").alias("median_length"),
    )
    numeric = F.format_string("numeric_%ddigit", F.floor("median_length").cast("int"))
    return facts.withColumn(
        "format", F.when(F.col("all_digits"), numeric).when(F.col("all_letters"), "alpha").otherwise("alphanumeric")
    )


def id_like_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column (``raw``) the shares of the three code shapes among filled values, and the verdict; one aggregate."""
    def facts(column: str) -> Column:
        text, filled = strip(as_col(column)), present(as_col(column))
        no_blank = ~text.contains(" ")
        return F.struct(
            F.lit(column).alias("raw"),
            F.count_if(filled).alias("filled"),
            F.count_if(filled & text.rlike(r"^\d[\d\-.]*$")).alias("code_rows"),
            F.count_if(filled & (F.length(text) <= 12) & no_blank & text.rlike(r"[\d_\-.]")).alias("short_rows"),
            F.count_if(filled & no_blank & text.contains("_") & text.rlike(r"\d")).alias("compound_rows"),
        )

    rows = df.agg(F.array(*[facts(c) for c in columns]).alias("facts")).select(F.inline("facts"))
    best = F.greatest("code_rows", "short_rows", "compound_rows")
    return rows.withColumn("id_like", F.coalesce(F.try_divide(best, "filled") >= ID_LIKE_SHARE, F.lit(False)))
