"""Comparing the keys of two tables.

Both sides are stacked and grouped once, so one shuffle with map-side combining
gives presence, row counts and amounts for either side.  A key that holds a
third of all rows is one partial row per task, never a skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import as_col, present
from ..findings import percent


def presence(
    left: DataFrame, left_key: Column | str, right: DataFrame, right_key: Column | str,
    left_amount: Column | None = None, keep_missing: bool = False,
) -> DataFrame:
    """One row per distinct key: ``key, left_rows, right_rows, left_amount``."""
    zero = F.lit(0).cast("decimal(20,4)")
    sides = []
    for df, k, amount, is_left in ((left, left_key, left_amount, 1), (right, right_key, None, 0)):
        side = df.select(
            as_col(k).cast("string").alias("key"),
            F.lit(is_left).alias("l"),
            F.lit(1 - is_left).alias("r"),
            (zero if amount is None else amount).alias("amount"),
        )
        sides.append(side if keep_missing else side.where(present("key")))
    return sides[0].unionByName(sides[1]).groupBy("key").agg(
        F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.sum("amount").alias("left_amount"),
    )



def _left() -> Column:
    return F.col("left_rows") > 0


def _right() -> Column:
    return F.col("right_rows") > 0


def overlap(keys: DataFrame, *more: Column) -> DataFrame:
    """One row: distinct keys per side, shared keys, rows behind them, coverage both ways, and ``more`` aggregates."""
    both = _left() & _right()
    return keys.agg(
        F.count_if(_left()).alias("left_keys"),
        F.count_if(_right()).alias("right_keys"),
        F.count_if(both).alias("shared_keys"),
        F.count_if(_left() & ~_right()).alias("left_only"),
        F.count_if(_right() & ~_left()).alias("right_only"),
        F.coalesce(F.sum("left_rows"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum(F.when(both, F.col("left_rows"))), F.lit(0)).alias("left_rows_matched"),
        F.coalesce(F.sum("right_rows"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.when(both, F.col("right_rows"))), F.lit(0)).alias("right_rows_matched"),
        F.sum(F.when(_left(), F.col("left_amount"))).alias("left_amount"),
        F.sum(F.when(_left() & ~_right(), F.col("left_amount"))).alias("left_amount_unmatched"),
        *more,
    ).withColumns({
        "left_coverage": percent(F.col("shared_keys"), F.col("left_keys")),
        "right_coverage": percent(F.col("shared_keys"), F.col("right_keys")),
    })


def duplicate_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: groups that share all columns, rows in them, and rows looked at.

    Rows with every key blank are left to the missing-value check.
    """
    blank = F.lit(True)
    for c in columns:
        blank &= ~present(F.col(c).cast("string"))
    counts = df.where(~blank).groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count_if(F.col("n") > 1).alias("groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def full_row_duplicates(df: DataFrame) -> DataFrame:
    """Rows that have an identical twin, every member counted.

    A row is reduced to 128 bits before the shuffle, two hashes of its values as they are: one in
    the order of the columns, one against it.  Both start from which values are null, since a hash
    passes over nulls.  Copies collapse on the map side; unlike rows fall together by chance once
    in 10^18 tables of ten billion rows.
    """
    columns = [F.col(f"`{name}`").cast("string") if kind.startswith("map") else F.col(f"`{name}`") for name, kind in df.dtypes]
    nulls = F.concat_ws("", *[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    marked = df.select(F.xxhash64(nulls, *columns).alias("a"), F.xxhash64(*reversed(columns), nulls, F.lit(1)).alias("b"))
    counts = marked.groupBy("a", "b").agg(F.count("*").alias("n"))
    return counts.agg(
        F.count_if(F.col("n") > 1).alias("groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )


def several_dependents(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Determinant values with more than one distinct dependent: minimum and maximum differ."""
    return (
        df.where(present(determinant))
        .groupBy(determinant)
        .agg(F.min(dependent).alias("first"), F.max(dependent).alias("last"))
        .where(F.col("first") != F.col("last"))
    )
