"""Exact quantiles with linear interpolation, without a group in one task.

Values are first collapsed to counts (combined on the map side), then split into
buckets of less than a tenth of a percent of their magnitude.  Running totals over buckets show which
buckets hold a wanted rank.  Those are cut by their own range of values into ``PARTS`` parts, and
only the parts that hold a rank are sorted, so values that all lie in one bucket (time stamps,
scores) are no one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


PARTS = 4096  # of a bucket's range


def _bucket(value: Column) -> Column:
    """Order-preserving: by sign, then by 1024 steps per power of two."""
    value = value.cast("double")
    step = F.floor(F.log2(F.abs(value)) * 1024) + 1200000
    return F.coalesce(F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * step).cast("int"), F.lit(0))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, bucket, n``.  Filtered here on every key, so that all uses share one shuffle."""
    known = F.col(value).isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    return df.where(known).withColumn("bucket", _bucket(F.col(value))).groupBy(*keys, value, "bucket").agg(
        F.count("*").alias("n")
    )


def from_counts(counts: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row per key with a column per named probability, plus ``total``."""
    ranks = {name: F.lit(p) * (F.col("total") - 1) for name, p in probabilities.items()}

    def inside(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    wanted = F.lit(False)
    for rank in ranks.values():
        wanted |= inside(F.floor(rank), F.col("before"), F.col("held"))
        wanted |= inside(F.ceil(rank), F.col("before"), F.col("held"))

    number = F.col(value).cast("double")
    sums = [F.sum("n").alias("held"), F.min(number).alias("least"), F.max(number).alias("most")]
    place, in_order = [*keys, "bucket"], Window.partitionBy(*keys).orderBy("bucket")
    buckets = counts.groupBy(*place).agg(*sums).withColumns({
        "before": F.sum("held").over(in_order) - F.col("held"), "total": F.sum("held").over(Window.partitionBy(*keys)),
    })
    found = ["before", "total", "least", "most"]
    held = counts.join(buckets.where(wanted).select(*place, *found), place)
    share = F.when(F.col("most") > F.col("least"), (number - F.col("least")) / (F.col("most") - F.col("least")) * PARTS).otherwise(0)
    held = held.withColumn("part", F.floor(share).cast("int")).drop("least", "most")
    along = Window.partitionBy(*place).orderBy("part")  # at most PARTS rows
    parts = held.groupBy(*place, "part").agg(F.sum("n").alias("held"), F.first("before").alias("base"), F.first("total").alias("total"))
    parts = parts.withColumn("before", F.col("base") + F.sum("held").over(along) - F.col("held")).where(wanted)
    place = [*place, "part"]
    held = held.drop("before", "total").join(parts.select(*place, "before", "total"), place)
    within = Window.partitionBy(*place).orderBy(value)
    held = held.withColumn("start", F.col("before") + F.sum("n").over(within) - F.col("n"))
    picks = []
    for name, rank in ranks.items():
        for end, at in (("low", F.floor(rank)), ("high", F.ceil(rank))):
            hit = F.when(inside(at, F.col("start"), F.col("n")), F.col(value).cast("double"))
            picks.append(F.max(hit).alias(f"{name}_{end}"))
    picked = held.groupBy(*keys).agg(F.max("total").alias("total"), *picks)
    interpolated = {
        name: F.col(f"{name}_low")
        + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (ranks[name] - F.floor(ranks[name]))
        for name in ranks
    }
    return picked.select(*keys, "total", *[e.alias(name) for name, e in interpolated.items()])


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    return from_counts(value_counts(df, keys, value), keys, value, probabilities)


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}).drop("total")
