"""The one result shape every check emits, and how findings are built from aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SCHEMA = {
    "client": "string",
    "round": "string",
    "file": "string",
    "source": "string",
    "source_group": "string",
    "phase": "int",
    "check_id": "string",
    "severity": "string",
    "raw_column": "string",
    "staging_column": "string",
    "template_field": "string",
    "requirement_level": "string",
    "affected": "bigint",
    "total": "bigint",
    "pct": "double",
    "metrics": "map<string,double>",
    "samples": "array<struct<value:string,count:bigint>>",
    "message": "string",
}
ORIGIN = ["client", "round", "file", "source", "source_group", "phase"]

# From strongest to weakest.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "PASS"]


def _names() -> Column:
    return F.array(*[F.lit(s) for s in SEVERITIES])


def severity_rank(c: Column) -> Column:
    """1 for the strongest; null stays null."""
    return F.array_position(_names(), c)


def rank(severity: str) -> Column:
    return F.lit(SEVERITIES.index(severity) + 1)


def severity_name(rank_: Column) -> Column:
    return F.get(_names(), (rank_ - 1).cast("int"))


def worst(severity: Column) -> Column:
    """Aggregate: the strongest severity of a group."""
    return F.min_by(severity, severity_rank(severity))


def over(value: Column, *steps: tuple[float, str], above_zero: str | None = None, otherwise: str | None = None) -> Column:
    """Severity by thresholds, highest first: ``over(pct, (5, "HIGH"), above_zero="MEDIUM")``."""
    chain = F.when(F.lit(False), "")
    for limit, name in steps:
        chain = chain.when(value > limit, name)
    if above_zero:
        chain = chain.when(value > 0, above_zero)
    return chain.otherwise(F.lit(otherwise).cast("string"))


def when(condition: Column, severity: str) -> Column:
    return F.when(condition, severity)


def percent(part: Column, whole: Column) -> Column:
    """Ratio times 100; null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def finding(
    check_id: str,
    severity: Column | str,
    message: Column | str = "",
    *,
    affected: Column | None = None,
    total: Column | None = None,
    pct: Column | None = None,
    column: Column | str | None = None,
    field: Column | str | None = None,
    level: Column | str | None = None,
    metrics: dict[str, Column] | None = None,
    samples: Column | None = None,
) -> Column:
    def lit(value, kind):
        value = value if isinstance(value, Column) else F.lit(value)
        return value.cast(kind)

    if pct is None and affected is not None and total is not None:
        pct = percent(affected, total)
    if metrics:
        pairs = [x for name, value in metrics.items() for x in (F.lit(name), value.cast("double"))]
        metric_map = F.create_map(*pairs)
    else:
        metric_map = F.lit(None)
    return F.struct(
        lit(check_id, "string").alias("check_id"),
        lit(severity, "string").alias("severity"),
        F.lit(None).cast("string").alias("raw_column"),
        lit(column, "string").alias("staging_column"),
        lit(field, "string").alias("template_field"),
        lit(level, "string").alias("requirement_level"),
        lit(affected, "bigint").alias("affected"),
        lit(total, "bigint").alias("total"),
        lit(pct, "double").alias("pct"),
        metric_map.cast("map<string,double>").alias("metrics"),
        lit(samples, "array<struct<value:string,count:bigint>>").alias("samples"),
        lit(message, "string").alias("message"),
    )


def emit(measures: DataFrame, ctx, findings: list[Column], phase: int = 3) -> DataFrame:
    """Turn each row of measures into the findings whose severity is not null."""
    kept = F.filter(F.array(*findings), lambda f: f["severity"].isNotNull())
    rows = measures.select(F.inline(kept))
    return stamp(rows, ctx, phase)


def stamp(rows: DataFrame, ctx, phase: int) -> DataFrame:
    """Add where the findings come from and put the columns in order."""
    origin = {
        "client": ctx.client,
        "round": ctx.round,
        "file": ctx.file,
        "source": ctx.source,
        "source_group": ctx.source_group,
    }
    raw = F.lit(None).cast("string")
    for staging, name in ctx.raw_names.items():
        raw = F.when(F.col("staging_column") == staging, name).otherwise(raw)
    rows = rows.withColumns({k: F.lit(v).cast("string") for k, v in origin.items()})
    rows = rows.withColumns({"phase": F.lit(phase), "raw_column": raw})
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in SCHEMA.items()])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _listed(rows: Column) -> Column:
    """Sorted ``at, value, count`` structs as samples."""
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["value"].cast("string").alias("value"), r["count"].cast("bigint").alias("count")))


def _sample(at: Column, value: str, count: str) -> Column:
    return F.struct(at.alias("at"), F.col(value).alias("value"), F.col(count).alias("count"))


def with_samples(measures: DataFrame, values: DataFrame, value: str, n: int = 20, count: str = "n", by: str | None = None, name: str = "which") -> DataFrame:
    """Adds the ``n`` values with the most rows (or the most of ``by``) as samples; ties by value."""
    at = -F.col(by or count).cast("double")
    top = values.select(_sample(at, value, count).alias("s")).orderBy("s.at", "s.value").limit(n)
    return measures.withColumn(name, top.agg(_listed(F.collect_list("s"))).scalar())


def samples_per(values: DataFrame, group: str, value: str, n: int = 20, count: str = "n", by: str | None = None, name: str = "which") -> DataFrame:
    """``group`` and its ``n`` values with the most rows (or the most of ``by``) as samples; ties by value."""
    at = -F.col(by or count).cast("double")
    order = Window.partitionBy(group).orderBy(at, value)
    top = values.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= n)
    return top.groupBy(group).agg(_listed(F.collect_list(_sample(at, value, count))).alias(name))


def sample_rows(findings: DataFrame) -> DataFrame:
    """``check_id, staging_column, place, value, n``: the samples of findings, one per row."""
    return findings.where(F.size("samples") > 0).select("check_id", "staging_column", F.posexplode("samples").alias("place", "s")).select(
        "check_id", "staging_column", "place", F.col("s.value").alias("value"), F.col("s.count").alias("n")
    )


def report(findings: DataFrame, *metrics: str) -> DataFrame:
    """Flat view of findings with the named metrics as columns; counts as doubles, like the metrics."""
    return findings.select(
        "check_id", "severity", "staging_column",
        *[F.col(c).cast("double").alias(c) for c in ("affected", "total", "pct")],
        *[F.col("metrics").getItem(m).alias(m) for m in metrics],
    )
