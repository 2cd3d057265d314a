"""Small tables a client or the reviewer supplies: overrides, transform rules, aliases, structure, code sets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules
from ..context import TransactionTypes
from ..functions import formula
from ..functions.text import present, strip


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """CSV with trimmed text cells, or parquet; None if the file is not there."""
    try:
        df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", "true").csv(path)
    except AnalysisException:
        return None
    return df.select(*[strip(F.col(f"`{c}`").cast("string")).alias(c.strip().lstrip("﻿")) for c in df.columns])


def source_overrides(spark: SparkSession, directory: str, files: list[str]) -> DataFrame:
    """``file, source`` from sources.csv, for files named there with or without their folder; unknown sources are left out."""
    table = _read(spark, f"{directory.rstrip('/')}/sources.csv")
    if table is None:
        return spark.createDataFrame([], "file string, source string")
    known = spark.createDataFrame([(f, n) for f in files for n in {f, f.rsplit("/", 1)[-1]}], "file string, Filename string")
    named = table.select("Filename", F.col("Source").alias("source")).where(present("Filename") & F.col("source").isin(rules.SOURCES))
    return known.join(named, "Filename").groupBy("file").agg(F.max_by("source", F.length("Filename")).alias("source"))


def reading_options(spark: SparkSession, directory: str) -> dict[str, dict]:
    """Per file of sources.csv the ``encoding`` and ``multi_line`` to read it with, where the table has these columns."""
    table = _read(spark, f"{directory.rstrip('/')}/sources.csv")
    if table is None:
        return {}
    out: dict[str, dict] = {}
    for row in table.collect():  # one row per file
        named = row.asDict()
        options: dict = {}
        if named.get("Encoding"):
            options["encoding"] = named["Encoding"]
        if (named.get("MultiLine") or "").lower() in ("y", "yes", "true", "1"):
            options["multi_line"] = True
        if named.get("Filename") and options:
            out[named["Filename"]] = options
    return out


def transform_rules(spark: SparkSession, directory: str) -> list[tuple[str, str]]:
    """Valid ``staging column, formula`` pairs from column_transforms.csv, header spelling free."""
    table = _read(spark, f"{directory.rstrip('/')}/column_transforms.csv")
    if table is None:
        return []
    names = {c.lower().replace("_", ""): c for c in table.columns}
    if not {"stagingcolumn", "formula"} <= set(names):
        return []
    rows = table.select(F.col(names["stagingcolumn"]).alias("c"), F.col(names["formula"]).alias("f")).where(present("c") & present("f"))
    return [(r.c, r.f) for r in rows.collect() if formula.is_valid(spark, r.f)]


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """``staging_table, alias, staging, ord``."""
    table = _read(spark, path)
    return table.select(
        F.col("Staging_Table").alias("staging_table"), F.col("RawColumn").alias("alias"),
        F.col("StagingColumn").alias("staging"), F.monotonically_increasing_id().alias("ord"),
    ).where(present("staging_table") & present("alias") & present("staging"))


def structure(spark: SparkSession, path: str) -> DataFrame:
    """``staging_table, staging, sql_type, max_length, precision, scale``."""
    table = _read(spark, path)

    def whole(name: str):
        n = F.col(name).try_cast("double").cast("int") if name in table.columns else F.lit(None).cast("int")
        return F.when(n >= 0, n)

    return table.select(
        F.col("Staging_Table").alias("staging_table"), F.col("Source_Column").alias("staging"),
        F.lower(F.col("Type")).alias("sql_type"), whole("Max_Length").alias("max_length"),
        whole("Precision").alias("precision"), whole("Scale").alias("scale"),
    ).where(present("staging_table") & present("staging")).dropDuplicates(["staging_table", "staging"])


def transaction_types(spark: SparkSession, path: str) -> TransactionTypes:
    """Charge and transaction codes and descriptions; a few dozen values per client system."""
    table = _read(spark, path)
    if table is None:
        return TransactionTypes()
    kind = F.lower(F.col("`Type?`"))
    rows = table.select(kind.alias("k"), F.col("TransactionType").alias("c"), F.lower("TransactionTypeDesc").alias("d")).distinct().collect()

    def pick(name: str, column: str) -> frozenset[str]:
        return frozenset(r[column] for r in rows if r.k == name and r[column])

    return TransactionTypes(pick("charge", "c"), pick("charge", "d"), pick("transactions", "c"), pick("transactions", "d"))


def code_set(spark: SparkSession, path: str) -> DataFrame | None:
    """A procedure or place code set; None if absent, which the checks report as skipped."""
    return _read(spark, path)
