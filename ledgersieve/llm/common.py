"""What the text operators share: tables, the shared folder, word patterns, stored steps."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersieve.sources.steps import shared_folder

SPACE = r"[\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends, and lost executors cost nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front of those that the columns have already (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bucket_of(n: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def null_safe_key(column: Column) -> Column:
    """A text that is empty for null and starts with ``=`` otherwise, for joins and windows."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def slices(batches, at: int, limit: int = 1 << 20):
    """Arrow batches cut so that the texts of one piece hold about ``limit`` bytes; longer texts stand alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            held = np.cumsum(sizes[start:])
            stop = start + max(1, int(np.searchsorted(held, limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
