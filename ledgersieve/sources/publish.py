"""Tables published in batches; a commit record, written last and read first, decides which rows are in force.

Every table keeps its batches apart as partitions.  A batch that is never committed, because its
writer failed or was lost, is never read; what was in force before stays so.  A later batch of the
same scope (client, round, source) takes the place of the earlier one with its commit, and the
earlier one's files go afterwards.  There is one writer at a time per root.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

COMMITS = "seq bigint, batch string, tables array<string>, at string"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed batch, in order of ``seq``."""
    path = f"{root.rstrip('/')}/commits"
    if not _exists(spark, path):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).parquet(path)


class Publication:
    """One batch: its tables are written first, :meth:`commit` puts all of them in force at once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.batch, self.tables = spark, root.rstrip("/"), uuid.uuid4().hex, []

    def write(self, df: DataFrame, name: str, *scope: str, within: tuple[str, ...] = (), format: str = "parquet") -> None:
        """``df`` as this batch's part of ``name``; ``scope`` columns say what it replaces, ``within`` are further partitions."""
        df.withColumn("batch", F.lit(self.batch)).write.format(format).mode("append").partitionBy(*scope, "batch", *within).save(f"{self.root}/{name}")
        if name not in self.tables:
            self.tables.append(name)

    def written(self, name: str) -> DataFrame:
        """This batch's part of a table, committed or not."""
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("batch") == self.batch).drop("batch")

    def commit(self) -> None:
        last = commits(self.spark, self.root).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq")).first()["seq"]
        record = [(last + 1, self.batch, self.tables, datetime.now(timezone.utc).isoformat())]
        self.spark.createDataFrame(record, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")


def in_force(spark: SparkSession, root: str, name: str, *scope: str, format: str = "parquet") -> DataFrame | None:
    """The rows of a table that committed batches hold; with ``scope``, of the last batch for each of its values.

    ``None`` where the table was never committed.
    """
    path, done = f"{root.rstrip('/')}/{name}", commits(spark, root).where(F.array_contains("tables", name)).select("seq", "batch")
    if not _exists(spark, path) or done.isEmpty():
        return None
    try:
        rows = spark.read.format(format).option("basePath", path).load(path)
    except AnalysisException:  # a folder of which nothing was finished
        return None
    if scope:
        # Partition columns alone: no file is opened to find the batches that are there.
        there = rows.select(*scope, "batch").distinct().join(F.broadcast(done), "batch")
        done = there.groupBy(*scope).agg(F.max_by("batch", "seq").alias("batch"))
        same = F.expr(" AND ".join(f"t.`{c}` <=> c.`{c}`" for c in (*scope, "batch")))
        return rows.alias("t").join(F.broadcast(done).alias("c"), same, "left_semi").drop("batch")
    return rows.join(F.broadcast(done.select("batch")), "batch", "left_semi").drop("batch")


def drop_superseded(spark: SparkSession, root: str, name: str, *scope: str, format: str = "parquet") -> None:
    """Deletes the files of committed batches that a later commit has replaced for their scope."""
    path = f"{root.rstrip('/')}/{name}"
    done = commits(spark, root).where(F.array_contains("tables", name)).select("seq", "batch")
    there = spark.read.format(format).option("basePath", path).load(path).select(*scope, "batch").distinct().join(F.broadcast(done), "batch")
    last = F.max("seq").over(Window.partitionBy(*scope))  # a row per batch that is still there
    old = there.withColumn("last", last).where("seq < last")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in old.collect():  # one row per replaced batch and scope
        parts = "/".join(f"{c}={escaped(str(row[c]))}" for c in scope)
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{parts}/batch={row['batch']}")
        target.getFileSystem(conf).delete(target, True)
