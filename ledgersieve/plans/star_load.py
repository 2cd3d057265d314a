"""Loading a review's tables into the star schema."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import star
from ..sources.publish import Publication, drop_superseded, in_force

ORIGIN = ("client", "round", "source")
THREADS = 8  # jobs submitted at a time


def read_dimension(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A dimension with its committed members."""
    return in_force(spark, folder, f"dim/{name}")


def read_fact(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A fact: of every client, round and source the rows of the last committed load."""
    return in_force(spark, folder, f"fact/{name}", *ORIGIN)


def load_star(review, folder: str) -> dict[str, int]:
    """Writes members, dimensions, facts and the log of a review below ``folder``; new members per dimension.

    Everything is written as one batch, and counts only with the commit at the end: a load that
    stopped half-way has added nothing, and the next one gives its members the same numbers.  A
    fact replaces that of the same client, round and source; loading the same rows again adds no
    member.
    """
    spark, root = review.files.sparkSession, folder.rstrip("/")
    batch, added = Publication(spark, root), {}
    committed = in_force(spark, root, "members")
    known = committed
    facts = [(source, fact) for source, fact in star.LOADS.items() if source in review.tables]
    for source, fact in facts:
        rows = review.tables[source]
        origin = {"client": F.lit(review.client), "round": F.lit(review.round), "source": F.lit(source)}
        forms = star.load_forms(rows, fact.dimensions)
        batch.write(star.new_members(known, forms, fact.dimensions).sortWithinPartitions("dimension"), "members")
        fresh = batch.written("members").select("dimension", "natural", "attributes", "key")
        known = fresh if committed is None else committed.select(*fresh.columns).unionByName(fresh)
        batch.write(star.build_fact(rows, fact, known, forms).withColumns(origin), f"fact/{fact.name}", *ORIGIN)
        written = batch.written(f"fact/{fact.name}").where(F.col("source") == source)
        batch.write(star.load_log(written, 1, source).withColumns(origin), "log", *ORIGIN)
    if not facts:
        return added

    fresh = batch.written("members")
    counts = {r["dimension"]: r["count"] for r in fresh.groupBy("dimension").count().collect()}  # one row per dimension
    specs = {d.name: d for _, fact in facts for d in fact.dimensions}
    added = {name: counts.get(name, 0) for name in specs}
    with ThreadPoolExecutor(THREADS) as pool:
        list(pool.map(lambda name: batch.write(star.dimension_table(fresh, specs[name]), f"dim/{name}"), specs))
    batch.commit()
    for name in {f"fact/{fact.name}" for _, fact in facts} | {"log"}:
        drop_superseded(spark, root, name, *ORIGIN)
    return added
