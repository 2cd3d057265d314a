"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of all targets are cut into blocks.  Sources get blocks by highest quotients
``target / (2k - 1)``; the blocks of a source are apportioned to its shards in the same way, so
each shard has an integer quota.  Inside a shard the documents stand in seeded order, the run of
their words is cut into blocks of equal length, and the quota takes every block ``quota div m``
times and a seeded choice of ``quota mod m`` blocks once more.

A shard is a range of hash buckets of one source, sized by the words it holds, so the largest
source is spread over as many shards as it needs.  Documents move once, by source and bucket.

Defined results: a null or empty text has size 0 and nothing is taken; a null source is a source
of its own and comes last; equal quotients go to the smaller source or shard; documents in the
same place of the seeded order are told apart by id and size; an empty table gives no rows;
further columns are carried only where asked for, inside one struct, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersieve.llm.common import bucket_of, null_safe_key, stored, words

#: Words per block.  A quota is off by half a block per shard, so small blocks bring small sources near their targets too.
BLOCK_WORDS = 4
SHARD_WORDS = 1_000_000
BUCKETS = 4096
CAP = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Step of the seeded walk over a shard's blocks: a prime, and a second for shards that the first divides.
STEP, OTHER_STEP = 1_000_003, 2_147_483_647


def apportion(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the party's seats by Sainte-Laguë, ``seats`` in all per group.

    With divisor ``V / N`` a party gets ``votes * N / V`` seats, rounded; the seats in all then
    differ from ``N`` by half a seat per party at most.  So the divisors for ``N - P/2`` and
    ``N + P/2`` bound what any party can get, and only the seats between the bounds are ranked
    by quotient: a few per party, however many seats there are.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    v, n = F.col(votes).cast("double"), F.col(seats).cast("double")
    sized = parties.withColumns({"_all": F.sum(v).over(w), "_half": F.count(F.lit(1)).over(w) / 2})

    def at(total: Column) -> Column:
        return F.floor(F.when(F.col("_all") > 0, v * total / F.col("_all")).otherwise(0.0) + 0.5)

    low = F.greatest(at(F.greatest(n - F.col("_half"), F.lit(0.0))) - 1, F.lit(0))
    bounded = sized.withColumns({"_low": low, "_high": F.when(v > 0, at(n + F.col("_half")) + 1).otherwise(low)})
    open_seats = n - F.sum("_low").over(w)
    ranked = (
        bounded.withColumn("_open", open_seats)
        .filter(F.col("_high") > F.col("_low"))
        .withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
        .withColumn("_q", v / (2 * F.col("_k") - 1))
        .withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_q"), *order, "_k")))
        .filter(F.col("_rank") <= F.col("_open"))
        .groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_won"))
    )
    return (
        bounded.join(ranked, [*group, *order], "left")
        .withColumn(out, (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long"))
        .drop("_all", "_half", "_low", "_high", "_won")
    )


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    What a capped source leaves is shared again by weight until no source is above its cap.  In
    order of ``cap / weight`` the capped sources come first, and the level at which the others
    settle is the largest of ``(all - caps before) / (weights from here on)``.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    everything = Window.partitionBy(F.lit(0))
    fill = everything.orderBy(F.col("_cap") / F.col("weight"), "_n")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("_n", F.row_number().over(by_name))
        .withColumn("weight", F.get(weights, F.pmod(F.col("_n") - 1, F.lit(len(WEIGHTS)))))
        .withColumn("_cap", CAP * F.col("source_size"))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", F.max(F.col("_left") / F.col("_rest")).over(everything))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight")))
        .drop("_n", "_cap", "_left", "_rest", "_level")
    )


def plan(cells: DataFrame, seed: int, block_words: int, shard_words: int) -> DataFrame:
    """One row per source and bucket: where it lies in its shard, the shard's length and quota.

    ``cells`` holds ``key``, ``source``, ``bucket``, ``n_docs`` and ``n_words``: at most one row
    per source and bucket, which is what the windows below see of any number of documents.
    """
    totals = targets(cells.groupBy("key", "source").agg(F.sum("n_words").alias("source_size")))
    everything = Window.partitionBy(F.lit(0))
    totals = totals.withColumn("blocks", F.round(F.sum("source_size").over(everything) / block_words).cast("long"))
    totals = apportion(totals, [], ["key"], "target", "blocks", "source_seats")
    shards = F.least(F.lit(BUCKETS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    placed = cells.drop("source").join(totals, "key").withColumn("shard", F.floor(F.col("bucket") * shards / BUCKETS).cast("int"))
    in_shard = Window.partitionBy("key", "shard")
    before = in_shard.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({
        "cell_start": F.coalesce(F.sum("n_words").over(before), F.lit(0)),
        "shard_words": F.sum("n_words").over(in_shard),
    })
    quotas = (
        placed.groupBy("key", "shard").agg(F.max("shard_words").alias("votes"), F.max("source_seats").alias("seats"))
    )
    quotas = apportion(quotas, ["key"], ["shard"], "votes", "seats", "quota").select("key", "shard", "quota")
    m = F.greatest(F.lit(1), F.round(F.col("shard_words") / block_words)).cast("long")
    return (
        placed.join(quotas, ["key", "shard"])
        .withColumn("m", m)
        .withColumn("quota", F.least(F.col("quota"), CAP * F.col("m")))
        .withColumn("shift", F.pmod(F.xxhash64(F.lit(seed), "key", "shard"), F.col("m")))
        .select("key", "bucket", "source_size", "target", "cell_start", "shard_words", "m", "quota", "shift")
    )


def _taken() -> Column:
    """Words of the document in the chosen blocks, with repeats."""
    start, size, length, m = (F.col(c) for c in ("start", "size", "shard_words", "m"))
    again = F.pmod(F.col("quota"), m)
    step = F.when(m % STEP == 0, F.lit(OTHER_STEP)).otherwise(F.lit(STEP)).cast("long")

    def block_at(word: Column) -> Column:
        return F.floor(((word + 1) * m - 1) / length)

    def edge(j: Column) -> Column:
        return F.floor(j * length / m)

    extra = F.aggregate(
        F.sequence(block_at(start), block_at(start + size - 1)), F.lit(0).cast("long"),
        lambda total, j: total + F.when(
            F.pmod(step * j + F.col("shift"), m) < again,
            F.least(start + size, edge(j + 1)) - F.greatest(start, edge(j)),
        ).otherwise(0),
    )
    every = F.floor(F.col("quota") / m) * size
    return F.when(size > 0, every + F.when(again > 0, extra).otherwise(0)).otherwise(0).cast("long")


def mixed(
    docs: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document; with ``carry`` also ``doc``, the whole row."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    source = F.col(source_col).cast("string")
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        null_safe_key(source).alias("key"), source.alias("source"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)).alias("place"),
        F.size(words(F.col(text_col))).cast("long").alias("size"),
        *kept,
    ).withColumn("bucket", bucket_of(BUCKETS, F.col("place")))
    if not carry:
        sized = stored(sized, "mix-sizes")
    cells = sized.groupBy("key", "source", "bucket").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("n_words"))
    cells = stored(plan(stored(cells, "mix-cells"), seed, block_words, shard_words), "mix-plan")
    order = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.withColumn("in_cell", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(cells, ["key", "bucket"])
        .withColumn("start", F.col("cell_start") + F.col("in_cell"))
        .select("doc_id", "size", "source_size", "target", _taken().alias("taken"), *(["doc"] if carry else []))
    )
