"""Documents to training mix: the stages in order, each on what the one before it kept.

1. language ID: documents without a language that makes up half of them go,
2. SimHash near-duplicates: one document of each group stays,
3. benchmark decontamination: spans that the benchmark holds are cut out, documents hit for the larger part go,
4. personal data: entities become surrogates,
5. source mix: every document of the mix with the number of its words that the mix takes.

Every stage gets a table and returns one; between stages the table is written and read again, so a
lost executor repeats a stage's tasks at most.  Null and empty texts have no language and end at
the first stage, an empty table passes through empty, and columns besides the text are kept as
they are by all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersieve.llm import decontaminate, language, mixing, pii, simhash
from ledgersieve.llm.common import stored, table, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replaced(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(docs, carry=True).filter(F.col("taken") > 0)
    figures = ("size", "source_size", "target", "taken")
    names = unused(docs.columns, *[f"mix_{c}" for c in figures])
    return mixed.select("doc.*", *[F.col(c).alias(n) for c, n in zip(figures, names, strict=True)])


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("surrogates", surrogate_stage),
    ("source_mix", mix_stage),
]

#: Mixtures, trees and automata are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
