"""The whole review of one submission in one session: files to findings to verdict.

What comes to the driver is metadata only: one row per file and one per header.
Each check's findings are written to the shared work folder as they are ready,
several checks at a time, so no plan holds more than one check and a lost executor
costs one check at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules, templates
from ..checks import conformance, cross_source, universal
from ..checks.billing import charge_transaction_linkage
from ..checks.registry import check_runs
from ..context import ColumnMeta, Context, TransactionTypes
from ..findings import SCHEMA
from ..functions.formula import apply_transforms
from ..functions.text import header_key
from ..operators import catalog, frequency, issues as iss, months as mon, profile as prof, rollups
from ..sources import config, extracts


@dataclass(frozen=True)
class References:
    """Tables that do not depend on the client."""

    aliases: DataFrame
    structure: DataFrame
    types: TransactionTypes = field(default_factory=TransactionTypes)
    ref_cpt: DataFrame | None = None
    ref_pos: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> "References":
        """From CSV files named after what they hold; code sets may be absent."""
        path = folder.rstrip("/")
        return cls(
            config.aliases(spark, f"{path}/aliases.csv"), config.structure(spark, f"{path}/structure.csv"),
            config.transaction_types(spark, f"{path}/transaction_types.csv"),
            config.code_set(spark, f"{path}/cpt.csv"), config.code_set(spark, f"{path}/pos.csv"),
        )


@dataclass
class Review:
    client: str
    round: str
    files: DataFrame
    sources: DataFrame
    column_map: DataFrame
    billing_format: DataFrame
    months: DataFrame
    coverage: DataFrame
    unrecognised: DataFrame
    findings: DataFrame
    tables: dict[str, DataFrame]
    contexts: dict[str, Context]

    @property
    def issues(self) -> DataFrame:
        return iss.deduplicate(iss.issues(self.findings))

    @property
    def client_issues(self) -> DataFrame:
        return iss.client_issues(self.issues)

    @property
    def missing_sources(self) -> DataFrame:
        here = self.files.select("client", "round").distinct()
        return iss.missing_sources(here, self.sources.select(F.lit(self.client).alias("client"), F.lit(self.round).alias("round"), "source"))

    @property
    def readiness(self) -> DataFrame:
        return iss.readiness(self.issues, self.missing_sources)

    @property
    def checklist(self) -> DataFrame:
        return iss.checklist(self.client_issues, self.missing_sources)

    @property
    def cost_centers(self) -> DataFrame:
        return rollups.cost_centers(self.tables, self.contexts)

    @property
    def providers(self) -> DataFrame:
        return rollups.providers(self.tables, self.contexts)


def _settled(metadata: DataFrame) -> DataFrame:
    """Run a metadata query once (a row per file or per header) and keep its rows as a local table."""
    return metadata.sparkSession.createDataFrame(metadata.collect(), metadata.schema)


THREADS = 8  # jobs submitted at a time; Spark shares the executors among them


def work_folder(spark: SparkSession, shared: str | None) -> str:
    """A new folder below one that driver and executors share: the given one, or that of ``spark.checkpoint.dir``."""
    base = shared or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("a review needs a folder that all executors share: pass work=, or set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/review-{uuid.uuid4().hex}"


def store(spark: SparkSession, builders: list[Callable[[], DataFrame]], folder: str) -> DataFrame:
    """Build and write every part, then read them back as one table."""
    def write(numbered: tuple[int, Callable[[], DataFrame]]) -> str:
        i, build = numbered
        path = f"{folder}/{i:04d}"
        build().write.mode("overwrite").parquet(path)
        return path

    with ThreadPoolExecutor(THREADS) as pool:
        paths = list(pool.map(write, enumerate(builders)))
    return spark.read.schema(", ".join(f"{c} {t}" for c, t in SCHEMA.items())).parquet(*paths)


def _column_meta(rows) -> tuple[ColumnMeta, ...]:
    metas, seen = [], set()
    for r in rows:
        for target in r.staging_cols:
            if target not in seen:
                seen.add(target)
                metas.append(ColumnMeta(target, r.raw, r.sql_type or "", r.max_length, r.precision, r.scale, r.level))
    return tuple(metas)


def _header_mapping(columns: DataFrame) -> DataFrame:
    """Sources without a staging table keep their template headers, found by normalised spelling."""
    spark = columns.sparkSession
    names = [(f.source, f.header) for s in rules.NO_STAGING for f in templates.fields(s)]
    wanted = spark.createDataFrame(names, "source string, header string").withColumn("norm", header_key("header"))
    return columns.withColumn("norm", header_key("raw")).join(wanted, ["source", "norm"], "left").select(
        "file", "raw", "position", F.when(F.col("header").isNotNull(), F.array("header")).alias("headers")
    )


def map_columns(spark: SparkSession, files: dict, sources: DataFrame, refs: References) -> DataFrame:
    """The full column map: mapping, rerouting by values, types and requirement levels."""
    infos = [info for info, _ in files.values()]
    columns = extracts.columns_table(spark, infos).join(sources, "file").withColumn("staging_table", catalog.staging_table(F.col("source")))
    mapping = catalog.map_headers(columns, refs.aliases)
    org = [*rules.ORG_NAME_TO_ID, *rules.ORG_NAME_TO_ID.values()]
    probes: dict[str, list[str]] = {}
    for r in mapping.where(F.col("staging").isin(org)).select("file", "raw").distinct().collect():  # at most six per file
        probes.setdefault(r.file, []).append(r.raw)
    facts = [frequency.id_like_columns(files[file][1], raws).withColumn("file", F.lit(file)) for file, raws in probes.items()]
    if facts:
        mapping = catalog.reroute(mapping, reduce(DataFrame.unionByName, facts).select("file", "raw", "id_like"))
    by_header = _header_mapping(columns).select("file", "raw", "headers")
    mapping = mapping.join(by_header, ["file", "raw"], "left").withColumn(
        "staging_cols", F.coalesce("headers", "staging_cols")
    ).drop("headers")
    typed = catalog.with_structure(mapping, refs.structure)
    return catalog.with_level(typed, catalog.levels_table(spark))


def review(
    spark: SparkSession, directory: str, refs: References, client: str, round_: str = "v1",
    window: tuple[date, date] | None = None, test_month: str | None = None, work: str | None = None,
    inventory: str | None = None,
) -> Review:
    """Read, map and check every file of a submission.

    ``window`` is the expected date range, if one was agreed; ``work`` is a folder that driver and
    executors share, where the parsed files and the findings are written; ``inventory`` is a lasting
    one, from which files that have not changed since an earlier review are opened without parsing.
    """
    folder = work_folder(spark, work)
    files = extracts.read_submission(spark, directory, folder, reading=config.reading_options(spark, directory), inventory=inventory)
    infos = [info for info, _ in files.values()]
    inventory = extracts.files_table(spark, infos, client, round_)
    headers = extracts.columns_table(spark, infos)
    folders = spark.createDataFrame([(i.name, i.folder) for i in infos], "file string, folder string")
    sources = _settled(catalog.detect_sources(headers, catalog.fingerprints(spark), folders, config.source_overrides(spark, directory, list(files))))
    column_map = _settled(map_columns(spark, files, sources, refs))
    transforms = config.transform_rules(spark, directory)

    by_file: dict[str, list] = {}
    for r in column_map.orderBy("file", "position").collect():
        by_file.setdefault(r.file, []).append(r)
    tables: dict[str, DataFrame] = {}
    contexts: dict[str, Context] = {}
    per_file: list[tuple[Context, DataFrame]] = []
    for name, (info, raw) in files.items():
        rows = by_file.get(name, [])
        source = rows[0].source if rows else "unknown"
        if raw is None or source == "unknown":
            continue
        targets = {r.raw: list(r.staging_cols) for r in rows}
        if source == "gl" and "Account Type" in targets:
            targets["Account Type"].append("AcctType")  # no staging column, but the classification reads it
        df = apply_transforms(extracts.rename_to_staging(raw, targets), transforms)
        ctx = Context(
            source, client, round_, name, test_month, window, _column_meta(rows), refs.types, refs.ref_cpt, refs.ref_pos,
        )
        ctx = prof.with_charge_fact(df, ctx)
        per_file.append((ctx, df))
        if source in contexts and ctx.has_charges is not None:  # several files of one source are one table
            ctx = ctx.for_file(has_charges=ctx.has_charges or contexts[source].has_charges)
        tables[source] = tables[source].unionByName(df, allowMissingColumns=True) if source in tables else df
        contexts[source] = ctx

    months = _settled(reduce(DataFrame.unionByName, [mon.file_month(df, ctx.source, ctx.file) for ctx, df in per_file]))
    if test_month is None:
        agreed = mon.consensus(months).first()
        test_month = agreed.test_month if agreed else None
    coverage = _settled(catalog.schema_coverage(sources, column_map))
    builders: list[Callable[[], DataFrame]] = [
        lambda: mon.alignment_finding(months, per_file[0][0].for_file(test_month=test_month))
    ]
    for ctx, df in per_file:
        ctx = ctx.for_file(test_month=test_month)
        contexts[ctx.source] = ctx.for_file(has_charges=contexts[ctx.source].has_charges)
        builders += _file_checks(df, ctx, coverage)
    if {"billing_charges", "billing_transactions"} <= set(tables):
        builders.append(lambda: charge_transaction_linkage(
            tables["billing_charges"], tables["billing_transactions"], contexts["billing_transactions"]
        ))
    builders += cross_source.cross_checks(tables, contexts)
    findings = store(spark, builders, f"{folder}/findings")
    return Review(
        client, round_, inventory, sources, column_map, catalog.billing_format(sources), months, coverage,
        catalog.unrecognised(column_map, refs.structure), findings, tables, contexts,
    )


def _file_checks(df: DataFrame, ctx: Context, coverage: DataFrame) -> list[Callable[[], DataFrame]]:
    """The checks of one file: coverage, the three groups that read values, and its source's own."""
    def by_value() -> DataFrame:
        profile = prof.profile(df, ctx)
        datatypes = conformance.datatype_findings(profile, ctx, prof.bad_examples(df, ctx))
        return datatypes.unionByName(universal.profile_findings(profile, ctx))

    builders = [
        lambda: catalog.coverage_findings(coverage, ctx), by_value,
        lambda: universal.duplicate_rows(df, ctx), lambda: universal.placeholder_findings(df, ctx),
    ]
    if any(prof.is_numeric(m.sql_type.lower()) for m in prof.mapped(df, ctx)):
        builders.append(lambda: universal.numeric_outliers(df, ctx))
    if ctx.source in rules.LOGICAL_KEYS:
        builders.append(lambda: universal.logical_key_duplicates(df, ctx))
    return builders + check_runs(df, ctx)
