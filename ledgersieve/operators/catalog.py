"""What a file is and which staging column each header fills, over all files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import rules, templates
from ..findings import emit, finding
from ..functions.text import header_key, source_key
from . import fuzzy

LEVEL_ORDER = ["required", "recommended", "conditional_required", "optional"]


def fingerprints(spark: SparkSession, table: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(s, h) for s, headers in (table or rules.FINGERPRINTS).items() for h in headers]
    return spark.createDataFrame(rows, "source string, header string").select("source", source_key("header").alias("key"))


def detect_sources(
    columns: DataFrame, marks: DataFrame, folders: DataFrame | None = None, overrides: DataFrame | None = None,
) -> DataFrame:
    """``file, source`` by override, then folder name, then header fingerprints.

    ``columns`` has ``file, raw``; ``folders`` has ``file, folder``; ``overrides`` has ``file, source``.
    """
    headers = columns.select("file", source_key("raw").alias("key")).distinct()
    scores = headers.join(marks, "key").groupBy("file", "source").agg(F.count("*").alias("hits"))
    best = scores.groupBy("file").agg(
        F.max("hits").alias("hits"),
        F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("r"), F.col("source").alias("s")))).alias("all"),
    )
    tied = F.transform(F.filter("all", lambda s: s["r"] == -F.col("hits")), lambda s: s["s"])
    best = best.select("file", "hits", tied.alias("tied"))
    # Combined and charges share headers; the transaction type tells them apart.
    typed = headers.where(F.col("key") == "transactiontype").select("file", F.lit(True).alias("typed")).distinct()
    pair = F.array(F.lit("billing_charges"), F.lit("billing_combined"))
    found = (
        F.when(F.col("hits") < rules.MIN_FINGERPRINT_HITS, "unknown")
        .when(F.size("tied") == 1, F.get("tied", F.lit(0)))
        .when(F.col("tied") == pair, F.when(F.col("typed"), "billing_combined").otherwise("billing_charges"))
        .otherwise("unknown")
    )
    files = columns.select("file").distinct().join(best, "file", "left").join(typed, "file", "left")
    choice = F.coalesce(found, F.lit("unknown"))
    if folders is not None:
        named = folders.select("file", F.when(F.col("folder").isin(rules.SOURCES), F.col("folder")).alias("by_folder"))
        files = files.join(named, "file", "left")
        choice = F.coalesce("by_folder", choice)
    if overrides is not None:
        files = files.join(overrides.select("file", F.col("source").alias("by_override")), "file", "left")
        choice = F.coalesce("by_override", choice)
    return files.select("file", choice.alias("source"))


def staging_table(source: Column) -> Column:
    name = F.lit(None).cast("string")
    for s, table in rules.STAGING_TABLE.items():
        name = F.when(source == s, table).otherwise(name)
    return name


def billing_format(sources: DataFrame, *keys: str) -> DataFrame:
    """Combined, separate, none or unknown, with a note: one row, or one per value of ``keys`` (a client, a round)."""
    def has(name: str) -> Column:
        return F.coalesce(F.bool_or(F.col("source") == name), F.lit(False))

    flags = sources.groupBy(*keys).agg(
        has("billing_combined").alias("combined"), has("billing_charges").alias("charges"),
        has("billing_transactions").alias("transactions"),
    )
    either = F.col("charges") | F.col("transactions")
    kind = (
        F.when(F.col("combined"), "combined").when(F.col("charges") & F.col("transactions"), "separate")
        .when(either, "unknown").otherwise("none")
    )
    note = (
        F.when(F.col("combined") & either, "one combined billing file, beside separate ones")
        .when(F.col("combined"), "one combined billing file")
        .when(F.col("charges") & F.col("transactions"), "charges and transactions in separate files")
        .when(F.col("charges"), "charges without a transactions file")
        .when(F.col("transactions"), "transactions without a charges file")
        .otherwise("no billing file")
    )
    return flags.select(*keys, kind.alias("format"), note.alias("notes"))


def _targets(aliases: DataFrame, by: Column, name: str) -> DataFrame:
    """Staging columns per alias form, first listed first; a handful per alias."""
    once = aliases.groupBy("staging_table", by.alias(name), "staging").agg(F.min("ord").alias("ord"))
    return once.groupBy("staging_table", name).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "staging"))), lambda s: s["staging"]).alias(f"{name}_targets")
    )


def map_headers(columns: DataFrame, aliases: DataFrame, threshold: float = rules.HEADER_FUZZY) -> DataFrame:
    """Headers to staging columns: exact alias, normalised alias, most similar alias, or unmapped.

    ``columns`` has ``file, staging_table, raw``; ``aliases`` has ``staging_table, alias, staging, ord``.
    """
    exact = _targets(aliases, F.col("alias"), "raw")
    normal = _targets(aliases, header_key("alias"), "norm")
    known = (
        columns.withColumn("norm", header_key("raw"))
        .join(exact, ["staging_table", "raw"], "left")
        .join(normal, ["staging_table", "norm"], "left")
    )
    rest = known.where(F.col("raw_targets").isNull() & F.col("norm_targets").isNull() & F.col("staging_table").isNotNull())
    best = fuzzy.best_match(
        rest.select(F.col("staging_table").alias("scope"), F.col("norm").alias("text")),
        aliases.select(F.col("staging_table").alias("scope"), header_key("alias").alias("text")),
        threshold,
    )
    similar = best.select(F.col("scope").alias("staging_table"), F.col("text").alias("norm"), F.col("best"), "score").join(
        normal.select("staging_table", F.col("norm").alias("best"), F.col("norm_targets").alias("similar_targets")),
        ["staging_table", "best"],
    )
    mapped = known.join(similar, ["staging_table", "norm"], "left")
    targets = F.coalesce("raw_targets", "norm_targets", "similar_targets", F.array().cast("array<string>"))
    label = (
        F.when(F.col("raw_targets").isNotNull(), "EXACT").when(F.col("norm_targets").isNotNull(), "NORMALIZED")
        .when(F.col("similar_targets").isNotNull(), "FUZZY").otherwise("UNMAPPED")
    )
    fuzzy_only = label == "FUZZY"
    return mapped.select(
        *columns.columns, targets.alias("staging_cols"), F.get(targets, F.lit(0)).alias("staging"), label.alias("confidence"),
        F.when(fuzzy_only, F.col("score")).alias("fuzzy_score"),
        F.concat_ws(
            "; ",
            F.when(fuzzy_only, F.format_string("resembles the alias '%s'", "best")),
            F.when(F.size(targets) > 1, F.concat(F.lit("DUAL: "), F.array_join(targets, " + "))),
        ).alias("notes"),
    )


def reroute(mapping: DataFrame, value_facts: DataFrame) -> DataFrame:
    """Move organisation columns between name and id by what their values look like.

    ``value_facts`` has ``file, raw, id_like``.
    """
    to_id, to_name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, id_ in rules.ORG_NAME_TO_ID.items():
        to_id = F.when(F.col("staging") == name, id_).otherwise(to_id)
        to_name = F.when(F.col("staging") == id_, name).otherwise(to_name)
    facts = mapping.join(value_facts.select("file", "raw", "id_like"), ["file", "raw"], "left")
    moved = F.when(F.col("id_like"), to_id).when(~F.col("id_like"), to_name)
    note = F.when(F.col("id_like"), "moved to the id column, since most values are codes").otherwise(
        "moved to the name column, since few values are codes"
    )
    return facts.withColumn("moved", moved).withColumns({
        "staging_cols": F.when(F.col("moved").isNotNull(), F.array("moved")).otherwise(F.col("staging_cols")),
        "staging": F.coalesce("moved", "staging"),
        "notes": F.when(F.col("moved").isNotNull(), F.concat_ws("; ", note, F.when(F.col("notes") != "", F.col("notes")))).otherwise(F.col("notes")),
    }).drop("moved", "id_like")


def with_structure(mapping: DataFrame, structure: DataFrame) -> DataFrame:
    """Type and size of the first staging column."""
    return mapping.join(structure, ["staging_table", "staging"], "left")


def levels_table(spark: SparkSession) -> DataFrame:
    rows = [(s, c, level) for s in rules.SOURCES for c, level in templates.staging_levels(s).items()]
    return spark.createDataFrame(rows, "source string, target string, level string")


def with_level(mapping: DataFrame, levels: DataFrame) -> DataFrame:
    """Highest requirement level over the staging columns of a header; per source."""
    order = F.array(*[F.lit(x) for x in LEVEL_ORDER])
    ranked = (
        mapping.select("file", "source", "raw", F.explode("staging_cols").alias("target"))
        .join(levels, ["source", "target"])
        .groupBy("file", "raw").agg(F.min(F.array_position(order, F.col("level"))).alias("rank"))
    )
    joined = mapping.join(ranked, ["file", "raw"], "left")
    level = F.get(order, (F.col("rank") - 1).cast("int"))
    unmapped = F.when(F.col("confidence") == "UNMAPPED", "unmapped").otherwise("unclassified")
    return joined.withColumn("level", F.coalesce(level, unmapped)).drop("rank")


def covered(mapping: DataFrame) -> DataFrame:
    """``file, target, raw, confidence``: staging columns a mapped header fills."""
    return mapping.where(F.col("confidence") != "UNMAPPED").select(
        "file", F.explode("staging_cols").alias("target"), "raw", "confidence"
    )


def uncovered(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """``file, source, kind, staging``: required and recommended staging columns nothing fills."""
    spark = files.sparkSession
    rows = [(s, "required", c) for s in rules.SOURCES for c in templates.required_staging(s)]
    rows += [
        (s, "recommended", c) for s, table in rules.STAGING_TABLE.items() for c in rules.RECOMMENDED_STAGING.get(table, [])
    ]
    wanted = spark.createDataFrame(rows, "source string, kind string, staging string")
    filled = covered(mapping).select("file", F.col("target").alias("staging")).distinct()
    return files.select("file", "source").join(wanted, "source").join(filled, ["file", "staging"], "left_anti").select(
        "file", "source", "kind", "staging"
    )


def mapping_gaps(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """Unmapped headers, uncovered staging columns and headers mapped twice, as one list."""
    unmapped = mapping.where(F.col("confidence") == "UNMAPPED").select("file", F.lit("UNMAPPED").alias("gap"), F.col("raw").alias("name"))
    missing = uncovered(files, mapping).select("file", F.upper(F.concat(F.lit("uncovered_"), "kind")).alias("gap"), F.col("staging").alias("name"))
    dual = mapping.where(F.size("staging_cols") > 1).select("file", F.lit("DUAL").alias("gap"), F.col("raw").alias("name"))
    return unmapped.unionByName(missing).unionByName(dual)


def fields_table(spark: SparkSession) -> DataFrame:
    rows = [(f.source, f.level, f.header, list(f.targets), f.by_header) for f in templates.all_fields()]
    return spark.createDataFrame(rows, "source string, level string, header string, targets array<string>, by_header boolean")


_ORG = ["BillPracticeName", "BillPracticeId", "BillLocationName", "BillLocationId", "BillDepartmentName", "BillDepartmentId"]
_LATER_ICD = ["Third ICD-10 CM Code", "Fourth ICD-10 CM Code", "5th through 25th ICD-10 CM Code"]
_CHARGE, _INVOICE = "Charge ID", "Invoice Number / Encounter ID"


def schema_coverage(files: DataFrame, mapping: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Every template field of every file: PRESENT, MISSING or N/A, with severity and a note.

    ``files`` has ``file, source``; ``mapping`` has ``file, raw, staging_cols, confidence``.
    """
    fields = fields_table(files.sparkSession) if fields is None else fields
    expected = files.select("file", "source").join(fields, "source")
    staged = covered(mapping).groupBy("file", "target").agg(F.min("raw").alias("raw"))
    headers = mapping.groupBy("file", header_key("raw").alias("target")).agg(F.min("raw").alias("raw"))
    wanted = expected.select(
        "file", "source", "level", "header", "by_header", F.get("targets", F.lit(0)).alias("staging"),
        F.explode_outer(F.when(F.col("by_header"), F.array(header_key("header"))).otherwise(F.col("targets"))).alias("target"),
    )
    by_stage = wanted.where(~F.col("by_header")).join(staged, ["file", "target"], "left")
    by_header = wanted.where("by_header").join(headers, ["file", "target"], "left")
    status = by_stage.unionByName(by_header).groupBy("file", "source", "level", "header", "by_header", "staging").agg(
        F.min("raw").alias("raw"), F.count("target").alias("targets"),
    )
    org = covered(mapping).groupBy("file").agg(
        F.bool_or(F.col("target").isin(_ORG)).alias("any_org"), F.bool_or(F.col("target") == "SecondaryIcdCodes").alias("secondary_icd"),
    )
    per_file = Window.partitionBy("file")

    def here(header: str) -> Column:
        return F.bool_or((F.col("header") == header) & F.col("raw").isNotNull()).over(per_file)

    status = status.withColumns({"has_charge": here(_CHARGE), "has_invoice": here(_INVOICE)}).join(org, "file", "left")
    gone = (F.col("targets") > 0) & F.col("raw").isNull()
    billing = F.col("source").isin("billing_combined", "billing_charges")
    linked = billing | (F.col("source") == "billing_transactions")
    any_org = F.coalesce("any_org", F.lit(False))
    usual = (
        F.when(F.col("level") == "required", "CRITICAL").when(F.col("level") == "optional", "INFO").otherwise("HIGH")
    )
    severity = (
        F.when(billing & (F.col("header") == "Cost Center") & any_org, "HIGH")
        .when(linked & (F.col("header") == _CHARGE) & F.col("has_invoice"), "HIGH")
        .when(linked & (F.col("header") == _INVOICE) & F.col("has_charge"), "HIGH")
        .when(billing & F.col("header").isin(_LATER_ICD) & F.coalesce("secondary_icd", F.lit(False)), "INFO")
        .otherwise(usual)
    )
    note = (
        F.when(F.col("targets") == 0, "not checked, since nothing stores it")
        .when(gone & billing & (F.col("header") == "Cost Center") & any_org, "no cost center; another organisation field must lead to the ledger")
        .when(gone & billing & (F.col("header") == "Cost Center"), "no cost center and no other organisation field, so nothing leads to the ledger")
        .when(gone & linked & (F.col("header") == _CHARGE) & F.col("has_invoice"), "no charge id; the invoice number links instead")
        .when(gone & linked & (F.col("header") == _INVOICE) & F.col("has_charge"), "no invoice number; the charge id links instead")
        .otherwise("")
    )
    return status.select(
        "file", "source", "level", "header",
        F.when(F.col("by_header"), "_raw_check").otherwise(F.col("staging")).alias("staging"),
        F.when(F.col("targets") == 0, "N/A").when(gone, "MISSING").otherwise("PRESENT").alias("status"),
        F.when(gone, severity).alias("severity"), F.col("raw"), note.alias("notes"),
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Per file: fields present, missing and in total by level; conditional ones count as recommended."""
    level = F.when(F.col("level") == "conditional_required", "recommended").otherwise(F.col("level"))
    out = []
    for name in ("required", "recommended", "optional"):
        mine = level == name
        out += [
            F.count_if(mine).alias(f"{name}_total"),
            F.count_if(mine & (F.col("status") == "PRESENT")).alias(f"{name}_present"),
            F.count_if(mine & (F.col("status") != "PRESENT")).alias(f"{name}_missing"),
        ]
    return coverage.groupBy("file", "source").agg(*out)


def coverage_findings(coverage: DataFrame, ctx) -> DataFrame:
    """Missing fields as phase-2 findings of the file the context stands for."""
    rows = coverage.where((F.col("status") == "MISSING") & (F.col("file") == ctx.file))
    return emit(rows, ctx, [finding(
        "schema_missing", F.col("severity"),
        F.format_string("no header gives '%s' (%s)", "header", "level"),
        column=F.col("staging"), field=F.col("header"), level=F.col("level"),
    )], phase=2)


def system_field(c: Column | str) -> Column:
    """Header that looks like a system field; the fragments are normalised like the header is."""
    fragments = sorted({f.replace("_", "") for f in rules.SYSTEM_FRAGMENTS})
    return header_key(c).rlike("|".join(fragments))


def unrecognised(mapping: DataFrame, structure: DataFrame) -> DataFrame:
    """Unmapped headers with the nearest staging column, and fuzzy mappings to confirm.

    ``structure`` has ``staging_table, staging``.
    """
    unmapped = mapping.where(F.col("confidence") == "UNMAPPED").select("file", "staging_table", "raw", header_key("raw").alias("norm"))
    probing = unmapped.where(~system_field("raw") & F.col("staging_table").isNotNull())
    names = structure.groupBy("staging_table", header_key("staging").alias("norm")).agg(F.min("staging").alias("nearest"))
    best = fuzzy.best_match(
        probing.select(F.col("staging_table").alias("scope"), F.col("norm").alias("text")),
        names.select(F.col("staging_table").alias("scope"), F.col("norm").alias("text")), rules.NEAR_MISS,
    ).select(F.col("scope").alias("staging_table"), F.col("text").alias("norm"), F.col("best"), "score")
    near = best.join(names.select("staging_table", F.col("norm").alias("best"), "nearest"), ["staging_table", "best"])
    lost = unmapped.join(near, ["staging_table", "norm"], "left").select(
        "file", "raw", "nearest", "score",
        F.when(F.col("score") >= rules.HEADER_FUZZY, "HIGH").when(F.col("score") >= rules.NEAR_MISS, "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(F.col("score") >= rules.HEADER_FUZZY, F.format_string("nearly the same as '%s'; an alias would settle it", "nearest"))
        .when(F.col("score").isNotNull(), F.format_string("may be '%s'", "nearest"))
        .when(system_field("raw"), "resembles no column; named like a field of the source system")
        .otherwise("resembles no column").alias("notes"),
    )
    review = mapping.where(F.col("confidence") == "FUZZY").select(
        "file", "raw", F.col("staging").alias("nearest"), F.col("fuzzy_score").alias("score"), F.lit("REVIEW").alias("severity"),
        F.format_string("taken by resemblance: does '%s' hold '%s'?", "raw", "staging").alias("notes"),
    )
    return lost.unionByName(review)
