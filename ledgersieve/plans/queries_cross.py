"""Catalog, cross-source checks and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules, templates
from ..checks import cross_source as cross
from ..context import Context
from ..findings import report, sample_rows

from ..operators import catalog, fuzzy, keys, star
from . import bindings as b
from .registered import found, pct, query, row

BILLING = Context("billing_charges")


def lcs_sql(a: str, b_: str) -> str:
    """Length of the longest common subsequence of two SQL texts, row by row of the usual table."""
    return (
        f"list_reduce(list_prepend(list_transform(range(0, len({b_}) + 1), lambda i: 0::BIGINT), list_transform(string_split({a}, ''), lambda c: [ascii(c)::BIGINT])), "
        f"lambda r, c: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len({b_}) + 1), lambda j: [j])), "
        f"lambda acc, j: list_append(acc, CASE WHEN ascii({b_}[j[1]]) = c[1] THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], acc[len(acc)]) END)))[len({b_}) + 1]"
    )


def ratio_sql(a: str, b_: str) -> str:
    return f"(200.0::DOUBLE * {lcs_sql(a, b_)} / (len({a}) + len({b_})))"


def best_sql(left: str, right: str, threshold: float) -> str:
    """``scope, text, best, score`` from two relations with ``scope, text, m`` (m: the compared form)."""
    return (
        f"SELECT scope, text, arg_min(r, o) AS best, max(s) AS score FROM (SELECT l.scope, l.text, r.text AS r, {ratio_sql('l.m', 'r.m')} AS s, "
        f"row_number() OVER (PARTITION BY l.scope, l.text ORDER BY s DESC, r.text) AS o FROM {left} l JOIN {right} r ON l.scope = r.scope) "
        f"WHERE s >= {threshold} GROUP BY ALL"
    )


def sorted_sql(c: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({c}, ' '), lambda t: t <> '')), ' ')"


# Fuzzy names.  Parts with an odd size carry a slip of the pen.

_TYPO = "CASE WHEN p_size > 40 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN p_size > 25 THEN p_name || 's' WHEN p_size > 10 THEN substr(p_name, 2) ELSE 'unlisted ' || p_type END"


def _typo():
    size, words = F.col("p_size"), F.split("p_name", " ")
    return (
        F.when(size > 40, F.concat_ws(" ", words[1], words[0])).when(size > 25, F.concat("p_name", F.lit("s")))
        .when(size > 10, F.expr("substr(p_name, 2)")).otherwise(F.concat(F.lit("unlisted "), "p_type"))
    )


def _typo_rel(name: str) -> str:
    return f"{name} AS (SELECT '' AS scope, text, {sorted_sql('text')} AS m FROM (SELECT DISTINCT {_TYPO} AS text FROM part))"


_NAMES_REL = f"n AS (SELECT '' AS scope, text, {sorted_sql('text')} AS m FROM (SELECT DISTINCT p_name AS text FROM part))"


def _names(spark, folder) -> tuple[DataFrame, DataFrame]:
    part = b.table(spark, folder, "part")
    return part.select(_typo().alias("text")), part.select(F.col("p_name").alias("text"))


@query("fuzzy_names", f"WITH {_typo_rel('t')}, {_NAMES_REL} SELECT text, best, score FROM ({best_sql('t', 'n', 80)})")
def fuzzy_names(spark, folder) -> DataFrame:
    return fuzzy.best_match(*_names(spark, folder), rules.NAME_FUZZY).select("text", "best", "score")


@query("fuzzy_names_loose", f"WITH {_typo_rel('t')}, {_NAMES_REL} SELECT text, best, score FROM ({best_sql('t', 'n', 60)})")
def fuzzy_names_loose(spark, folder) -> DataFrame:
    return fuzzy.best_match(*_names(spark, folder), rules.NEAR_MISS).select("text", "best", "score")


def composite_sql(left: str, right: str) -> str:
    """CTEs ending in ``scored (l, r, score)``: the composite score of all pairs of two relations with ``text, m`` (m: the plain form)."""
    tokens = lambda c: f"list_filter(string_split({c}, ' '), lambda t: t <> '')"
    short, long = "CASE WHEN len({0}) > len({1}) THEN {1} ELSE {0} END", "CASE WHEN len({0}) > len({1}) THEN {0} ELSE {1} END"

    def windows(a: str, c: str, weight: str, where: str) -> str:
        s, g = short.format(a, c), long.format(a, c)
        return (f"SELECT l, r, {weight} AS w, s AS x, substr(g, greatest(e - len(s), 0) + 1, e - greatest(e - len(s), 0)) AS y FROM "
                f"(SELECT l, r, weight, s, g, unnest(range(1, len(s) + len(g))) AS e FROM (SELECT l, r, weight, {s} AS s, {g} AS g FROM q WHERE {where}))")

    return f"""p AS (SELECT l.text AS l, r.text AS r, l.m AS a, r.m AS b, greatest(len(l.m), len(r.m))::DOUBLE / least(len(l.m), len(r.m)) AS longer,
 list_sort({tokens('l.m')}) AS sa, list_sort({tokens('r.m')}) AS sb, list_sort(list_distinct({tokens('l.m')})) AS ta, list_sort(list_distinct({tokens('r.m')})) AS tb
 FROM {left} l, {right} r WHERE l.m <> '' AND r.m <> ''),
q AS (SELECT *, array_to_string(sa, ' ') AS wa, array_to_string(sb, ' ') AS wb, list_filter(ta, lambda t: list_contains(tb, t)) AS common,
 trim(array_to_string(list_filter(ta, lambda t: list_contains(tb, t)) || list_filter(ta, lambda t: NOT list_contains(tb, t)), ' ')) AS ua,
 trim(array_to_string(list_filter(ta, lambda t: list_contains(tb, t)) || list_filter(tb, lambda t: NOT list_contains(ta, t)), ' ')) AS ub,
 CASE WHEN longer <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS weight FROM p),
c AS (SELECT l, r, 1::DOUBLE AS w, a AS x, b AS y FROM q UNION ALL SELECT l, r, 0.95::DOUBLE, wa, wb FROM q WHERE longer < 1.5
 UNION ALL SELECT l, r, 0.95::DOUBLE, ua, ub FROM q WHERE longer < 1.5
 UNION ALL SELECT l, r, 0.95::DOUBLE, array_to_string(common, ' '), ua FROM q WHERE longer < 1.5 AND len(common) > 0
 UNION ALL SELECT l, r, 0.95::DOUBLE, array_to_string(common, ' '), ub FROM q WHERE longer < 1.5 AND len(common) > 0
 UNION ALL {windows('a', 'b', 'weight', 'longer >= 1.5')} UNION ALL {windows('wa', 'wb', '0.95::DOUBLE * weight', 'longer >= 1.5 AND len(common) = 0')}),
d AS (SELECT x, y, {ratio_sql('x', 'y')} AS s FROM (SELECT DISTINCT x, y FROM c)),
scored AS (SELECT l, r, max(s) AS score FROM (SELECT l, r, w * s AS s FROM c JOIN d USING (x, y)
 UNION ALL SELECT l, r, 95::DOUBLE FROM q WHERE longer < 1.5 AND len(common) > 0 AND (len(common) = len(ta) OR len(common) = len(tb))
 UNION ALL SELECT l, r, 0.95::DOUBLE * weight * 100 FROM q WHERE longer >= 1.5 AND len(common) > 0) GROUP BY ALL)"""


_PLAIN = "trim(lower(regexp_replace(text, '[^a-zA-Z0-9]', ' ', 'g')))"


@query("fuzzy_names_composite", f"""WITH t AS (SELECT text, {_PLAIN} AS m FROM (SELECT DISTINCT {_TYPO} AS text FROM part)),
 n AS (SELECT text, {_PLAIN} AS m FROM (SELECT DISTINCT p_name AS text FROM part)), {composite_sql('t', 'n')}
 SELECT l AS text, r AS best, score FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS o FROM scored WHERE score >= 80) WHERE o = 1""")
def fuzzy_names_composite(spark, folder) -> DataFrame:
    return fuzzy.best_match(*_names(spark, folder), rules.LOCATION_FUZZY, "composite").select("text", "best", "score")


# Catalog.  Every brand and size is a file, its part names are the headers.

_FILES = "f AS (SELECT DISTINCT p_brand || '/' || p_size AS file, p_name AS raw FROM part)"


@query("source_fingerprint", f"""WITH {_FILES}, k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS source, replace(p_name, ' ', '') AS key FROM part),
 h AS (SELECT file, source, count(*) AS n FROM (SELECT DISTINCT file, replace(raw, ' ', '') AS key FROM f) JOIN k USING (key) GROUP BY ALL),
 x AS (SELECT file, max(n) AS n, count(*) FILTER (n = m) AS ties, arg_max(source, n) AS best FROM (SELECT *, max(n) OVER (PARTITION BY file) AS m FROM h) GROUP BY 1)
 SELECT file, CASE WHEN n < 2 OR ties > 1 THEN 'unknown' ELSE best END AS source FROM x""")
def source_fingerprint(spark, folder) -> DataFrame:
    part = b.table(spark, folder, "part")
    columns = part.select(F.concat_ws("/", "p_brand", "p_size").alias("file"), F.col("p_name").alias("raw")).distinct()
    marks = part.select(F.split("p_name", " ")[0].alias("source"), F.replace("p_name", F.lit(" "), F.lit("")).alias("key")).distinct()
    return catalog.detect_sources(columns, marks)


_RAW = """CASE WHEN p_size <= 12 THEN p_name WHEN p_size <= 24 THEN replace(upper(p_name), ' ', '_') WHEN p_size <= 38 THEN p_name || 's'
 ELSE reverse(p_name) END"""


def _headers(spark, folder) -> tuple[DataFrame, DataFrame]:
    part = b.table(spark, folder, "part")
    size = F.col("p_size")
    raw = (
        F.when(size <= 12, F.col("p_name")).when(size <= 24, F.replace(F.upper("p_name"), F.lit(" "), F.lit("_")))
        .when(size <= 38, F.concat("p_name", F.lit("s"))).otherwise(F.reverse("p_name"))
    )
    columns = part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("staging_table"), raw.alias("raw")).distinct()
    aliases = part.select(
        F.col("p_type").alias("staging_table"), F.col("p_name").alias("alias"), F.split("p_name", " ")[1].alias("staging"), F.lit(0).cast("bigint").alias("ord")
    ).distinct()
    return columns, aliases


_HEADER_CTES = f"""c AS (SELECT DISTINCT p_brand AS file, p_type AS staging_table, {_RAW} AS raw FROM part),
 a AS (SELECT DISTINCT p_type AS scope, p_name AS alias, split_part(p_name, ' ', 2) AS staging, lower(replace(p_name, ' ', '')) AS text, text AS m FROM part),
 d AS (SELECT *, lower(regexp_replace(raw, '[\\s_\\-/.()#]', '', 'g')) AS norm FROM c),
 l AS (SELECT DISTINCT staging_table AS scope, norm AS text, norm AS m FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.scope = d.staging_table AND a.text = d.norm)),
 best AS ({best_sql('l', 'a', 85)}),
 mapped AS (SELECT file, d.staging_table, raw, CASE WHEN e.alias IS NOT NULL THEN 'EXACT' WHEN n.text IS NOT NULL THEN 'NORMALIZED' WHEN best.best IS NOT NULL THEN 'FUZZY' ELSE 'UNMAPPED' END AS confidence,
 coalesce(e.staging, n.staging, s.staging) AS staging, best.score AS fuzzy_score FROM d LEFT JOIN a e ON e.scope = d.staging_table AND e.alias = d.raw
 LEFT JOIN a n ON n.scope = d.staging_table AND n.text = d.norm LEFT JOIN best ON best.scope = d.staging_table AND best.text = d.norm
 LEFT JOIN a s ON s.scope = d.staging_table AND s.text = best.best)"""


@query("header_map", f"WITH {_HEADER_CTES} SELECT file, staging_table, raw, confidence, staging, fuzzy_score FROM mapped")
def header_map(spark, folder) -> DataFrame:
    mapped = catalog.map_headers(*_headers(spark, folder))
    return mapped.select("file", "staging_table", "raw", "confidence", "staging", "fuzzy_score")


_NEAR = f"""{_HEADER_CTES}, g AS (SELECT DISTINCT p_type AS scope, p_name AS staging, lower(replace(p_name, ' ', '')) AS text, text AS m FROM part),
 u AS (SELECT DISTINCT d.staging_table AS scope, d.norm AS text, d.norm AS m FROM d JOIN mapped USING (file, staging_table, raw) WHERE confidence = 'UNMAPPED'
 AND NOT regexp_matches(d.norm, 'rowid|rownum|seq|sequence|lastupdated|lastmodified|createdby|updatedby|extract|import|systemid|systemfield|internal|etl|batchid|batchnum|jobid')),
 nb AS ({best_sql('u', 'g', 60)})
 SELECT mapped.file, raw, g.staging AS nearest, nb.score, CASE WHEN nb.score >= 85 THEN 'HIGH' WHEN nb.score >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS severity
 FROM mapped JOIN d USING (file, staging_table, raw) LEFT JOIN nb ON nb.scope = mapped.staging_table AND nb.text = d.norm LEFT JOIN g ON g.scope = mapped.staging_table AND g.text = nb.best
 WHERE confidence = 'UNMAPPED' UNION ALL SELECT file, raw, staging, fuzzy_score, 'REVIEW' FROM mapped WHERE confidence = 'FUZZY'"""


@query("unrecognised_headers", f"WITH {_NEAR}")
def unrecognised_headers(spark, folder) -> DataFrame:
    columns, aliases = _headers(spark, folder)
    structure = aliases.select("staging_table", F.col("alias").alias("staging"))
    return catalog.unrecognised(catalog.map_headers(columns, aliases), structure).select("file", "raw", "nearest", "score", "severity")


# Coverage.  A part of size n in a brand means that brand's file has the n-th header of its source.

_SOURCES = {
    "ECONOMY": "billing_charges", "SMALL": "billing_transactions", "STANDARD": "scheduling", "MEDIUM": "payroll", "LARGE": "gl", "PROMO": "quality",
}


def _numbered(source: str) -> list[templates.Field]:
    return templates.fields(source)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FIELD_ROWS = ", ".join(
    f"({_quoted(s)}, {i}, {_quoted(f.level)}, {_quoted(f.header)}, {f.by_header}, [{', '.join(map(_quoted, f.targets))}]::VARCHAR[])"
    for s in _SOURCES.values() for i, f in enumerate(_numbered(s), 1)
)
_COVER = f"""fields(source, n, level, header, by_header, targets) AS (VALUES {_FIELD_ROWS}),
 p AS (SELECT DISTINCT p_brand || '/' || p_type AS file, {b.sql_case('p_type', _SOURCES)} AS source, p_size AS n FROM part),
 files AS (SELECT DISTINCT file, source FROM p), mapping AS (SELECT file, source, header AS raw, by_header, targets FROM p JOIN fields USING (source, n)),
 staged AS (SELECT DISTINCT file, unnest(targets) AS target FROM mapping),
 s AS (SELECT file, source, level, header, by_header, targets, CASE WHEN by_header THEN EXISTS (SELECT 1 FROM mapping m WHERE m.file = files.file AND m.raw = fields.header)
 ELSE EXISTS (SELECT 1 FROM staged t WHERE t.file = files.file AND list_contains(fields.targets, t.target)) END AS here FROM files JOIN fields USING (source)),
 x AS (SELECT file, bool_or(target IN ('BillPracticeName', 'BillPracticeId', 'BillLocationName', 'BillLocationId', 'BillDepartmentName', 'BillDepartmentId')) AS org,
 bool_or(target = 'SecondaryIcdCodes') AS icd FROM staged GROUP BY 1),
 y AS (SELECT s.*, coalesce(org, false) AS org, coalesce(icd, false) AS icd, bool_or(header = 'Charge ID' AND here) OVER (PARTITION BY file) AS chg,
 bool_or(header = 'Invoice Number / Encounter ID' AND here) OVER (PARTITION BY file) AS inv FROM s LEFT JOIN x USING (file)),
 cov AS (SELECT file, source, level, header, CASE WHEN NOT by_header AND len(targets) = 0 THEN 'N/A' WHEN here THEN 'PRESENT' ELSE 'MISSING' END AS status,
 CASE WHEN here OR (NOT by_header AND len(targets) = 0) THEN NULL
 WHEN source = 'billing_charges' AND header = 'Cost Center' AND org THEN 'HIGH'
 WHEN source IN ('billing_charges', 'billing_transactions') AND header = 'Charge ID' AND inv THEN 'HIGH'
 WHEN source IN ('billing_charges', 'billing_transactions') AND header = 'Invoice Number / Encounter ID' AND chg THEN 'HIGH'
 WHEN source = 'billing_charges' AND header IN ('Third ICD-10 CM Code', 'Fourth ICD-10 CM Code', '5th through 25th ICD-10 CM Code') AND icd THEN 'INFO'
 WHEN level = 'required' THEN 'CRITICAL' WHEN level = 'optional' THEN 'INFO' ELSE 'HIGH' END AS severity FROM y)"""


def _catalog(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = [(s, i, f.header, list(f.targets)) for s in _SOURCES.values() for i, f in enumerate(_numbered(s), 1)]
    numbered = spark.createDataFrame(rows, "source string, position int, raw string, staging_cols array<string>")
    brands = b.table(spark, folder, "part").select(
        F.concat_ws("/", "p_brand", "p_type").alias("file"), b.case("p_type", _SOURCES).alias("source"), F.col("p_size").alias("position")
    ).distinct()
    mapping = brands.join(numbered, ["source", "position"]).withColumns({"confidence": F.lit("EXACT"), "staging": F.get("staging_cols", F.lit(0))})
    return brands.select("file", "source").distinct(), mapping


@query("schema_coverage", f"WITH {_COVER} SELECT file, level, header, status, severity FROM cov")
def schema_coverage(spark, folder) -> DataFrame:
    return catalog.schema_coverage(*_catalog(spark, folder)).select("file", "level", "header", "status", "severity")


@query("coverage_summary", f"""WITH {_COVER} SELECT file, source, count(*) FILTER (level = 'required') AS required_total,
 count(*) FILTER (level = 'required' AND status = 'PRESENT') AS required_present, count(*) FILTER (level = 'required' AND status <> 'PRESENT') AS required_missing,
 count(*) FILTER (level IN ('recommended', 'conditional_required')) AS recommended_total,
 count(*) FILTER (level IN ('recommended', 'conditional_required') AND status = 'PRESENT') AS recommended_present,
 count(*) FILTER (level IN ('recommended', 'conditional_required') AND status <> 'PRESENT') AS recommended_missing,
 count(*) FILTER (level = 'optional') AS optional_total, count(*) FILTER (level = 'optional' AND status = 'PRESENT') AS optional_present,
 count(*) FILTER (level = 'optional' AND status <> 'PRESENT') AS optional_missing FROM cov GROUP BY 1, 2""")
def coverage_summary(spark, folder) -> DataFrame:
    return catalog.coverage_summary(catalog.schema_coverage(*_catalog(spark, folder)))


_REQUIRED_ROWS = ", ".join(
    [f"('{s}', 'required', '{c}')" for s in _SOURCES.values() for c in templates.required_staging(s)]
    + [f"('{s}', 'recommended', '{c}')" for s in _SOURCES.values() for c in rules.RECOMMENDED_STAGING.get(rules.STAGING_TABLE.get(s, ""), [])]
)


@query("uncovered_columns", f"""WITH {_COVER}, w(source, kind, staging) AS (VALUES {_REQUIRED_ROWS})
 SELECT file, source, kind, staging FROM files JOIN w USING (source) WHERE NOT EXISTS (SELECT 1 FROM staged WHERE staged.file = files.file AND staged.target = w.staging)""")
def uncovered_columns(spark, folder) -> DataFrame:
    return catalog.uncovered(*_catalog(spark, folder))


_LEVEL_ROWS = ", ".join(f"('{s}', {_quoted(c)}, '{lv}')" for s in _SOURCES.values() for c, lv in templates.staging_levels(s).items())


@query("column_levels", f"""WITH {_COVER}, lv(source, target, level) AS (VALUES {_LEVEL_ROWS}), o(level, n) AS (VALUES ('required', 1), ('recommended', 2), ('conditional_required', 3), ('optional', 4)),
 r AS (SELECT file, raw, min(n) AS n FROM (SELECT file, source, raw, unnest(targets) AS target FROM mapping) JOIN lv USING (source, target) JOIN o USING (level) GROUP BY 1, 2)
 SELECT file, raw, coalesce(o.level, 'unclassified') AS level FROM mapping LEFT JOIN r USING (file, raw) LEFT JOIN o ON o.n = r.n""")
def column_levels(spark, folder) -> DataFrame:
    _, mapping = _catalog(spark, folder)
    return catalog.with_level(mapping, catalog.levels_table(spark)).select("file", "raw", "level")


@query("org_reroute", """WITH m AS (SELECT DISTINCT p_brand AS file, p_name AS raw, CASE WHEN p_size > 25 THEN 'BillDepartmentName' ELSE 'BillDepartmentId' END AS staging FROM part),
 v AS (SELECT p_brand AS file, p_name AS raw, avg(CASE WHEN p_retailprice < 950 THEN 1.0 ELSE 0 END) >= 0.7 AS id_like FROM part GROUP BY 1, 2)
 SELECT file, raw, CASE WHEN id_like AND staging = 'BillDepartmentName' THEN 'BillDepartmentId' WHEN NOT id_like AND staging = 'BillDepartmentId' THEN 'BillDepartmentName' ELSE staging END AS staging
 FROM m JOIN v USING (file, raw)""")
def org_reroute(spark, folder) -> DataFrame:
    part = b.table(spark, folder, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("raw"), "p_size", "p_retailprice")
    mapping = part.select("file", "raw", F.when(F.col("p_size") > 25, "BillDepartmentName").otherwise("BillDepartmentId").alias("staging")).distinct().withColumns(
        {"staging_cols": F.array("staging"), "notes": F.lit("")}
    )
    code = F.when(F.col("p_retailprice") < 950, 1.0).otherwise(0.0)
    facts = part.groupBy("file", "raw").agg((F.avg(code) >= rules.ID_LIKE_SHARE).alias("id_like"))
    return catalog.reroute(mapping, facts).select("file", "raw", "staging")


@query("column_catalog", f"""WITH {_COVER}, w(source, kind, staging) AS (VALUES {_REQUIRED_ROWS}),
 u AS (SELECT file, staging FROM files JOIN w USING (source) WHERE kind = 'required' AND NOT EXISTS (SELECT 1 FROM staged WHERE staged.file = files.file AND staged.target = w.staging))
 SELECT m.file, m.raw AS "column", p.n AS position, true AS in_client_file FROM mapping m JOIN fields f ON f.source = m.source AND f.header = m.raw JOIN p ON p.file = m.file AND p.n = f.n
 UNION ALL SELECT file, staging || '_Calculated', 0, false FROM u""")
def column_catalog(spark, folder) -> DataFrame:
    files, mapping = _catalog(spark, folder)
    gaps = catalog.uncovered(files, mapping).where(F.col("kind") == "required").select("file", "staging")
    return star.column_catalog(mapping, gaps.where(F.lit(False)), gaps)


@query("mapping_catalog", f"""WITH {_COVER}, pairs AS (SELECT file, raw AS "column", unnest(targets) AS staging FROM mapping), k AS (SELECT DISTINCT unnest(targets) AS staging FROM fields WHERE level = 'required')
 SELECT file, "column", staging, CASE WHEN k.staging IS NULL THEN 'staging column not found' END AS rejected, k.staging IS NOT NULL AS accepted FROM pairs LEFT JOIN k USING (staging)""")
def mapping_catalog(spark, folder) -> DataFrame:
    _, mapping = _catalog(spark, folder)
    pairs = mapping.select("file", F.col("raw").alias("column"), F.explode("staging_cols").alias("staging"))
    required = [(t,) for s in _SOURCES.values() for f in _numbered(s) if f.level == "required" for t in f.targets]
    return star.mapping_catalog(pairs, mapping.select("file", F.col("raw").alias("column")), spark.createDataFrame(required, "staging string"))


# Keys, balances and coverage between sources.

@query("txn_match_rate", found(
    f"""{b.TRANSACTIONS}, m AS (SELECT count(*) AS t, count(*) FILTER (ChargeId IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)) AS n,
 count(DISTINCT ChargeId) AS d, (SELECT count(*) FROM orders) AS c FROM transactions WHERE ChargeId <> '')""",
    row("C0a", f"CASE WHEN {pct('n', 't')} < 75 THEN 'HIGH' WHEN {pct('n', 't')} < 90 THEN 'MEDIUM' ELSE 'PASS' END", "ChargeId", "n", "t", charge_ids="c", transaction_ids="d"),
))
def txn_match_rate(spark, folder) -> DataFrame:
    return report(cross.transaction_match_rate(b.charges(spark, folder, org=False), b.transactions(spark, folder), BILLING), "charge_ids", "transaction_ids")


_BALANCE = f"""{b.CHARGES}, {b.TRANSACTIONS}, s AS (SELECT ChargeId, sum(paid + adjusted) AS moved FROM transactions GROUP BY 1),
 bal AS (SELECT ChargeId, coalesce(charged, 0) AS charged, coalesce(moved, 0) AS settled, coalesce(charged, 0) + coalesce(moved, 0) AS open FROM charges LEFT JOIN s USING (ChargeId)),
 m AS (SELECT count(*) AS t, count(*) FILTER (abs(open) < 0.01) AS z, CAST(sum(charged) AS DOUBLE) AS c, CAST(sum(open) AS DOUBLE) AS o,
 abs(CAST(sum(open) AS DOUBLE)) / abs(CAST(sum(charged) AS DOUBLE)) * 100 AS r FROM bal)"""


@query("payment_balance", found(
    _BALANCE,
    row("C0b", f"CASE WHEN {pct('z', 't')} < 65 AND r > 15 THEN 'HIGH' WHEN {pct('z', 't')} < 65 OR r > 15 THEN 'MEDIUM' ELSE 'PASS' END", "ChargeAmountOriginal", "z", "t",
        outstanding="o", charged="c", outstanding_rate="r", average_outstanding="o / t"),
))
def payment_balance(spark, folder) -> DataFrame:
    rows = cross.payment_balance(b.charges(spark, folder, org=False), b.transactions(spark, folder), BILLING)
    return report(rows, "outstanding", "charged", "outstanding_rate", "average_outstanding")


@query("charge_balances", f"WITH {_BALANCE} SELECT ChargeId AS charge_id, CAST(charged AS DOUBLE) AS charged, CAST(settled AS DOUBLE) AS settled, CAST(open AS DOUBLE) AS outstanding FROM bal")
def charge_balances(spark, folder) -> DataFrame:
    rows = cross.charge_balances(b.charges(spark, folder, org=False), b.transactions(spark, folder))
    return rows.select("charge_id", *[F.col(c).cast("double").alias(c) for c in ("charged", "settled", "outstanding")])


_ORG = f"""{b.CHARGES}, {b.LEDGER}, refs AS (SELECT DISTINCT CASE WHEN CAST(center AS INTEGER) % 3 = 0 THEN 'z' ELSE '' END || lower(center) AS v FROM ledger
 UNION SELECT DISTINCT CASE WHEN CAST(center AS INTEGER) % 3 = 0 THEN 'z' ELSE '' END || lower(center_name) FROM ledger),
 long AS (SELECT 'BillDepartmentId' AS c, BillDepartmentId AS v, greatest(coalesce(charged, 0), 0) AS a FROM charges UNION ALL SELECT 'BillDepartmentName', BillDepartmentName, greatest(coalesce(charged, 0), 0) FROM charges
 UNION ALL SELECT 'BillLocationName', BillLocationName, greatest(coalesce(charged, 0), 0) FROM charges),
 g AS (SELECT c, lower(v) AS v, min(v) AS shown, count(*) AS n, sum(a) AS a FROM long GROUP BY 1, 2),
 k AS (SELECT *, v IN (SELECT v FROM refs) AS hit FROM g),
 m AS (SELECT c, count(*) FILTER (v <> '') AS t, count(*) FILTER (v <> '' AND NOT hit) AS u, CAST(sum(a) AS DOUBLE) AS d, CAST(coalesce(sum(a) FILTER (v <> '' AND NOT hit), 0) AS DOUBLE) AS ud FROM k GROUP BY 1)"""


def _renamed_ledger(spark, folder) -> DataFrame:
    """The ledger with every third cost center under another number and name."""
    odd = F.col("CostCenterNumberOrig").cast("int") % 3 == 0
    names = ("CostCenterNumberOrig", "CostCenterNameOrig")
    return b.ledger(spark, folder).withColumns({c: F.when(odd, F.concat(F.lit("Z"), c)).otherwise(F.col(c)) for c in names})


@query("org_match_dollars", found(
    _ORG,
    row("C1", "CASE WHEN u = 0 THEN 'PASS' WHEN u > t * 0.2 AND ud / d * 100 > 5 THEN 'HIGH' ELSE 'MEDIUM' END", "(c)", "u", "t", pct("(t - u)", "t"),
        dollars="d", lost_dollars="ud", lost_dollar_pct="ud / d * 100"),
))
def org_match_dollars(spark, folder) -> DataFrame:
    return report(cross.org_match(b.charges(spark, folder), _renamed_ledger(spark, folder), BILLING), "dollars", "lost_dollars", "lost_dollar_pct")


@query("org_unmatched_top", f"WITH {_ORG} SELECT c AS staging_column, shown AS value, n AS rows, CAST(a AS DOUBLE) AS amount FROM k WHERE v <> '' AND NOT hit ORDER BY a DESC, c, shown LIMIT 20")
def org_unmatched_top(spark, folder) -> DataFrame:
    return cross.unmatched_org_values(b.charges(spark, folder), _renamed_ledger(spark, folder), BILLING)


_PROVIDERS = f"""{b.TRANSACTIONS}, {b.PAYROLL}, pn AS (SELECT DISTINCT EmployeeNpi AS id FROM payroll WHERE EmployeeNpi <> ''),
 pm AS (SELECT '' AS scope, text, {sorted_sql('text')} AS m FROM (SELECT DISTINCT lower(EmployeeFullName) AS text FROM payroll)),
 bn AS (SELECT RenderingProviderNpi AS id, lower(min(RenderingProviderFullName)) AS text FROM transactions GROUP BY 1),
 lost AS (SELECT DISTINCT '' AS scope, text, {sorted_sql('text')} AS m FROM bn WHERE id NOT IN (SELECT id FROM pn)), best AS ({best_sql('lost', 'pm', 85)}),
 m AS (SELECT count(*) AS t, count(*) FILTER (id IN (SELECT id FROM pn)) AS n, count(*) FILTER (id NOT IN (SELECT id FROM pn) AND text IN (SELECT text FROM best)) AS s FROM bn)"""


@query("provider_match", found(
    _PROVIDERS,
    row("C2", f"CASE WHEN {pct('(t - n)', 't')} > 30 AND s = 0 THEN 'HIGH' WHEN {pct('(t - n)', 't')} > 10 THEN 'MEDIUM' WHEN s > 0 THEN 'INFO' ELSE 'PASS' END",
        "RenderingProviderNpi", "n", "t", similar="s"),
), stores=True)
def provider_match(spark, folder) -> DataFrame:
    return report(cross.provider_match(b.transactions(spark, folder), b.payroll(spark, folder), BILLING), "similar")


_BY_NAME = f"""{b.TRANSACTIONS}, {b.PAYROLL}, pm AS (SELECT '' AS scope, text, {sorted_sql('text')} AS m FROM (SELECT DISTINCT lower(replace(EmployeeFullName, 'Supplier#0000000', 'Supplier ')) AS text FROM payroll)),
 bn AS (SELECT DISTINCT lower(RenderingProviderFullName) AS text FROM transactions),
 lost AS (SELECT '' AS scope, text, {sorted_sql('text')} AS m FROM bn WHERE text NOT IN (SELECT text FROM pm)), best AS ({best_sql('lost', 'pm', 80)}),
 m AS (SELECT count(*) AS t, count(*) FILTER (text IN (SELECT text FROM pm)) AS n, count(*) FILTER (text IN (SELECT text FROM best)) AS s FROM bn)"""


@query("provider_match_by_name", found(
    _BY_NAME,
    row("C2", f"CASE WHEN {pct('(t - n)', 't')} > 50 AND s = 0 THEN 'HIGH' WHEN t > n THEN 'MEDIUM' ELSE 'PASS' END", "RenderingProviderFullName", "n", "t", similar="s"),
), stores=True)
def provider_match_by_name(spark, folder) -> DataFrame:
    pay = b.payroll(spark, folder).withColumn("EmployeeFullName", F.replace("EmployeeFullName", F.lit("Supplier#0000000"), F.lit("Supplier ")))
    return report(cross.provider_match(b.transactions(spark, folder), pay, BILLING, by_npi=False), "similar")


_PAID = "-CAST(l_extendedprice AS DECIMAL(14,2))"


@query("top_providers", f"""WITH {b.TRANSACTIONS}, {b.PAYROLL}, t2 AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '1') AS npi,
 'Supplier ' || l_suppkey || CASE WHEN l_tax = 0.08 THEN ' Jr' ELSE '' END AS name, CAST(l_extendedprice AS DECIMAL(14,2)) AS a FROM lineitem),
 p AS (SELECT npi, name, sum(a) AS a, count(*) AS n FROM t2 GROUP BY 1, 2), x AS (SELECT npi, sum(a) AS a, arg_min(name, (-n, name)) AS name FROM p GROUP BY 1 ORDER BY a DESC, npi LIMIT 20)
 SELECT npi, name, CAST(a AS DOUBLE) AS charge_amount, npi IN (SELECT EmployeeNpi FROM payroll WHERE EmployeeNpi <> '') AS matched FROM x""")
def top_providers(spark, folder) -> DataFrame:
    billed = b.transactions(spark, folder).withColumn(
        "ChargeAmountOriginal", b.text(-(F.col("PaymentOriginal").cast("decimal(20,4)") + F.col("AdjustmentOriginal").cast("decimal(20,4)")))
    )
    return cross.top_providers(billed, b.payroll(spark, folder), BILLING)


def _overlap_sql(a: str, c: str) -> str:
    return (f"a AS ({a}), c AS ({c}), m AS (SELECT (SELECT count(*) FROM a) AS l, (SELECT count(*) FROM c) AS r, (SELECT count(*) FROM a JOIN c USING (id)) AS s)")


def _coverage_row(check: str, column: str, high: int, medium: int, fine: str = "'PASS'") -> str:
    low = f"least({pct('s', 'l')}, {pct('s', 'r')})"
    return row(check, f"CASE WHEN {low} < {high} THEN 'HIGH' WHEN {low} < {medium} THEN 'MEDIUM' ELSE {fine} END", column, "s", "l", other_keys="r", other_coverage=pct("s", "r"))


@query("npi_coverage", found(
    f"{b.TRANSACTIONS}, {b.SCHEDULING}, " + _overlap_sql("SELECT DISTINCT RenderingProviderNpi AS id FROM transactions", "SELECT DISTINCT ApptProvNPI AS id FROM scheduling"),
    _coverage_row("C3b", "RenderingProviderNpi", 50, 80),
))
def npi_coverage(spark, folder) -> DataFrame:
    return report(cross.npi_coverage(b.transactions(spark, folder), b.scheduling(spark, folder), BILLING), "other_keys", "other_coverage")


@query("patient_coverage", found(
    _overlap_sql("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events"),
    _coverage_row("C3c", "PatientId", 30, 65, "'INFO'"),
))
def patient_coverage(spark, folder) -> DataFrame:
    return report(cross.patient_coverage(b.charges(spark, folder, org=False), b.scheduling(spark, folder), BILLING), "other_keys", "other_coverage")


_FORMS = """m AS (SELECT (SELECT bool_and(regexp_full_match({ours}, '[0-9]+')) FROM orders) AS a, (SELECT bool_and(regexp_full_match(lpad(CAST(user_id AS VARCHAR), 6, '0'), '[0-9]+')) FROM events) AS c)"""
_FORM_ROW = row("S5", "CASE WHEN a <> c THEN 'HIGH' ELSE 'INFO' END", "PatientId", numbers_in_billing="CAST(a AS INTEGER)", numbers_in_scheduling="CAST(c AS INTEGER)")


@query("patient_id_forms", found(_FORMS.format(ours="CAST(o_custkey AS VARCHAR)"), _FORM_ROW))
def patient_id_forms(spark, folder) -> DataFrame:
    rows = cross.patient_id_forms(b.charges(spark, folder, org=False), b.scheduling(spark, folder), BILLING)
    return report(rows, "numbers_in_billing", "numbers_in_scheduling")


@query("patient_id_forms_differ", found(_FORMS.format(ours="'P-' || o_custkey"), _FORM_ROW))
def patient_id_forms_differ(spark, folder) -> DataFrame:
    named = b.charges(spark, folder, org=False).withColumn("PatientId", F.concat(F.lit("P-"), "PatientId"))
    return report(cross.patient_id_forms(named, b.scheduling(spark, folder), BILLING), "numbers_in_billing", "numbers_in_scheduling")


@query("key_overlap", """WITH a AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1), j AS (SELECT a.n AS l, c.n AS r FROM a FULL JOIN c USING (id))
 SELECT count(l) AS left_keys, count(r) AS right_keys, count(*) FILTER (l > 0 AND r > 0) AS shared_keys, CAST(sum(l) AS BIGINT) AS left_rows, CAST(sum(l) FILTER (r > 0) AS BIGINT) AS left_rows_matched,
 CAST(sum(r) AS BIGINT) AS right_rows, CAST(sum(r) FILTER (l > 0) AS BIGINT) AS right_rows_matched FROM j""")
def key_overlap(spark, folder) -> DataFrame:
    found_keys = keys.presence(b.table(spark, folder, "orders"), "o_custkey", b.table(spark, folder, "events"), "user_id")
    return keys.overlap(found_keys).select("left_keys", "right_keys", "shared_keys", "left_rows", "left_rows_matched", "right_rows", "right_rows_matched")


@query("provider_candidates", f"WITH {_BY_NAME} SELECT text AS id, text, best, score, n AS rows FROM best JOIN (SELECT lower(RenderingProviderFullName) AS text, count(*) AS n FROM transactions GROUP BY 1) USING (text)", stores=True)
def provider_candidates(spark, folder) -> DataFrame:
    pay = b.payroll(spark, folder).withColumn("EmployeeFullName", F.replace("EmployeeFullName", F.lit("Supplier#0000000"), F.lit("Supplier ")))
    return cross.provider_candidates(b.transactions(spark, folder), pay, BILLING, by_npi=False)


# Places.

def _place_sql(left: str, right: str, check: str, column: str, high: int) -> str:
    return found(
        f"""v AS (SELECT DISTINCT '' AS scope, text, {sorted_sql('text')} AS m FROM ({left}) WHERE text <> ''), g AS (SELECT DISTINCT '' AS scope, text, {sorted_sql('text')} AS m FROM ({right}) WHERE text <> ''),
 lost AS (SELECT * FROM v WHERE text NOT IN (SELECT text FROM g)), best AS ({best_sql('lost', 'g', 80)}),
 m AS (SELECT count(*) AS t, count(*) FILTER (text IN (SELECT text FROM g)) AS n, count(*) FILTER (text IN (SELECT text FROM best)) AS s FROM v)""",
        row(check, f"CASE WHEN {pct('(t - n - s)', 't')} > {high} THEN 'HIGH' WHEN t > n THEN 'MEDIUM' ELSE 'PASS' END", column, "n", "t", similar="s"),
    )


@query("billing_places", _place_sql(f"SELECT {_TYPO} AS text FROM part", "SELECT p_name AS text FROM part UNION SELECT lower(p_brand) FROM part", "C3a", "BillLocationName", 50), stores=True)
def billing_places(spark, folder) -> DataFrame:
    part = b.table(spark, folder, "part")
    billing = part.select(_typo().alias("BillLocationName"))
    sched = part.select(F.col("p_name").alias("BillLocNameOrig"), F.col("p_brand").alias("DeptNameOrig"))
    return report(cross.billing_scheduling_places(billing, sched, BILLING), "similar")


@query("scheduling_places", f"WITH {b.SCHEDULING}, {b.LEDGER}, " + _place_sql(
    "SELECT lower(BillLocNameOrig) AS text FROM scheduling", "SELECT lower(center) AS text FROM ledger UNION SELECT lower(center_name) FROM ledger", "C5", "BillLocNameOrig", 30,
).replace("WITH ", "", 1), stores=True)
def scheduling_places(spark, folder) -> DataFrame:
    return report(cross.scheduling_ledger_places(b.scheduling(spark, folder), b.ledger(spark, folder), Context("scheduling")), "similar")


# Departments.  The ids hide the supplier's nation behind a prefix and a suffix.

_DEPT = """d AS (SELECT CASE WHEN s_acctbal < 0 THEN 'TEMP' || s_suppkey ELSE '88' || lpad(CAST(10000 + s_nationkey AS VARCHAR), 5, '0') || '000' END AS dept, count(*) AS n
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), c AS (SELECT DISTINCT CAST(10000 + n_nationkey AS VARCHAR) AS k FROM nation),
 x AS (SELECT dept, n, substr(dept, 3, 5) IN (SELECT k FROM c) AS hit FROM d)"""


def _departments(spark, folder) -> tuple[DataFrame, DataFrame]:
    line = b.table(spark, folder, "lineitem").join(b.table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    code = F.concat(F.lit("88"), F.lpad(b.text(F.col("s_nationkey") + 10000), 5, "0"), F.lit("000"))
    pay = line.select(F.when(F.col("s_acctbal") < 0, F.concat(F.lit("TEMP"), b.text("s_suppkey"))).otherwise(code).alias("DepartmentId"))
    gl = b.table(spark, folder, "nation").select(b.text(F.col("n_nationkey") + 10000).alias("CostCenterNumberOrig"), F.col("n_name").alias("CostCenterNameOrig"))
    return pay, gl


@query("dept_offset_match", f"WITH {_DEPT} SELECT dept, n AS rows, hit AS matched, CAST(2 AS BIGINT) AS start, CAST(5 AS BIGINT) AS size FROM x")
def dept_offset_match(spark, folder) -> DataFrame:
    return cross.department_match(*_departments(spark, folder)).select(
        "dept", "rows", "matched", F.col("start").cast("bigint").alias("start"), F.col("size").cast("bigint").alias("size")
    )


@query("dept_unmatched_top", f"WITH {_DEPT} SELECT dept, '' AS name, n AS rows FROM x WHERE NOT hit ORDER BY n DESC, dept LIMIT 20")
def dept_unmatched_top(spark, folder) -> DataFrame:
    return cross.unmatched_departments(*_departments(spark, folder))


@query("dept_match", found(
    f"{_DEPT}, m AS (SELECT count(*) AS t, count(*) FILTER (hit) AS n, count(*) FILTER (NOT hit AND n > 100) AS big FROM x)",
    row("C4", "CASE WHEN big > 0 THEN 'HIGH' WHEN n < t THEN 'MEDIUM' ELSE 'PASS' END", "DepartmentId", "n", "t", large_unmatched="big", offset_start="2", offset_size="5"),
))
def dept_match(spark, folder) -> DataFrame:
    return report(cross.payroll_ledger_departments(*_departments(spark, folder), Context("payroll")), "large_unmatched", "offset_start", "offset_size")


# Reconciliation against a second set of figures.

_THEIR_RVU = "CASE WHEN l_tax < 0.08 OR s_acctbal > 0 THEN l_quantity ELSE l_quantity * 0.5 END"


@query("wrvu_recon", f"""WITH a AS (SELECT CAST(l_suppkey AS VARCHAR) AS k, sum(CAST(l_quantity AS DECIMAL(20,4))) AS x FROM lineitem GROUP BY 1),
 e AS (SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'X' ELSE '' END || l_suppkey AS k, sum(CAST({_THEIR_RVU} AS DECIMAL(20,4))) AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
 j AS (SELECT coalesce(a.k, e.k) AS npi, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN e ON a.k = e.k)
 SELECT npi, CAST(x AS DOUBLE) AS ours, CAST(y AS DOUBLE) AS theirs, CAST(x - y AS DOUBLE) AS difference, CAST(least(x, y) AS DOUBLE) / CAST(greatest(x, y) AS DOUBLE) * 100 AS agreement_pct,
 CAST(least(x, y) AS DOUBLE) / CAST(greatest(x, y) AS DOUBLE) * 100 > 98 AS reconciled FROM j""")
def wrvu_recon(spark, folder) -> DataFrame:
    """The second set has half the value on some lines and every tenth provider under another id."""
    line = b.table(spark, folder, "lineitem")
    supplier = b.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    ours = line.select(b.text("l_suppkey").alias("npi"), b.text("l_quantity").alias("wrvu"))
    prefix = F.when(F.col("l_suppkey") % 10 == 0, "X").otherwise("")
    theirs = line.join(supplier, "l_suppkey").select(F.concat(prefix, b.text("l_suppkey")).alias("npi"), b.text(F.expr(_THEIR_RVU)).alias("expected"))
    return cross.reconciliation(ours, theirs, ["npi"], "wrvu", "expected")


@query("gl_recon", f"""WITH {b.LEDGER}, a AS (SELECT center, account, sum(amount) AS x FROM ledger GROUP BY 1, 2),
 e AS (SELECT center, CASE WHEN ym < 201106 THEN '' ELSE 'LATE-' END || account AS account, sum(amount) AS y FROM ledger GROUP BY 1, 2),
 j AS (SELECT center, account, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN e USING (center, account))
 SELECT center AS CostCenterNumberOrig, account AS AcctNumber, CAST(x AS DOUBLE) AS ours, CAST(y AS DOUBLE) AS theirs, CAST(x - y AS DOUBLE) AS difference,
 CAST(least(abs(x), abs(y)) AS DOUBLE) / NULLIF(CAST(greatest(abs(x), abs(y)) AS DOUBLE), 0) * 100 AS agreement_pct,
 coalesce(CAST(least(abs(x), abs(y)) AS DOUBLE) / NULLIF(CAST(greatest(abs(x), abs(y)) AS DOUBLE), 0) * 100 > 98, false) AS reconciled FROM j""")
def gl_recon(spark, folder) -> DataFrame:
    """The second set books the later months on other accounts."""
    rows = b.ledger(spark, folder)
    late = F.when(F.col("YearMonth") < "201106", "").otherwise("LATE-")
    theirs = rows.withColumn("AcctNumber", F.concat(late, "AcctNumber")).withColumnRenamed("AmountOrig", "Expected")
    return cross.reconciliation(rows, theirs, ["CostCenterNumberOrig", "AcctNumber"], "AmountOrig", "Expected")


# The values that findings name.

@query("department_samples", f"""WITH {_DEPT} SELECT 'C4' AS check_id, 'DepartmentId' AS staging_column, CAST(row_number() OVER (ORDER BY n DESC, dept) - 1 AS INTEGER) AS place,
 dept AS value, n FROM x WHERE NOT hit ORDER BY n DESC, dept LIMIT 20""")
def department_samples(spark, folder) -> DataFrame:
    return sample_rows(cross.payroll_ledger_departments(*_departments(spark, folder), Context("payroll")))


@query("organisation_samples", f"""WITH {_ORG} SELECT * FROM (SELECT 'C1' AS check_id, c AS staging_column, CAST(row_number() OVER (PARTITION BY c ORDER BY CAST(a AS DOUBLE) DESC, shown) - 1 AS INTEGER) AS place,
 shown AS value, n FROM k WHERE v <> '' AND NOT hit) WHERE place < 20""")
def organisation_samples(spark, folder) -> DataFrame:
    return sample_rows(cross.org_match(b.charges(spark, folder), _renamed_ledger(spark, folder), BILLING))


@query("place_samples", f"""WITH v AS (SELECT text, count(*) AS n, min(shown) AS shown FROM (SELECT {_TYPO} AS text, {_TYPO} AS shown FROM part) GROUP BY 1),
 v2 AS (SELECT '' AS scope, text, {sorted_sql('text')} AS m FROM v), g AS (SELECT DISTINCT '' AS scope, text, {sorted_sql('text')} AS m FROM (SELECT p_name AS text FROM part UNION SELECT lower(p_brand) FROM part)),
 lost AS (SELECT * FROM v2 WHERE text NOT IN (SELECT text FROM g)), best AS ({best_sql('lost', 'g', 80)}),
 j AS (SELECT concat_ws(' ~ ', shown, best) AS value, n FROM v LEFT JOIN best ON v.text = best.text WHERE v.text NOT IN (SELECT text FROM g))
 SELECT * FROM (SELECT 'C3a' AS check_id, 'BillLocationName' AS staging_column, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS INTEGER) AS place, value, n FROM j) WHERE place < 20""", stores=True)
def place_samples(spark, folder) -> DataFrame:
    part = b.table(spark, folder, "part")
    billing = part.select(_typo().alias("BillLocationName"))
    sched = part.select(F.col("p_name").alias("BillLocNameOrig"), F.col("p_brand").alias("DeptNameOrig"))
    return sample_rows(cross.billing_scheduling_places(billing, sched, BILLING))
