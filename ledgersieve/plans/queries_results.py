"""Issues and verdicts, roll-ups, star-schema load."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..checks.conformance import compatibility
from ..context import Context
from ..findings import SCHEMA
from ..operators import issues as iss, rollups, star
from . import bindings as b
from .queries_cross import composite_sql
from .registered import query

# Findings bound to events: the user is the client, the event type the source, the value picks the check.

_EVENT_SOURCE = {"signup": "billing_charges", "error": "scheduling", "click": "payroll", "view": "gl", "purchase": "quality"}
_EVENT_GROUP = {k: rules.SOURCE_GROUP[v] for k, v in _EVENT_SOURCE.items()}


def _findings(spark, folder) -> DataFrame:
    v, h = F.col("value"), F.hour("ts")
    k = F.get_json_object("props", "$.k").cast("bigint")
    phase = F.when(v < 15, 2).when(v < 70, 3).otherwise(4)
    check = F.when(v < 5, "schema_missing").when(v < 15, "datatype").when(v < 40, "null_blank").when(v < 70, "placeholder_data").otherwise("C1")
    strong = F.when(h < 4, "CRITICAL").when(h < 8, "HIGH").when(h < 12, "MEDIUM").when(h < 16, "LOW").when(h < 20, "INFO")
    column = F.concat(F.lit("Col"), F.floor(k / 10).cast("string"))
    rows = b.table(spark, folder, "events").select(
        F.concat(F.lit("client_"), b.text("user_id")).alias("client"), F.when(k < 50, "v1").otherwise("v2").alias("round"),
        F.col("event_type").alias("file"), b.case("event_type", _EVENT_SOURCE).alias("source"), b.case("event_type", _EVENT_GROUP).alias("source_group"),
        phase.alias("phase"), check.alias("check_id"), F.when(phase == 4, F.coalesce(strong, F.lit("PASS"))).otherwise(strong).alias("severity"),
        column.alias("raw_column"), F.when(phase < 4, column).alias("staging_column"), F.when(v < 5, F.concat(F.lit("Field "), column)).alias("template_field"),
        F.when(k < 30, "required").when(k < 60, "recommended").otherwise("optional").alias("requirement_level"),
        k.alias("affected"), F.lit(100).alias("total"), (v * 3).alias("pct"), F.lit(None).alias("metrics"),
        F.array(F.struct(F.col("event_type").alias("value"), k.alias("count"))).alias("samples"), b.text("event_id").alias("message"),
    )
    return rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in SCHEMA.items()])


_FINDINGS = f"""e AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k, hour(ts) AS h FROM events),
 f AS (SELECT 'client_' || user_id AS client, CASE WHEN k < 50 THEN 'v1' ELSE 'v2' END AS round, event_type AS file, {b.sql_case('event_type', _EVENT_GROUP)} AS grp,
 {b.sql_case('event_type', _EVENT_SOURCE)} AS source, CASE WHEN value < 15 THEN 2 WHEN value < 70 THEN 3 ELSE 4 END AS phase,
 CASE WHEN value < 5 THEN 'schema_missing' WHEN value < 15 THEN 'datatype' WHEN value < 40 THEN 'null_blank' WHEN value < 70 THEN 'placeholder_data' ELSE 'C1' END AS chk,
 CASE WHEN h < 4 THEN 'CRITICAL' WHEN h < 8 THEN 'HIGH' WHEN h < 12 THEN 'MEDIUM' WHEN h < 16 THEN 'LOW' WHEN h < 20 THEN 'INFO' WHEN value >= 70 THEN 'PASS' END AS sev0,
 'Col' || (k // 10) AS col0, CASE WHEN value < 70 THEN col0 END AS stg, CASE WHEN value < 5 THEN 'Field ' || col0 END AS fld,
 CASE WHEN k < 30 THEN 'required' WHEN k < 60 THEN 'recommended' ELSE 'optional' END AS lvl, k AS affected, value * 3 AS p, CAST(event_id AS VARCHAR) AS msg, event_type FROM e),
 i AS (SELECT * EXCLUDE (grp), CASE WHEN phase = 4 THEN 'cross_source' ELSE grp END AS grp, CASE WHEN phase = 4 AND sev0 = 'PASS' THEN 'INFO' ELSE sev0 END AS severity,
 list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO', 'PASS'], CASE WHEN phase = 4 AND sev0 = 'PASS' THEN 'INFO' ELSE sev0 END) AS rnk,
 CASE WHEN chk = 'schema_missing' THEN 'All' WHEN phase = 4 THEN 'N/A' WHEN chk = 'null_blank' AND p >= 99 THEN 'All' ELSE CAST(affected AS VARCHAR) END AS affected_rows,
 CASE WHEN phase = 4 THEN 'cross' ELSE grp END || '|' || chk || '|' || coalesce(stg, fld, col0) AS dedupe_key FROM f WHERE sev0 IS NOT NULL),
 n AS (SELECT *, {b.sql_case('grp', rules.ISSUE_PREFIX)} AS prefix, row_number() OVER (PARTITION BY client, round, {b.sql_case('grp', rules.ISSUE_PREFIX)}
 ORDER BY phase, file, chk, stg NULLS FIRST, fld NULLS FIRST, rnk, msg) AS num FROM i),
 iss AS (SELECT *, prefix || '-' || CASE WHEN num < 1000 THEN lpad(CAST(num AS VARCHAR), 3, '0') ELSE CAST(num AS VARCHAR) END AS id FROM n),
 w AS (SELECT *, bool_or(phase = 2 AND chk = 'schema_missing') OVER g AS hs, bool_or(phase = 2 AND chk = 'datatype') OVER g AS hd,
 max(CASE WHEN stg IS NOT NULL AND phase = 3 AND chk = 'null_blank' AND p >= 99 THEN affected END) OVER g AS blanks FROM iss WINDOW g AS (PARTITION BY client, round, grp, stg)),
 dd AS (SELECT *, coalesce(stg IS NOT NULL AND phase = 3 AND chk = 'null_blank' AND ((p >= 99 AND hs) OR hd), false) AS dup,
 CASE WHEN stg IS NOT NULL AND chk = 'schema_missing' THEN coalesce(blanks, affected) ELSE affected END AS affected2 FROM w),
 cl AS (SELECT *, CASE WHEN grp = 'cross_source' THEN 'Billing <-> GL' ELSE {b.sql_case('grp', rules.GROUP_DISPLAY)} END AS display,
 CASE WHEN chk = 'schema_missing' AND lvl IN ('required', 'recommended') THEN 'Missing ' || lvl || ' field ''' || fld || '''' WHEN chk = 'schema_missing' THEN 'Missing field ''' || fld || '''' ELSE msg END AS descr,
 CASE WHEN grp = 'cross_source' THEN '' ELSE coalesce(fld, col0) END AS field, CASE severity WHEN 'CRITICAL' THEN 'MUST FIX' WHEN 'HIGH' THEN 'SHOULD FIX' ELSE 'REVIEW' END AS priority
 FROM dd WHERE NOT dup AND severity <> 'PASS' AND NOT (grp = 'cross_source' AND severity = 'INFO'))"""


def _marked(spark, folder) -> DataFrame:
    return iss.deduplicate(iss.issues(_findings(spark, folder)))


@query("issue_union", f"WITH {_FINDINGS} SELECT client, round, id, grp AS source_group, chk AS check_id, severity, affected_rows, dedupe_key FROM iss")
def issue_union(spark, folder) -> DataFrame:
    rows = iss.issues(_findings(spark, folder))
    return rows.select("client", "round", "id", "source_group", "check_id", "severity", "affected_rows", "dedupe_key")


@query("issue_dedup", f"WITH {_FINDINGS} SELECT client, round, id, dup AS deduplicated, affected2 AS affected FROM dd")
def issue_dedup(spark, folder) -> DataFrame:
    return _marked(spark, folder).select("client", "round", "id", "deduplicated", "affected")


@query("client_issues", f"WITH {_FINDINGS} SELECT client, round, id, severity, grp AS source, display AS source_display, field, descr AS description, priority FROM cl")
def client_issues(spark, folder) -> DataFrame:
    return iss.client_issues(_marked(spark, folder)).select(
        "client", "round", "id", "severity", "source", "source_display", "field", "description", "priority"
    )


@query("issue_filter", f"WITH {_FINDINGS} SELECT client, round, id, descr AS description FROM cl WHERE severity = 'HIGH' AND display = 'GL' AND (contains(descr, '7') OR contains(lower(id), '7') OR contains(lower(display), '7'))")
def issue_filter(spark, folder) -> DataFrame:
    rows = iss.filter_issues(iss.client_issues(_marked(spark, folder)), "HIGH", "GL", "7")
    return rows.select("client", "round", "id", "description")


@query("feedback_groups", f"WITH {_FINDINGS} SELECT client, round, display AS source_display, array_to_string(list(descr ORDER BY id, descr), '; ') AS descriptions FROM cl WHERE severity = 'CRITICAL' GROUP BY ALL")
def feedback_groups(spark, folder) -> DataFrame:
    rows = iss.feedback(iss.client_issues(_marked(spark, folder)))
    return rows.withColumn("descriptions", F.array_join("descriptions", "; "))


@query("findings_sheet", f"WITH {_FINDINGS} SELECT client, round, id, file, stg AS staging_column, lvl AS requirement_level, event_type || ' (' || affected || 'x)' AS example_values FROM cl")
def findings_sheet(spark, folder) -> DataFrame:
    marked = _marked(spark, folder)
    return iss.findings_sheet(iss.client_issues(marked), marked).select("client", "round", "id", "file", "staging_column", "requirement_level", "example_values")


_SEV_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))


@query("source_verdicts", f"""WITH {_FINDINGS}, s AS (SELECT client, round, grp AS source_group, {_SEV_COUNTS} FROM dd WHERE NOT dup GROUP BY ALL)
 SELECT *, critical + high + medium + low AS total, CASE WHEN critical > 0 THEN 'FAIL' WHEN high > 0 THEN 'CONDITIONAL' ELSE 'PASS' END AS status FROM s""")
def source_verdicts(spark, folder) -> DataFrame:
    return iss.source_verdicts(_marked(spark, folder))


@query("verdicts_with_total", f"WITH {_FINDINGS} SELECT client, round, grp AS source_group, {_SEV_COUNTS} FROM dd WHERE NOT dup GROUP BY GROUPING SETS ((client, round, grp), (client, round))")
def verdicts_with_total(spark, folder) -> DataFrame:
    return iss.verdicts_with_total(_marked(spark, folder))


def _missing(findings: DataFrame) -> DataFrame:
    """A source counts as sent if any phase-2 finding names it."""
    return iss.missing_sources(findings.select("client", "round").distinct(), findings.where("phase = 2").select("client", "round", "source"))


_MISSING = """sub AS (SELECT DISTINCT client, round FROM f), got AS (SELECT DISTINCT client, round, grp FROM f WHERE phase = 2),
 mi AS (SELECT client, round, g AS source_group FROM sub, (VALUES ('billing'), ('scheduling'), ('payroll'), ('gl'), ('quality')) v(g) WHERE NOT EXISTS (
 SELECT 1 FROM got WHERE got.client = sub.client AND got.round = sub.round AND got.grp = v.g))"""


@query("missing_sources", f"WITH {_FINDINGS}, {_MISSING} SELECT * FROM mi")
def missing_sources(spark, folder) -> DataFrame:
    return _missing(_findings(spark, folder))


_READY = f"""{_MISSING}, t AS (SELECT client, round, {_SEV_COUNTS} FROM dd WHERE NOT dup GROUP BY ALL), ab AS (SELECT client, round, string_agg(source_group, ', ' ORDER BY source_group) AS missing_sources FROM mi GROUP BY ALL),
 rd AS (SELECT client, round, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(info, 0) AS info, missing_sources FROM t FULL JOIN ab USING (client, round)),
 ready AS (SELECT *, CASE WHEN critical > 0 OR missing_sources IS NOT NULL THEN 'Needs Revision (Round ' || CASE round WHEN 'v1' THEN 'v2' ELSE 'v3' END || ')' WHEN high > 0 THEN 'Conditionally Ready' ELSE 'Ready for Historical Extract' END AS overall,
 CASE WHEN critical > 0 OR missing_sources IS NOT NULL THEN concat_ws('; ', CASE WHEN critical > 0 THEN critical || ' CRITICAL issue(s)' END, CASE WHEN missing_sources IS NOT NULL THEN 'missing source(s): ' || missing_sources END)
 WHEN high > 0 THEN high || ' HIGH issue(s) are open' ELSE 'nothing CRITICAL or HIGH is open' END AS reason FROM rd)"""


@query("readiness", f"WITH {_FINDINGS}, {_READY} SELECT * FROM ready")
def readiness(spark, folder) -> DataFrame:
    rows = _findings(spark, folder)
    return iss.readiness(_marked(spark, folder), _missing(rows))


@query("client_summary", f"""WITH {_FINDINGS}, {_READY}, l AS (SELECT client, max(round) AS round FROM ready GROUP BY 1),
 sh AS (SELECT client, round, string_agg(DISTINCT {b.sql_case('source', rules.SOURCE_GROUP)}, ', ' ORDER BY {b.sql_case('source', rules.SOURCE_GROUP)}) AS sources FROM f GROUP BY ALL)
 SELECT client, round, overall, critical, high, medium, low, sources FROM ready JOIN l USING (client, round) LEFT JOIN sh USING (client, round)""")
def client_summary(spark, folder) -> DataFrame:
    rows = _findings(spark, folder)
    return iss.client_summary(iss.readiness(_marked(spark, folder), _missing(rows)), rows.select("client", "round", "source"))


_SENT = " ".join(f"WHEN '{g}' THEN '{d}'" for g, d in rules.GROUP_DISPLAY.items())
_REMINDERS = ", ".join("('" + r.replace("'", "''") + "')" for r in rules.REMINDERS)


@query("checklist", f"""WITH {_FINDINGS}, {_MISSING}, todo AS (SELECT client, round, priority, grp AS source, display AS source_display, CASE
 WHEN phase = 2 AND chk = 'schema_missing' THEN display || ': deliver a column ''' || field || ''' (' || CASE severity WHEN 'CRITICAL' THEN 'required' ELSE 'recommended' END || ')'
 WHEN phase = 3 AND chk = 'null_blank' THEN display || ': fill ''' || field || ''' on every row'
 WHEN phase = 4 THEN 'Between sources: ' || descr ELSE display || ', ''' || field || ''': ' || descr END AS item, id AS finding_id FROM cl WHERE severity IN ('CRITICAL', 'HIGH'))
 SELECT * FROM todo UNION ALL SELECT client, round, 'MUST FIX', source_group, CASE source_group {_SENT} END, CASE source_group {_SENT} END || ': no file yet, send one of the month of the others', '' FROM mi
 UNION ALL SELECT client, round, 'REMINDER', 'general', 'General', r, '' FROM (SELECT client, round FROM cl UNION SELECT client, round FROM mi), (VALUES {_REMINDERS}) v(r)""")
def checklist(spark, folder) -> DataFrame:
    rows = iss.checklist(iss.client_issues(_marked(spark, folder)), _missing(_findings(spark, folder)))
    return rows.withColumn("finding_id", F.array_join("finding_ids", ",")).drop("finding_ids")


@query("round_diff", f"""WITH {_FINDINGS}, bf AS (SELECT client, dedupe_key, min(rnk) AS r FROM iss WHERE round = 'v1' GROUP BY ALL), af AS (SELECT client, dedupe_key, min(rnk) AS r FROM iss WHERE round = 'v2' GROUP BY ALL)
 SELECT coalesce(bf.client, af.client) AS client, coalesce(bf.dedupe_key, af.dedupe_key) AS dedupe_key, CASE WHEN bf.r IS NULL THEN 'new' WHEN af.r IS NULL THEN 'resolved' ELSE 'persistent' END AS status,
 ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO', 'PASS'][bf.r] AS severity_before, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO', 'PASS'][af.r] AS severity_after
 FROM bf FULL JOIN af ON bf.client = af.client AND bf.dedupe_key = af.dedupe_key""")
def round_diff(spark, folder) -> DataFrame:
    rows = iss.issues(_findings(spark, folder))
    return iss.round_difference(rows.where("round = 'v1'"), rows.where("round = 'v2'"))


@query("cross_summary", f"""WITH {_FINDINGS}, x AS (SELECT client, round, chk AS check_id, arg_min(severity, id) AS severity, arg_min(msg, id) AS message FROM dd WHERE grp = 'cross_source' GROUP BY ALL)
 SELECT *, CASE WHEN severity IN ('INFO', 'PASS') THEN 'PASS' WHEN severity = 'HIGH' THEN 'CONDITIONAL' WHEN severity = 'CRITICAL' THEN 'FAIL' ELSE 'REVIEW' END AS status FROM x""")
def cross_summary(spark, folder) -> DataFrame:
    return iss.cross_summary(_marked(spark, folder))


@query("cross_passed", f"WITH {_FINDINGS} SELECT client, round, count(DISTINCT chk) AS checks_run, count(*) FILTER (sev0 = 'HIGH') AS high, count(*) FILTER (sev0 = 'HIGH') = 0 AS passed FROM f WHERE phase = 4 GROUP BY ALL")
def cross_passed(spark, folder) -> DataFrame:
    return iss.cross_passed(_findings(spark, folder))


@query("file_severities", f"WITH {_FINDINGS} SELECT client, round, file, " + ", ".join(
    f'count(*) FILTER (sev0 = \'{s}\') AS "{s}"' for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "PASS")) + " FROM f GROUP BY ALL")
def file_severities(spark, folder) -> DataFrame:
    return iss.file_severities(_findings(spark, folder))


@query("compatibility", f"""WITH {_FINDINGS}, c AS (SELECT file, source, count(*) FILTER (sev0 = 'CRITICAL') AS critical, count(*) FILTER (sev0 = 'HIGH') AS high, count(*) FILTER (sev0 = 'MEDIUM') AS medium
 FROM f WHERE phase = 2 GROUP BY ALL) SELECT *, CASE WHEN critical > 0 THEN 'NO' WHEN high > 0 THEN 'YES*' ELSE 'YES' END AS compatible FROM c""")
def compatibility_verdict(spark, folder) -> DataFrame:
    return compatibility(_findings(spark, folder))


# Roll-ups.

def _tables(spark, folder) -> tuple[dict[str, DataFrame], dict[str, Context]]:
    tables = {
        "billing_charges": b.charges(spark, folder), "billing_transactions": b.centered_transactions(spark, folder),
        "scheduling": b.scheduling(spark, folder), "payroll": b.payroll(spark, folder), "gl": b.ledger(spark, folder), "quality": b.quality(spark, folder),
    }
    return tables, {s: Context(s) for s in tables}


_ZERO = {m: "0" for m in rollups.COST_CENTER_MEASURES}


def _part(names: str, source: str, **measures: str) -> str:
    cells = ", ".join(f"CAST({(_ZERO | measures)[m]} AS DECIMAL(30,4)) AS {m}" for m in rollups.COST_CENTER_MEASURES)
    return f"SELECT {names}, {cells} FROM {source}"


_CENTER_PARTS = " UNION ALL ".join([
    _part("BillDepartmentId AS id, NULL AS gl, nullif(BillDepartmentName, '') AS bill, NULL AS pay, NULL AS pl", "charges", Charges="coalesce(charged, 0)"),
    _part("dept, NULL, NULL, NULL, NULL", "centered", Payment="paid", Adjustments="adjusted"),
    _part("center, center_name, NULL, NULL, NULL", "ledger", GL_ProviderPayAmount="CASE WHEN category = 'Provider Compensation' THEN amount ELSE 0 END",
          GL_SupportStaffAmount="CASE WHEN category = 'Support Staff Compensation' THEN amount ELSE 0 END",
          GL_MedicalPracticeCharges="CASE WHEN category = 'Charges' THEN amount ELSE 0 END",
          GL_MedicalPracticeAdjustments="CASE WHEN category = 'Adjustments' THEN amount ELSE 0 END"),
    _part("DepartmentId, NULL, NULL, DepartmentName, NULL", "payroll", ProviderHours="CASE WHEN job_class = 'Physician' THEN hours ELSE 0 END",
          ProviderAmount="CASE WHEN job_class = 'Physician' THEN amount ELSE 0 END", SupportStaffHours="CASE WHEN job_class = 'RN' THEN hours ELSE 0 END",
          SupportStaffAmount="CASE WHEN job_class = 'RN' THEN amount ELSE 0 END"),
    _part("coalesce(gn.id, 'SCH:' || BillLocNameOrig), NULL, NULL, NULL, CASE WHEN gn.id IS NULL THEN BillLocNameOrig END",
          "(SELECT * FROM scheduling WHERE ApptStatus = 'completed' AND BillLocNameOrig <> '') sc LEFT JOIN gn ON gn.name = sc.BillLocNameOrig", CompletedAppointments="1"),
    _part("np.id, NULL, NULL, NULL, NULL", "quality JOIN np ON np.npi = quality.npi", QualityRecordCount="1"),
])


@query("cost_center_rollup", f"""WITH {b.CHARGES}, {b.CENTERED}, {b.SCHEDULING}, {b.PAYROLL}, {b.LEDGER}, {b.QUALITY},
 gn AS (SELECT name, min(id) AS id FROM (SELECT center AS id, min(center_name) AS name FROM ledger GROUP BY 1) GROUP BY 1),
 np AS (SELECT RenderingProviderNpi AS npi, min(BillDepartmentId) AS id FROM charges WHERE BillDepartmentId <> '' AND length(RenderingProviderNpi) = 10 GROUP BY 1),
 u AS ({_CENTER_PARTS}) SELECT id AS CostCenterNumber, coalesce(min(gl), min(bill), min(pay), min(pl), '') AS CostCenterName, """
       + ", ".join(f"CAST(sum({m}) AS DOUBLE) AS {m}" for m in rollups.COST_CENTER_MEASURES) + " FROM u WHERE id <> '' GROUP BY id", stores=True)
def cost_center_rollup(spark, folder) -> DataFrame:
    return rollups.cost_centers(*_tables(spark, folder))


_PZERO = {m: "0" for m in rollups.PROVIDER_MEASURES}


def _ppart(names: str, source: str, **measures: str) -> str:
    cells = ", ".join(f"CAST({(_PZERO | measures)[m]} AS DECIMAL(30,4)) AS {m}" for m in rollups.PROVIDER_MEASURES)
    return f"SELECT {names}, {cells} FROM {source}"


_PROVIDER_PARTS = " UNION ALL ".join([
    _ppart("RenderingProviderNpi AS id, RenderingProviderFullName AS n1, NULL AS n3, NULL AS n4", "charges", Charges="coalesce(charged, 0)"),
    _ppart("npi, NULL, NULL, NULL", "centered", Payment="paid", Adjustments="adjusted"),
    _ppart("ApptProvNPI, NULL, NULL, NULL", "scheduling WHERE ApptStatus = 'completed'", CompletedAppointments="1"),
    _ppart("EmployeeNpi, NULL, EmployeeFullName, NULL", "payroll WHERE job_class = 'Physician' AND EmployeeNpi <> ''", PayrollHours="hours", PayrollAmount="amount"),
    _ppart("npi, NULL, NULL, 'Author ' || CAST(CAST(ltrim(npi, '') AS BIGINT) AS VARCHAR)", "quality", QualityRecordCount="1"),
])


@query("provider_rollup", f"""WITH {b.CHARGES}, {b.CENTERED}, {b.SCHEDULING}, {b.PAYROLL}, {b.QUALITY.replace("lpad(CAST(doc_id AS VARCHAR), 10, '1') AS npi,", "lpad(CAST(doc_id AS VARCHAR), 10, '1') AS npi, 'Author ' || doc_id AS author,")},
 u AS ({_PROVIDER_PARTS.replace("'Author ' || CAST(CAST(ltrim(npi, '') AS BIGINT) AS VARCHAR)", "author")})
 SELECT id AS ProviderNPI, coalesce(min(n1), min(n3), min(n4), '') AS ProviderName, """
       + ", ".join(f"CAST(sum({m}) AS DOUBLE) AS {m}" for m in rollups.PROVIDER_MEASURES) + " FROM u WHERE regexp_matches(id, '^\\d{10}$') GROUP BY id")
def provider_rollup(spark, folder) -> DataFrame:
    return rollups.providers(*_tables(spark, folder))


# Places whose names carry a slip of the pen, on the center whose name is most like theirs.

_SLIP = """CASE WHEN k % 5 = 0 THEN replace(name, 'N', 'M') WHEN k % 5 = 1 THEN lower(name) || ' clinic' WHEN k % 5 = 2 THEN substr(name, 2)
 WHEN k % 5 = 3 THEN 'Out Station ' || k ELSE replace(name, ' ', '-') END"""
_SLIPPED = f"""slipped AS (SELECT {_SLIP} AS place FROM (SELECT CAST(props->>'$.k' AS INTEGER) AS k, (CAST(props->>'$.k' AS INTEGER) % 25) AS n, event_type FROM events) e
 JOIN (SELECT n_nationkey, n_name AS name FROM nation) ON n = n_nationkey WHERE event_type = 'purchase')"""


@query("places_on_centers", f"""WITH {_SLIPPED}, t AS (SELECT text, trim(lower(regexp_replace(text, '[^a-zA-Z0-9]', ' ', 'g'))) AS m FROM (SELECT DISTINCT place AS text FROM slipped)),
 centers AS (SELECT n_name AS text, min(CAST(n_nationkey AS VARCHAR)) AS id, trim(lower(regexp_replace(n_name, '[^a-zA-Z0-9]', ' ', 'g'))) AS m FROM nation GROUP BY 1),
 {composite_sql('t', 'centers')}, best AS (SELECT l, r FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS o FROM scored WHERE score >= 80) WHERE o = 1)
 SELECT coalesce(centers.id, 'SCH:' || place) AS id, CASE WHEN centers.id IS NULL THEN place END AS place, count(*) AS CompletedAppointments
 FROM slipped LEFT JOIN best ON l = place LEFT JOIN centers ON centers.text = r GROUP BY slipped.place, centers.id""", stores=True)
def places_on_centers(spark, folder) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    nation = b.table(spark, folder, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"))
    events = b.table(spark, folder, "events").where("event_type = 'purchase'").select(k.alias("k"), (k % 25).alias("n"))
    visits = events.join(nation, "n").select(F.expr(_SLIP).alias("BillLocNameOrig"), F.lit("completed").alias("ApptStatus"))
    centers = nation.select(F.col("n").cast("string").alias("id"), F.col("name").alias("gl_name"))
    return rollups.appointment_places(visits, centers)


# Star schema.

_PATIENT = star.Dimension("Patient", "PatUnbr", {"row": {"PatIdOrig": star.col("PatientId"), "PatCity": star.col("PatientCity")}})


def _patients(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Customers seen before (positive balance), and the rows of the new load."""
    customer = b.table(spark, folder, "customer")
    rows = customer.select(b.text("c_custkey").alias("PatientId"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("PatientCity"))
    old = star.insert_new(None, star.members(rows.where(customer["c_acctbal"] > 5000), _PATIENT), _PATIENT)
    return old, rows


_SEEN = "SELECT CAST(c_custkey AS VARCHAR) AS PatIdOrig, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE 'zzNull' END AS PatCity FROM customer"


@query("dim_insert_new", f"{_SEEN} WHERE c_acctbal <= 5000")
def dim_insert_new(spark, folder) -> DataFrame:
    old, rows = _patients(spark, folder)
    return star.insert_new(old, star.members(rows, _PATIENT), _PATIENT).select("PatIdOrig", "PatCity")


@query("dim_keys", "SELECT count(*) AS members, count(*) AS keys, CAST(1 AS BIGINT) AS first_key, count(*) AS last_key FROM customer")
def dim_keys(spark, folder) -> DataFrame:
    old, rows = _patients(spark, folder)
    after = star.upsert(old, star.members(rows, _PATIENT), _PATIENT)
    return after.agg(
        F.count("*").alias("members"), F.count_distinct("PatUnbr").alias("keys"), F.min("PatUnbr").alias("first_key"), F.max("PatUnbr").alias("last_key")
    )


@query("dim_dates", """SELECT CAST(d AS VARCHAR) AS date, CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month, strftime(d, '%Y%m') AS year_month FROM (
 SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE -2 END FROM orders)""")
def dim_dates(spark, folder) -> DataFrame:
    spec = next(d for d in star.CHARGES.dimensions if d.name == "Date")
    rows = star.insert_new(None, star.members(b.charges(spark, folder, org=False), spec), spec)
    return rows.select(F.col("date").cast("string").alias("date"), F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"), "year_month")


@query("dim_pay_codes", f"WITH {b.PAYROLL} SELECT DISTINCT 'zzNull_' || EarningsCode AS PayCodeOrig, 'job: ' || EarningsCodeDesc AS PayCodeDesc FROM payroll")
def dim_pay_codes(spark, folder) -> DataFrame:
    spec = next(d for d in star.PAYROLL.dimensions if d.name == "PayCode")
    rows = b.payroll(spark, folder).withColumn("JobCodeDesc", F.lit("job"))
    return star.members(rows, spec)


@query("fact_build", f"""WITH {b.LEDGER} SELECT center, account, CAST(ym AS VARCHAR) AS ym, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount FROM ledger GROUP BY ALL""", stores=True)
def fact_build(spark, folder) -> DataFrame:
    rows = b.ledger(spark, folder)
    members, fact = star.load_fact(rows, star.LEDGER)
    dims = {d.name: star.dimension_table(members, d) for d in star.LEDGER.dimensions}
    sums = fact.groupBy("CostCenterFnbr", "AcctFnbr", "ReportPeriodFnbr").agg(F.count("*").alias("rows"), F.sum("AmountOrig").alias("amount"))
    named = (
        sums.join(dims["CostCenter"], F.col("CostCenterFnbr") == F.col("CostCenterUnbr"))
        .join(dims["Account"], F.col("AcctFnbr") == F.col("AcctUnbr"))
        .join(dims["ReportPeriod"], F.col("ReportPeriodFnbr") == F.col("ReportPeriodUnbr"))
    )
    return named.groupBy(F.col("CostCenterNumberOrig").alias("center"), F.col("AcctNumber").alias("account"), F.col("YearMonth").alias("ym")).agg(
        F.sum("rows").alias("rows"), F.sum("amount").cast("double").alias("amount")
    )


def _fact_totals(rows: DataFrame, fact: star.Fact, measure: str) -> DataFrame:
    _, built = star.load_fact(rows, fact)
    linked = F.lit(True)
    for fk in fact.links:
        linked = linked & F.col(fk).isNotNull()
    return built.agg(F.count("*").alias("rows"), F.count_if(linked).alias("linked"), F.sum(measure).cast("double").alias("amount"))


@query("fact_charges", f"WITH {b.CHARGES} SELECT count(*) AS rows, count(*) AS linked, CAST(sum(charged) AS DOUBLE) AS amount FROM charges", stores=True)
def fact_charges(spark, folder) -> DataFrame:
    return _fact_totals(b.charges(spark, folder), star.CHARGES, "ChargeAmtOrig")


@query("fact_payroll", f"WITH {b.PAYROLL} SELECT count(*) AS rows, count(*) AS linked, CAST(sum(amount) AS DOUBLE) AS amount FROM payroll", stores=True)
def fact_payroll(spark, folder) -> DataFrame:
    return _fact_totals(b.payroll(spark, folder), star.PAYROLL, "AmountOrig")


@query("fact_transactions", "SELECT count(*) AS rows, count(*) AS linked, CAST(sum(CAST(-(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(14,2))) AS DOUBLE) AS amount FROM lineitem", stores=True)
def fact_transactions(spark, folder) -> DataFrame:
    rows = b.transactions(spark, folder).withColumn("DateOfService", F.col("PostDate"))
    return _fact_totals(rows, star.TRANSACTIONS, "PaymentOrig")


@query("fact_appointments", f"WITH {b.SCHEDULING} SELECT ApptStatus, count(*) AS rows, count(DISTINCT ApptProvNPI) AS providers FROM scheduling GROUP BY 1", stores=True)
def fact_appointments(spark, folder) -> DataFrame:
    rows = b.scheduling(spark, folder)
    _, fact = star.load_fact(rows, star.SCHEDULING)
    return fact.groupBy("ApptStatus").agg(F.count("*").alias("rows"), F.count_distinct("SchdProvFnbr").alias("providers"))


@query("load_log", "SELECT CAST(7 AS BIGINT) AS SourceFnbr, 'ledger.txt' AS FileName, 'Load' AS EventDesc, count(*) AS RowsAffected FROM lineitem", stores=True)
def load_log(spark, folder) -> DataFrame:
    rows = b.ledger(spark, folder)
    _, fact = star.load_fact(rows, star.LEDGER, source_id=7)
    return star.load_log(fact, 7, "ledger.txt").withColumn("SourceFnbr", F.col("SourceFnbr").cast("bigint"))


@query("calculated_columns", "SELECT c_custkey AS id, c_name AS PatientId, split_part(c_name, '#', 2) AS PatientId_Calculated FROM customer")
def calculated_columns(spark, folder) -> DataFrame:
    rows = b.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("PatientId"))
    return star.calculated_columns(rows, [("PatientId", "SPLIT_PART(x, '#', 2)")])
