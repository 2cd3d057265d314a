"""Source checks: billing, scheduling, payroll, ledger, quality, surveys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..checks import billing, ledger, payroll, quality, scheduling
from ..checks.registry import run_checks
from ..context import Context, TransactionTypes
from ..findings import report, sample_rows
from ..operators import frequency, keys, quantiles
from . import bindings as b
from .registered import found, over, pct, query, row, when

BILLING = Context("billing_charges")
TYPES = TransactionTypes(
    frozenset({"Charge"}), frozenset({"1-urgent", "2-high"}), frozenset({"Adjustment", "Void"}), frozenset({"3-medium"}),
)


def _run(df: DataFrame, ctx: Context, ids: list[str], *metrics: str) -> DataFrame:
    return report(run_checks(df, ctx, ids), *metrics)


# Billing.

_MIX = f"""t AS (SELECT {b.sql_case('l_returnflag', {'R': 'Void', 'A': 'Adjustment', 'N': 'Charge'})} AS v FROM lineitem WHERE l_linestatus = 'F'
 UNION ALL SELECT CASE WHEN l_tax >= 0.07 THEN 'Misc' ELSE 'PMT' END FROM lineitem WHERE l_linestatus <> 'F')"""


def _types(spark, folder) -> DataFrame:
    named = b.case("l_returnflag", {"R": "Void", "A": "Adjustment", "N": "Charge"})
    other = F.when(F.col("l_tax") >= 0.07, "Misc").otherwise("PMT")
    return b.table(spark, folder, "lineitem").select(F.when(F.col("l_linestatus") == "F", named).otherwise(other).alias("TransactionType"))


@query("txn_type_values", f"""WITH {_MIX} SELECT v AS value, count(*) AS n, CASE WHEN v = 'Charge' THEN 'charge' WHEN v IN ('Void', 'Adjustment', 'PMT') THEN 'other' END AS kind
 FROM t GROUP BY ALL""")
def txn_type_values(spark, folder) -> DataFrame:
    return billing.transaction_kinds(_types(spark, folder), Context("billing_combined"))


@query("txn_type_mix", found(
    f"{_MIX}, m AS (SELECT count(*) FILTER (v = 'Misc') AS u, count(*) AS n, count(DISTINCT v) FILTER (v = 'Misc') AS uv FROM t)",
    row("B1", over(pct("u", "n"), (5, "HIGH"), above_zero="MEDIUM"), "TransactionType", "u", "n", unknown_values="uv"),
))
def txn_type_mix(spark, folder) -> DataFrame:
    return _run(_types(spark, folder), Context("billing_combined"), ["B1"], "unknown_values")


@query("void_units", found(
    f"{b.TRANSACTIONS}, m AS (SELECT count(*) FILTER (TransactionType = 'Void' AND units > 0) AS v, "
    "count(*) FILTER (TransactionType <> 'Void' AND units < 0) AS n, count(*) AS t FROM transactions)",
    row("B10", when("v > 0", "MEDIUM"), "Units", "v", "t"), row("B10", when("n > 0", "MEDIUM"), "Units", "n", "t"),
))
def void_units(spark, folder) -> DataFrame:
    return _run(b.transactions(spark, folder), Context("billing_transactions"), ["B10"])


_LINK = f"""{b.TRANSACTIONS}, c AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders), x AS (SELECT DISTINCT ChargeId AS id FROM transactions),
 m AS (SELECT (SELECT count(*) FROM c) AS ck, (SELECT count(*) FROM x) AS xk, (SELECT count(*) FROM x ANTI JOIN c USING (id)) AS orphan,
 (SELECT count(*) FROM c ANTI JOIN x USING (id)) AS open)"""


@query("charge_txn_linkage", found(
    _LINK,
    row("B2", over(pct("orphan", "xk"), (20, "HIGH"), otherwise="INFO"), "ChargeId", "orphan", "xk", charge_ids="ck", unmatched_charges="open", unmatched_charge_pct=pct("open", "ck")),
    row("B2", over(pct("open", "ck"), (50, "MEDIUM")), "ChargeId", "open", "ck", charge_ids="NULL", unmatched_charges="NULL", unmatched_charge_pct="NULL"),
))
def charge_txn_linkage(spark, folder) -> DataFrame:
    charges = b.charges(spark, folder, org=False)
    return report(
        billing.charge_transaction_linkage(charges, b.transactions(spark, folder), BILLING), "charge_ids", "unmatched_charges", "unmatched_charge_pct"
    )


@query("rate_population", found(
    f"{b.TRANSACTIONS}, m AS (SELECT count(*) AS t, count(*) FILTER (rvu = 0) AS z FROM transactions WHERE CAST(CptCode AS INTEGER) BETWEEN 10000 AND 69999)",
    row("B3", over(pct("z", "t"), (10, "HIGH"), above_zero="MEDIUM"), "WorkRvuOriginal", "z", "t"),
    row("B3", when("t > 0", "INFO"), "WorkRvuOriginal", "t - z", "t"),
))
def rate_population(spark, folder) -> DataFrame:
    return _run(b.transactions(spark, folder), Context("billing_transactions"), ["B3"])


@query("amount_sanity", found(
    f"{b.CHARGES}, m AS (SELECT count(*) AS t, count(*) FILTER (charged IS NULL OR charged = 0) AS z, count(*) FILTER (charged > 100000) AS x FROM charges)",
    row("B4", over(pct("z", "t"), (5, "HIGH")), "ChargeAmountOriginal", "z", "t"), row("B4", when("x > 0", "INFO"), "ChargeAmountOriginal", "x", "t"),
))
def amount_sanity(spark, folder) -> DataFrame:
    return _run(b.charges(spark, folder, org=False), BILLING, ["B4"])


@query("combined_charge_scope", found(
    f"""m AS (SELECT count(*) FILTER (s) AS t, count(*) FILTER (s AND o_totalprice > 100000) AS x FROM (SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH') AS s FROM orders))""",
    row("B4", when("x > 0", "INFO"), "ChargeAmountOriginal", "x", "t"),
))
def combined_charge_scope(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("TransactionTypeDesc"), b.text(b.cents("o_totalprice")).alias("ChargeAmountOriginal")
    )
    return _run(df, Context("billing_combined", types=TYPES), ["B4"])


@query("top_share", """WITH c AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT count(*) AS d, sum(n) AS f FROM c)
 SELECT CAST(d AS BIGINT) AS distinct_values, CAST(f AS BIGINT) AS filled, v AS top_value, n AS top_rows, CAST(n AS DOUBLE) / f * 100 AS top_pct
 FROM c, t ORDER BY n DESC, v LIMIT 1""")
def top_share(spark, folder) -> DataFrame:
    return billing.top_share(b.table(spark, folder, "customer"), "c_mktsegment")


@query("rendering_npi", found(
    f"""{b.TRANSACTIONS}, c AS (SELECT RenderingProviderNpi AS v, count(*) AS n, count(DISTINCT RenderingProviderFullName) AS names FROM transactions GROUP BY 1),
 m AS (SELECT count(*) AS d, max(n) AS top, sum(n) AS f, count(*) FILTER (names > 1) AS several FROM c)""",
    row("B5", over(pct("top", "f"), (50, "MEDIUM")), "RenderingProviderNpi", "top", "f"),
    row("B5", when("d > 0", "INFO"), "RenderingProviderNpi", "d"),
    row("B5", when("several > 0", "MEDIUM"), "RenderingProviderNpi", "several"),
))
def rendering_npi(spark, folder) -> DataFrame:
    return _run(b.transactions(spark, folder), Context("billing_transactions"), ["B5"])


@query("name_per_key", "SELECT l_suppkey AS id, min(n) AS first, max(n) AS last FROM (SELECT l_suppkey, 'Supplier ' || l_suppkey || CASE WHEN l_tax = 0.08 THEN ' Jr' ELSE '' END AS n FROM lineitem) GROUP BY 1 HAVING min(n) <> max(n)")
def name_per_key(spark, folder) -> DataFrame:
    name = F.concat(F.lit("Supplier "), b.text("l_suppkey"), F.when(F.col("l_tax") == 0.08, " Jr").otherwise(""))
    df = b.table(spark, folder, "lineitem").select(b.text("l_suppkey").alias("key"), name.alias("name"))
    return keys.several_dependents(df, "key", "name").select(F.col("key").cast("bigint").alias("id"), "first", "last")


@query("org_coverage", found(
    f"""{b.CHARGES}, m AS (SELECT *, greatest(di, dn) AS prim, greatest(di, dn, bl) AS best FROM (SELECT count(*) AS t,
 count(*) FILTER (BillDepartmentId <> '') * 1.0::DOUBLE / count(*) * 100 AS di, count(*) FILTER (BillDepartmentName <> '') * 1.0::DOUBLE / count(*) * 100 AS dn,
 count(*) FILTER (BillLocationName <> '') * 1.0::DOUBLE / count(*) * 100 AS bl FROM charges))""",
    row("B6", "CASE WHEN prim < 50 AND best < 90 THEN 'CRITICAL' WHEN prim < 90 THEN 'HIGH' ELSE 'INFO' END", None, None, "t", "prim",
        BillDepartmentId="di", BillDepartmentName="dn", BillLocationName="bl"),
))
def org_coverage(spark, folder) -> DataFrame:
    return _run(b.charges(spark, folder), BILLING, ["B6"], "BillDepartmentId", "BillDepartmentName", "BillLocationName")


@query("code_separation", found(
    """m AS (SELECT count(*) AS t, count(*) FILTER (p_type = 'PROMO') AS e, count(*) FILTER (p_size > 40) AS m3, count(*) FILTER (p_type = 'SMALL') AS cc,
 count(*) FILTER (p_type = 'LARGE') AS old FROM part)""",
    row("B7", when("e > 0", "MEDIUM"), "CptCode", "e", "t"), row("B7", when("m3 > 0", "MEDIUM"), "Modifier2", "m3", "t"),
    row("B8", when("cc > 0", "HIGH"), "PrimaryIcdCode", "cc", "t"), row("B8", when("old > 0", "MEDIUM"), "PrimaryIcdCode", "old", "t"),
))
def code_separation(spark, folder) -> DataFrame:
    kind = F.col("p_type")
    df = b.table(spark, folder, "part").select(
        F.concat(b.text(99200 + F.col("p_size")), F.when(kind == "PROMO", "-25").otherwise("")).alias("CptCode"),
        F.lit("25").alias("Modifier1"), F.when(F.col("p_size") > 40, "25,59").otherwise("").alias("Modifier2"),
        F.when(kind == "SMALL", "E11.9;I10").when(kind == "LARGE", "250.01").otherwise("E11.9").alias("PrimaryIcdCode"),
    )
    return _run(df, BILLING, ["B7", "B8"])


_PAYERS = {"BUILDING": "Blue Cross PPO", "MACHINERY": "Medicare B", "FURNITURE": "Self Pay", "AUTOMOBILE": "Tricare West", "HOUSEHOLD": "Barter"}
_PAYER_CLASS = {"BUILDING": "Commercial/Managed Care", "MACHINERY": "Medicare", "FURNITURE": "Self-Pay", "AUTOMOBILE": "Other Government"}


def _payers(spark, folder) -> DataFrame:
    return b.table(spark, folder, "customer").select(b.case("c_mktsegment", _PAYERS).alias("ChargePayerFinancialClass"))


@query("class_buckets", f"""SELECT {b.sql_case('c_mktsegment', _PAYERS)} AS value, count(*) AS n, {b.sql_case('c_mktsegment', _PAYER_CLASS)} AS label
 FROM customer GROUP BY ALL""")
def class_buckets(spark, folder) -> DataFrame:
    return frequency.classified(_payers(spark, folder), "ChargePayerFinancialClass", rules.PAYER_CLASSES)


@query("payer_classes", found(
    "m AS (SELECT count(DISTINCT c_mktsegment) AS d, count(DISTINCT c_mktsegment) FILTER (c_mktsegment = 'HOUSEHOLD') AS u FROM customer)",
    row("B9", over(pct("u", "d"), (10, "MEDIUM"), otherwise="INFO"), "ChargePayerFinancialClass", "u", "d"),
))
def payer_classes(spark, folder) -> DataFrame:
    return _run(_payers(spark, folder), BILLING, ["B9"])


_FORMAT_SQL = """f AS (SELECT count(*) AS t, count(*) FILTER (regexp_matches(v, '^\\d+$')) AS dig, bool_and(regexp_matches(v, '^\\d+$')) AS alld,
 bool_or(regexp_matches(v, '^0\\d+')) AS lz, median(length(v)) AS med, min(length(v)) = max(length(v)) AS cons FROM ({src}) WHERE v <> '')"""


@query("id_format", found(
    _FORMAT_SQL.format(src="SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS v FROM customer"),
    row("B12", when("NOT alld AND dig * 1.0 / t < 0.9", "MEDIUM"), "PatientId", "t - dig", "t", source="f", leading_zeros="NULL", median_length="NULL", length_consistent="NULL"),
    row("B12", when("t > 0", "INFO"), "PatientId", None, "t", source="f", leading_zeros="lz::INT", median_length="med", length_consistent="cons::INT"),
))
def id_format(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "customer").select(
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(F.lpad(b.text("c_custkey"), 8, "0")).alias("PatientId")
    )
    return _run(df, BILLING, ["B12"], "leading_zeros", "median_length", "length_consistent")


@query("id_shape_facts", _FORMAT_SQL.replace("f AS (", "WITH f AS (").format(src="SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS v FROM events")
       + " SELECT t AS filled, dig AS digit_rows, CASE WHEN alld THEN 'numeric_' || CAST(floor(med) AS INTEGER) || 'digit' ELSE 'alphanumeric' END AS format, lz AS leading_zeros FROM f")
def id_shape_facts(spark, folder) -> DataFrame:
    return frequency.shape_facts(b.scheduling(spark, folder), "PatIdOrig").select("filled", "digit_rows", "format", "leading_zeros")


def _procedures(spark, folder) -> tuple[DataFrame, Context]:
    """Lines coded by part; the code set has dear parts under another code, retires promo ones and publishes the part size."""
    df = b.table(spark, folder, "lineitem").select(b.text("l_partkey").alias("CptCode"), b.text(b.cents("l_quantity")).alias("WorkRvuOriginal"))
    ref = b.table(spark, folder, "part").select(
        F.when(F.col("p_retailprice") < 995, b.text("p_partkey")).otherwise(F.concat(F.lit("X"), b.text("p_partkey"))).alias("CptCode"),
        b.text("p_size").alias("WorkRvu"), F.when(F.col("p_type") == "PROMO", "D").otherwise("A").alias("StatusIndicator")
    )
    return df, Context("billing_charges", ref_cpt=ref)


_CODES = """r AS (SELECT CASE WHEN p_retailprice < 995 THEN '' ELSE 'X' END || p_partkey AS k, p_size AS w, p_type = 'PROMO' AS dead FROM part),
 c AS (SELECT CAST(l_partkey AS VARCHAR) AS k, count(*) AS n, median(l_quantity) AS q FROM lineitem GROUP BY 1),
 j AS (SELECT c.*, w, dead, r.k IS NOT NULL AS known, CASE WHEN w > 0 THEN abs(q - w) / w * 100 END AS v FROM c LEFT JOIN r ON c.k = r.k),
 m AS (SELECT count(*) AS codes, count(*) FILTER (NOT known) AS u, count(*) FILTER (dead) AS dead, sum(n) FILTER (dead) AS dead_rows,
 count(*) FILTER (known) AS known, count(*) FILTER (v > 20) AS off FROM j)"""


@query("code_set_check", found(
    _CODES,
    row("B13", over(pct("u", "codes"), (5, "HIGH"), above_zero="MEDIUM", otherwise="INFO"), "CptCode", "u", "codes", rows="NULL"),
    row("B13", when("dead > 0", "MEDIUM"), "CptCode", "dead", rows="dead_rows"),
    row("B13", f"CASE WHEN off > 0 THEN {over(pct('off', 'known'), (10, 'MEDIUM'), otherwise='INFO')} END", "WorkRvuOriginal", "off", "known", rows="NULL"),
))
def code_set_check(spark, folder) -> DataFrame:
    df, ctx = _procedures(spark, folder)
    return _run(df, ctx, ["B13"], "rows")


@query("code_samples", f"""WITH {_CODES} SELECT * FROM (
 SELECT 'B13' AS check_id, 'CptCode' AS staging_column, CAST(row_number() OVER (PARTITION BY dead IS NOT NULL ORDER BY n DESC, k) - 1 AS INTEGER) AS place, k AS value, n
 FROM j WHERE NOT known OR dead) WHERE place < 20""")
def code_samples(spark, folder) -> DataFrame:
    df, ctx = _procedures(spark, folder)
    return sample_rows(run_checks(df, ctx, ["B13"]))


@query("billing_window", found(
    "m AS (SELECT count(*) AS t, count(*) FILTER (CAST(o_orderdate AS DATE) < DATE '1996-05-15' OR CAST(o_orderdate AS DATE) > DATE '1996-06-14') AS o FROM orders)",
    row("B11", over(pct("o", "t"), (10, "HIGH"), above_zero="MEDIUM", otherwise="INFO"), "PostDate", "o", "t"),
))
def billing_window(spark, folder) -> DataFrame:
    return _run(b.charges(spark, folder, org=False), Context("billing_charges", test_month="1996-06"), ["B11"])


@query("unmatched_codes", f"WITH {_CODES} SELECT k AS code, n AS row_count FROM j WHERE NOT known ORDER BY n DESC, k LIMIT 20")
def unmatched_codes(spark, folder) -> DataFrame:
    df, ctx = _procedures(spark, folder)
    return billing.unmatched_codes(df, ctx)


@query("code_value_variance", f"WITH {_CODES} SELECT k AS code, q AS client_rvu, CAST(w AS DOUBLE) AS published_rvu, v AS variance_pct FROM j WHERE known")
def code_value_variance(spark, folder) -> DataFrame:
    df, ctx = _procedures(spark, folder)
    return billing.rvu_variance(df, ctx).select("code", "client_rvu", "published_rvu", "variance_pct")


@query("median_per_key", "SELECT l_suppkey AS id, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def median_per_key(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_extendedprice").alias("v"))
    return quantiles.medians(df, ["id"], "v")


def _places(spark, folder) -> tuple[DataFrame, Context]:
    df = b.table(spark, folder, "customer").select(b.text("c_nationkey").alias("PlaceOfServiceCode"), b.case("c_mktsegment", {"BUILDING": "other"}, "").alias("PlaceOfServiceDesc"))
    ref = b.table(spark, folder, "nation").select(
        b.text(F.when(F.col("n_regionkey") < 4, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + 60)).alias("PosCode"),
        F.col("n_name").alias("PosName"), F.when(F.col("n_regionkey") == 1, "2020-01-01").otherwise("").alias("TerminatedDate"),
    )
    return df, Context("billing_charges", ref_pos=ref)


_POS = """c AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS k, count(*) AS n FROM customer WHERE c_nationkey <> 0 GROUP BY 1),
 r AS (SELECT lpad(CAST(CASE WHEN n_regionkey < 4 THEN n_nationkey ELSE n_nationkey + 60 END AS VARCHAR), 2, '0') AS k, n_name AS name FROM nation),
 j AS (SELECT c.*, name, r.k IS NOT NULL AS known FROM c LEFT JOIN r ON c.k = r.k),
 m AS (SELECT count(*) AS codes, count(*) FILTER (NOT known) AS bc, coalesce(sum(n) FILTER (NOT known), 0) AS br, sum(n) AS f,
 coalesce(sum(n) FILTER (k = '21'), 0) AS inp, count(*) FILTER (k = '11') AS office, (SELECT count(*) FROM customer) AS t FROM j)"""


@query("pos_samples", f"""WITH {_POS} SELECT * FROM (SELECT 'B14' AS check_id, 'PlaceOfServiceCode' AS staging_column,
 CAST(row_number() OVER (ORDER BY n DESC, k) - 1 AS INTEGER) AS place, k AS value, n FROM j) WHERE place < 15""")
def pos_samples(spark, folder) -> DataFrame:
    df, ctx = _places(spark, folder)
    return sample_rows(run_checks(df, ctx, ["B14"]))


@query("pos_check", found(
    _POS,
    row("B14", over(pct("br", "t"), (5, "HIGH"), above_zero="MEDIUM", otherwise="INFO"), "PlaceOfServiceCode", "br", "t", bad_codes="bc"),
    row("B14", over(pct("inp", "f"), (30, "MEDIUM")), "PlaceOfServiceCode", "inp", "f", bad_codes="NULL"),
    row("B14", when("office = 0", "MEDIUM"), "PlaceOfServiceCode", bad_codes="NULL"),
    row("B14", when("codes > 0", "INFO"), "PlaceOfServiceCode", "codes", bad_codes="NULL"),
))
def pos_check(spark, folder) -> DataFrame:
    df, ctx = _places(spark, folder)
    return _run(df, ctx, ["B14"], "bad_codes")


@query("pos_distribution", f"""WITH {_POS} SELECT k AS code, n AS row_count, CAST(n AS DOUBLE) / (SELECT f FROM m) * 100 AS row_pct,
 coalesce(name, '(not in code set)') AS name FROM j ORDER BY n DESC, k LIMIT 15""")
def pos_distribution(spark, folder) -> DataFrame:
    return billing.place_distribution(*_places(spark, folder))


@query("pos_retired", """SELECT CAST(coalesce(sum(1) FILTER (n_regionkey = 1), 0) AS BIGINT) AS terminated_rows, count(*) FILTER (c_mktsegment = 'BUILDING') AS mismatched_rows,
 count(*) AS known_rows FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 4""")
def pos_retired(spark, folder) -> DataFrame:
    df, ctx = _places(spark, folder)
    return billing.retired_places(df, ctx.ref_pos)


@query("billing_variants", found(
    f"{b.CHARGES}, m AS (SELECT count(*) AS t, count(*) FILTER (posted < served) AS e, count(*) FILTER (PatientGender <> '') AS g FROM charges)",
    row("post_before_service", when("e > 0", "MEDIUM"), "PostDate", "e", "t"),
    row("gender_domain", when("g > 0", "MEDIUM"), "PatientGender", "g", "t"),
))
def billing_variants(spark, folder) -> DataFrame:
    return _run(b.charges(spark, folder, org=False), BILLING, ["B.dates", "B.domains"])


# Scheduling.

SCHED = Context("scheduling", test_month="2024-01")
_STATUS_LABEL = {"Scheduled": "Scheduled", "No Show": "No Show", "Arrived": "Completed", "Canceled by patient": "Cancelled", "completed": "Completed"}


@query("status_values", f"WITH {b.SCHEDULING} SELECT ApptStatus AS value, count(*) AS n, {b.sql_case('ApptStatus', _STATUS_LABEL)} AS label FROM scheduling GROUP BY ALL")
def status_values(spark, folder) -> DataFrame:
    return scheduling.status_values(b.scheduling(spark, folder))


@query("status_mapping", found(
    "m AS (SELECT count(*) AS t, count(*) FILTER (event_type = 'error' AND value > 50) AS u FROM events)",
    row("S1", over(pct("u", "t"), (10, "HIGH"), above_zero="MEDIUM", otherwise="INFO"), "ApptStatus", "u", "t"),
))
def status_mapping(spark, folder) -> DataFrame:
    odd = (F.col("event_type") == "error") & (F.col("value") > 50)
    df = b.table(spark, folder, "events").select(F.when(odd, "XQ").otherwise(b.case("event_type", b.EVENT_STATUS)).alias("ApptStatus"))
    return _run(df, SCHED, ["S1"])


@query("cancel_completeness", found(
    f"""{b.SCHEDULING}, m AS (SELECT count(*) AS t, count(*) FILTER (gone) AS g, count(*) FILTER (gone AND CancellationDate = '') AS nd,
 count(*) FILTER (NOT gone AND CancellationDate <> '') AS sd, count(*) FILTER (gone AND CancelReason = '') AS nr FROM scheduling)""",
    row("S2", over(pct("nd", "g"), (20, "HIGH"), above_zero="MEDIUM"), "CancellationDate", "nd", "g"),
    row("S2", when("sd > 0", "MEDIUM"), "CancellationDate", "sd", "t - g"),
    row("S2", over(pct("nr", "g"), (20, "MEDIUM")), "CancelReason", "nr", "g"),
))
def cancel_completeness(spark, folder) -> DataFrame:
    return _run(b.scheduling(spark, folder), SCHED, ["S2"])


@query("duration_logic", found(
    f"""{b.SCHEDULING}, m AS (SELECT count(*) FILTER (done) AS d, count(*) FILTER (done AND minutes = 0) AS z, count(*) FILTER (done AND minutes > 480) AS l,
 count(*) FILTER (done AND minutes < 5) AS s FROM scheduling)""",
    row("S3", when("z > 0", "MEDIUM"), "ApptSchdLength", "z", "d"), row("S3", when("l > 0", "INFO"), "ApptSchdLength", "l", "d"),
    row("short_duration", when("s > 0", "INFO"), "ApptSchdLength", "s", "d"),
))
def duration_logic(spark, folder) -> DataFrame:
    return _run(b.scheduling(spark, folder), SCHED, ["S3"])


@query("checkin_order", found(
    f"{b.SCHEDULING}, m AS (SELECT count(*) AS t, count(*) FILTER (stay_hours < 0) AS r, count(*) FILTER (stay_hours > 12) AS l FROM scheduling)",
    row("S4", when("r > 0", "MEDIUM"), "CheckOutDate", "r", "t"), row("S4", when("l > 0", "INFO"), "CheckOutDate", "l", "t"),
))
def checkin_order(spark, folder) -> DataFrame:
    return _run(b.scheduling(spark, folder), SCHED, ["S4"])


@query("scheduling_ids", found(
    f"""{b.SCHEDULING}, p AS (SELECT ApptProvNPI AS v, count(*) AS n FROM scheduling GROUP BY 1), m AS (SELECT count(*) AS t, count(DISTINCT PatIdOrig) AS ids,
 (SELECT count(*) FROM p) AS provs, (SELECT max(n) FROM p) AS top, count(DISTINCT BillLocNameOrig) FILTER (BillLocNameOrig <> '') AS places,
 count(*) FILTER (BillLocNameOrig <> '') AS named FROM scheduling)""",
    row("S5", when("t > 0", "INFO"), "PatIdOrig", None, "t"),
    row("S6", when("provs > 0", "INFO"), "ApptProvNPI", "provs", "t", pct("top", "t")),
    row("S6", "'INFO'", "BillLocNameOrig", "places", "named", "0.0"),
))
def scheduling_ids(spark, folder) -> DataFrame:
    return _run(b.scheduling(spark, folder), SCHED, ["S5", "S6"])


@query("month_window", found(
    f"""{b.SCHEDULING}, m AS (SELECT count(*) AS t, count(*) FILTER (CAST(appt AS DATE) NOT BETWEEN DATE '2024-02-01' AND DATE '2024-02-29') AS o,
 count(*) FILTER (created > appt) AS l FROM scheduling)""",
    row("S7", over(pct("o", "t"), (5, "HIGH"), above_zero="MEDIUM", otherwise="INFO"), "ApptDate", "o", "t"),
    row("S7", over(pct("l", "t"), (5, "MEDIUM")), "CreateDate", "l", "t"),
))
def month_window(spark, folder) -> DataFrame:
    return _run(b.scheduling(spark, folder), Context("scheduling", test_month="2024-02"), ["S7"])


_LABELS = f"""{b.SCHEDULING}, c AS (SELECT {b.sql_case('ApptStatus', _STATUS_LABEL)} AS label, count(*) AS n FROM scheduling GROUP BY 1)"""


@query("status_distribution", f"WITH {_LABELS} SELECT * FROM c")
def status_distribution(spark, folder) -> DataFrame:
    return scheduling.status_distribution(b.scheduling(spark, folder)).select("label", "n")


@query("status_mix", found(
    f"""{_LABELS}, m AS (SELECT sum(n) AS t, coalesce(sum(n) FILTER (label IN ('Completed', 'Checked In')), 0) AS d, count(*) AS k,
 coalesce(sum(n) FILTER (label IN ('Cancelled', 'Rescheduled')), 0) AS g, coalesce(sum(n) FILTER (label = 'No Show'), 0) AS ns,
 max(n) AS top, arg_max(label, n) AS tl FROM c)""",
    row("S8", when("tl NOT IN ('Completed', 'Checked In') AND top > d", "HIGH"), "ApptStatus", "top", "t"),
    row("S8", when("g = 0", "HIGH"), "ApptStatus"), row("S8", when("ns = 0", "MEDIUM"), "ApptStatus"),
    row("S8", "'INFO'", "ApptStatus", "k", "t", pct("d", "t")),
))
def status_mix(spark, folder) -> DataFrame:
    return _run(b.scheduling(spark, folder), SCHED, ["S8"])


@query("type_mix", found(
    f"""{b.SCHEDULING}, m AS (SELECT count(*) FILTER (ApptType = 'New Patient') AS n, count(*) FILTER (ApptType IN ('Follow-up', 'Return Visit', 'Est Pt')) AS e,
 count(DISTINCT ApptType) AS k FROM scheduling)""",
    row("S9", f"CASE WHEN n = 0 AND e = 0 THEN 'HIGH' WHEN n = 0 OR e = 0 THEN 'MEDIUM' WHEN {pct('n', '(n + e)')} < 5 OR {pct('n', '(n + e)')} > 50 THEN 'MEDIUM' ELSE 'INFO' END",
        "ApptType", "n", "(n + e)"),
    row("S9", "'INFO'", "ApptType", "k"),
))
def type_mix(spark, folder) -> DataFrame:
    return _run(b.scheduling(spark, folder), SCHED, ["S9"])


@query("scheduling_variants", found(
    f"{b.SCHEDULING}, m AS (SELECT count(*) AS t, count(*) FILTER (hr < 5 OR hr >= 23) AS o FROM scheduling)",
    row("off_hours", when("o > 0", "INFO"), "ApptTime", "o", "t"),
))
def scheduling_variants(spark, folder) -> DataFrame:
    return _run(b.scheduling(spark, folder), SCHED, ["S.hours", "S.visit"])


# Payroll.

PAY = Context("payroll")


@query("hours_checks", found(
    f"""{b.PAYROLL}, m AS (SELECT count(*) AS t, count(*) FILTER (hours < 0) AS n, count(*) FILTER (hours < 0 AND EarningsCode <> 'A') AS u,
 count(*) FILTER (hours > 200) AS x, CAST(min(hours) AS DOUBLE) AS lo, CAST(max(hours) AS DOUBLE) AS hi FROM payroll)""",
    row("P1", when("u > 0", "HIGH"), "Hours", "u", "t", least="NULL", most="NULL"), row("P1", when("x > 0", "MEDIUM"), "Hours", "x", "t", least="NULL", most="NULL"),
    row("P1", "'INFO'", "Hours", "n", "t", least="lo", most="hi"),
))
def hours_checks(spark, folder) -> DataFrame:
    return _run(b.payroll(spark, folder), PAY, ["P1"], "least", "most")


def _monthly(spark, folder) -> DataFrame:
    return b.payroll(spark, folder).withColumn("PayPeriodEndDate", F.substring("PayPeriodEndDate", 1, 7))


@query("hours_per_period", found(
    f"""{b.PAYROLL}, g AS (SELECT EmployeeId, strftime(period_end, '%Y-%m') AS p, sum(hours) AS h FROM payroll GROUP BY 1, 2),
 m AS (SELECT count(*) AS t, count(*) FILTER (h > 400) AS x, count(*) FILTER (h = 0) AS z FROM g)""",
    row("P1", when("x > 0", "MEDIUM"), "Hours", "x", "t"), row("period_without_hours", when("z > 0", "INFO"), "Hours", "z", "t"),
))
def hours_per_period(spark, folder) -> DataFrame:
    return _run(_monthly(spark, folder), PAY, ["P1.periods"])


@query("pay_rate", found(
    f"""{b.PAYROLL}, m AS (SELECT count(*) AS t, count(*) FILTER (amount < 0 AND EarningsCode <> 'A') AS u, count(*) FILTER (EarningsCode = 'R' AND hours > 0) AS k,
 count(*) FILTER (EarningsCode = 'R' AND hours > 0 AND amount / hours > 1000) AS hi, count(*) FILTER (EarningsCode = 'R' AND hours > 0 AND amount / hours < 7) AS lo FROM payroll)""",
    row("P2", when("u > 0", "MEDIUM"), "AmountOrig", "u", "t"), row("P2", when("hi > 0", "MEDIUM"), "AmountOrig", "hi", "k"),
    row("P2", when("lo > 0", "INFO"), "AmountOrig", "lo", "k"),
))
def pay_rate(spark, folder) -> DataFrame:
    return _run(b.payroll(spark, folder), PAY, ["P2"])


@query("pay_period_lengths", found(
    f"""{b.PAYROLL}, m AS (SELECT count(*) AS t, count(*) FILTER (early_check) AS e, count(*) FILTER (period_days = 10) AS u, count(DISTINCT period_days) AS k,
 mode(period_days) AS md FROM payroll)""",
    row("P3", when("e > 0", "MEDIUM"), "CheckDate", "e", "t", modal="NULL"),
    row("P3", "CASE WHEN u > t * 0.1 THEN 'MEDIUM' ELSE 'INFO' END", "PayPeriodEndDate", "u", "t", modal="md"),
    row("mixed_cadence", when("k > 1", "INFO"), "PayPeriodEndDate", "k", modal="NULL"),
))
def pay_period_lengths(spark, folder) -> DataFrame:
    return _run(b.payroll(spark, folder), PAY, ["P3", "P3.lengths"], "modal")


@query("dept_concentration", found(
    """d AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1),
 m AS (SELECT (SELECT count(*) FROM customer) AS t, sum(n) AS f, count(*) AS k, count(*) FILTER (n > (SELECT sum(n) FROM d) * 0.3) AS h,
 sum(n) FILTER (n > (SELECT sum(n) FROM d) * 0.3) AS hn FROM d)""",
    row("P4", f"CASE WHEN {pct('f', 't')} < 50 THEN 'HIGH' ELSE 'INFO' END", "DepartmentId", "f", "t", departments="k"),
    row("P4", when("h > 0", "INFO"), "DepartmentId", "hn", departments="h"),
))
def dept_concentration(spark, folder) -> DataFrame:
    df = b.table(spark, folder, "customer").select(
        F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")).alias("DepartmentId")
    )
    return _run(df, PAY, ["P4"], "departments")


@query("provider_npi", found(
    f"{b.PAYROLL}, m AS (SELECT count(*) AS t, count(*) FILTER (EmployeeNpi = '') AS n FROM payroll WHERE job_class = 'Physician')",
    row("P5", "CASE WHEN t = 0 THEN 'INFO' ELSE " + over(pct("n", "t"), (20, "HIGH"), above_zero="MEDIUM", otherwise="INFO") + " END", "EmployeeNpi", "n", "t"),
))
def provider_npi(spark, folder) -> DataFrame:
    return _run(b.payroll(spark, folder), PAY, ["P5"])


@query("class_coverage", found(
    f"""{b.PAYROLL}, m AS (SELECT count(*) AS t, count(*) FILTER (job_class = 'Unclassified') AS j, count(*) FILTER (EarningsCode = 'A') AS e FROM payroll)""",
    row("P6", over(pct("j", "t"), (15, "MEDIUM"), otherwise="INFO"), "JobCodeDesc", "j", "t", lost_values="CASE WHEN j > 0 THEN 1 ELSE 0 END"),
    row("P6", over(pct("e", "t"), (15, "MEDIUM"), otherwise="INFO"), "EarningsCodeDesc", "e", "t", lost_values="CASE WHEN e > 0 THEN 1 ELSE 0 END"),
))
def class_coverage(spark, folder) -> DataFrame:
    return _run(b.payroll(spark, folder), PAY, ["P6"], "lost_values")


@query("staff_mix", found(
    f"""{b.PAYROLL}, e AS (SELECT EmployeeId, min(job_class) AS j FROM payroll GROUP BY 1), m AS (SELECT count(*) AS t, count(*) FILTER (j = 'Physician') AS p,
 count(*) FILTER (j = 'RN') AS s, count(*) FILTER (j = 'Admin/Patient Access') AS f FROM e)""",
    row("P7", when("s = 0", "CRITICAL"), "JobCodeDesc", support="NULL", front="NULL"), row("P7", when("f = 0", "HIGH"), "JobCodeDesc", support="NULL", front="NULL"),
    row("P7", when("p = 0", "HIGH"), "JobCodeDesc", support="NULL", front="NULL"),
    row("P7", over(pct("p", "t"), (60, "MEDIUM")), "JobCodeDesc", "p", "t", support="NULL", front="NULL"),
    row("P7", "'INFO'", "JobCodeDesc", "p", "t", support="s", front="f"),
))
def staff_mix(spark, folder) -> DataFrame:
    return _run(b.payroll(spark, folder), PAY, ["P7"], "support", "front")


@query("staff_totals", f"""WITH {b.PAYROLL} SELECT job_class AS label, count(*) AS rows, CAST(sum(hours) AS DOUBLE) AS hours, CAST(sum(amount) AS DOUBLE) AS amount
 FROM payroll GROUP BY 1""")
def staff_totals(spark, folder) -> DataFrame:
    return payroll.staff_totals(b.payroll(spark, folder))


# Ledger.

GL = Context("gl", test_month="2006-03")


@query("account_lengths", found(
    f"{b.LEDGER}, m AS (SELECT count(DISTINCT length(account)) AS k, count(DISTINCT account) AS a, mode(length(account)) AS md FROM ledger)",
    row("G1", "CASE WHEN k > 3 THEN 'MEDIUM' ELSE 'INFO' END", "AcctNumber", "k", "a", "NULL", modal="(SELECT s FROM (SELECT length(account) AS s, count(*) AS n FROM ledger GROUP BY 1 ORDER BY n DESC, s LIMIT 1))"),
))
def account_lengths(spark, folder) -> DataFrame:
    return _run(b.ledger(spark, folder), GL, ["G1"], "modal")


@query("one_to_one", found(
    f"""{b.LEDGER}, m AS (SELECT (SELECT count(*) FROM (SELECT center FROM ledger GROUP BY 1 HAVING count(DISTINCT center_name) > 1)) AS a,
 (SELECT count(*) FROM (SELECT center_name FROM ledger GROUP BY 1 HAVING count(DISTINCT center) > 1)) AS b, (SELECT count(DISTINCT center) FROM ledger) AS t)""",
    row("G2", "CASE WHEN a > 0 OR b > 0 THEN 'HIGH' ELSE 'INFO' END", "CostCenterNumberOrig", "a + b", "t", "NULL", several_names="a", several_numbers="b"),
))
def one_to_one(spark, folder) -> DataFrame:
    return _run(b.ledger(spark, folder), GL, ["G2"], "several_names", "several_numbers")


@query("category_totals", f"""WITH {b.LEDGER} SELECT category, count(DISTINCT account) AS accounts, CAST(sum(amount) AS DOUBLE) AS amount FROM ledger GROUP BY 1""")
def category_totals(spark, folder) -> DataFrame:
    return ledger.category_totals(b.ledger(spark, folder)).select("category", "accounts", F.col("amount").cast("double").alias("amount"))


@query("account_classes", found(
    f"""{b.LEDGER}, m AS (SELECT count(DISTINCT account) AS t, count(DISTINCT account) FILTER (category = 'Unclassified') AS u FROM ledger)""",
    row("G3", over(pct("u", "t"), (30, "HIGH"), (10, "MEDIUM"), otherwise="INFO"), "AcctDesc", "u", "t"),
))
def account_classes(spark, folder) -> DataFrame:
    return _run(b.ledger(spark, folder), GL, ["G3"])


@query("category_presence", "SELECT 'G4' AS check_id, 'INFO' AS severity, c AS template_field FROM (VALUES ('Other Revenue'), ('Facilities / Occupancy'), ('Medical Supplies')) v(c) "
       "WHERE EXISTS (SELECT 1 FROM lineitem)")
def category_presence(spark, folder) -> DataFrame:
    return run_checks(b.ledger(spark, folder), GL, ["G4"]).select("check_id", "severity", "template_field")


@query("amount_range", found(
    f"""{b.LEDGER}, m AS (SELECT count(*) AS t, CAST(min(amount) AS DOUBLE) AS lo, CAST(max(amount) AS DOUBLE) AS hi, CAST(sum(amount) AS DOUBLE) AS s FROM ledger)""",
    row("G5", when("t > 0", "INFO"), "AmountOrig", None, "t", least="lo", most="hi", sum="s"),
))
def amount_range(spark, folder) -> DataFrame:
    return _run(b.ledger(spark, folder), GL, ["G5"], "least", "most", "sum")


@query("months_present", found(
    f"""{b.LEDGER}, m AS (SELECT count(*) AS t, count(DISTINCT ym) AS k, count(*) FILTER (ym = 206003) AS x FROM ledger)""",
    row("G6", when("x = 0", "HIGH"), "YearMonth"), row("G6", "'INFO'", "YearMonth", "k", "t", "NULL"),
))
def months_present(spark, folder) -> DataFrame:
    return _run(b.ledger(spark, folder), Context("gl", test_month="2060-03"), ["G6"])


@query("amount_per_month", f"WITH {b.LEDGER} SELECT CAST(ym AS VARCHAR) AS ym, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS amount FROM ledger GROUP BY 1")
def amount_per_month(spark, folder) -> DataFrame:
    return ledger.amount_per_month(b.ledger(spark, folder))


def _category(name: str) -> str:
    return f"coalesce(sum(amount) FILTER (category = '{name}'), 0)"


_PL = f"""{b.LEDGER}, p AS (SELECT center, min(center_name) AS name, {_category('Charges')} AS charges, {_category('Adjustments')} AS adjustments,
 {_category('Provider Compensation')} AS provider_comp, {_category('Support Staff Compensation')} AS staff_comp, {_category('Other Operating Expenses')} AS other_expenses
 FROM ledger GROUP BY 1), q AS (SELECT *, CAST(charges <> 0 AS INT) + CAST(adjustments <> 0 AS INT) + CAST(provider_comp <> 0 AS INT) + CAST(staff_comp <> 0 AS INT)
 + CAST(other_expenses <> 0 AS INT) AS k, charges + adjustments AS net_revenue, provider_comp + staff_comp + other_expenses AS total_expenses FROM p),
 pl AS (SELECT *, net_revenue + total_expenses AS net_income, CASE WHEN k = 5 THEN 'Complete' WHEN k >= 3 THEN 'Mostly Complete' WHEN k >= 1 THEN 'Incomplete' ELSE 'Empty' END AS tier FROM q)"""
_PL_COLUMNS = ["charges", "adjustments", "provider_comp", "staff_comp", "other_expenses", "net_revenue", "total_expenses", "net_income"]


@query("cost_center_pl", f"WITH {_PL} SELECT center AS cost_center, name, tier, k AS required_present, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _PL_COLUMNS) + " FROM pl")
def cost_center_pl(spark, folder) -> DataFrame:
    return ledger.cost_center_pl(b.ledger(spark, folder)).select("cost_center", "name", "tier", "required_present", *_PL_COLUMNS)


@query("pl_with_total", f"WITH {_PL} SELECT center AS cost_center, CAST(sum(net_revenue) AS DOUBLE) AS net_revenue, CAST(sum(net_income) AS DOUBLE) AS net_income FROM pl GROUP BY ROLLUP (center)")
def pl_with_total(spark, folder) -> DataFrame:
    rows = ledger.pl_with_total(ledger.cost_center_pl(b.ledger(spark, folder)))
    return rows.select("cost_center", F.round("net_revenue", 2).alias("net_revenue"), F.round("net_income", 2).alias("net_income"))


@query("pl_completeness", found(
    f"{_PL}, m AS (SELECT count(*) AS t, count(*) FILTER (k < 3) AS i, count(*) FILTER (k IN (3, 4)) AS mo, count(*) FILTER (k = 5) AS c FROM pl)",
    row("G7", when("i > 0", "HIGH"), "CostCenterNumberOrig", "i", "t"), row("G7", when("mo > 0", "MEDIUM"), "CostCenterNumberOrig", "mo", "t"),
    row("G7", "'INFO'", "CostCenterNumberOrig", "c", "t"),
    row("G7", when("charges <> 0 AND adjustments = 0", "MEDIUM"), "CostCenterNumberOrig", source="pl"),
    row("G7", when("provider_comp <> 0 AND charges = 0", "MEDIUM"), "CostCenterNumberOrig", source="pl"),
))
def pl_completeness(spark, folder) -> DataFrame:
    return _run(b.ledger(spark, folder), GL, ["G7"])


# Quality and surveys.

@query("rate_check", found(
    f"""{b.QUALITY}, m AS (SELECT count(*) AS t, count(*) FILTER (rate < 0 OR rate > 100) AS o, count(*) FILTER (rate IS NULL) AS z,
 count(*) FILTER (top > n - excluded) AS a, count(*) FILTER (n = 0) AS nz, count(*) FILTER (n - excluded > 0 AND abs(top * 1.0 / (n - excluded) * 100 - rate) > 1) AS off FROM quality)""",
    row("Q1", when("o > 0", "HIGH"), "Performance Rate", "o", "t"), row("Q1", when("z > 0", "HIGH"), "Performance Rate", "z", "t"),
    row("Q2", when("a > 0", "HIGH"), "Numerator", "a", "t"), row("Q2", when("nz > 0", "MEDIUM"), "Denominator", "nz", "t"),
    row("Q2", when("off > 0", "MEDIUM"), "Performance Rate", "off", "t"),
))
def rate_check(spark, folder) -> DataFrame:
    return _run(b.quality(spark, folder), Context("quality"), ["Q1", "Q2"])


@query("measure_checks", found(
    f"""{b.QUALITY}, m AS (SELECT count(*) AS t, count(*) FILTER (bad = 1) AS odd, count(*) FILTER (lang = 'en' AND good = 1 AND bad = 0) AS known,
 count(*) FILTER (lang = 'es') AS shape, count(DISTINCT measure) AS k FROM quality)""",
    row("Q3", when("odd > 0", "MEDIUM"), "Is_Inverse", "odd", "t", measures="NULL"), row("Q3", when("known > 0", "INFO"), "Is_Inverse", "known", "t", measures="NULL"),
    row("Q3", when("known > 0", "INFO"), "Is_Inverse", "known", "t", measures="NULL"),
    row("Q4", over(pct("shape", "t"), (10, "MEDIUM"), otherwise="INFO"), "Measure Number", "shape", "t", measures="k"),
))
def measure_checks(spark, folder) -> DataFrame:
    return _run(b.quality(spark, folder), Context("quality"), ["Q3", "Q4"], "measures")


@query("period_lengths", found(
    f"""{b.QUALITY}, m AS (SELECT count(*) AS t, count(*) FILTER (days < 1) AS r, count(*) FILTER (days NOT IN (28,29,30,31,89,90,91,92,181,182,183,365,366)) AS u,
 (SELECT days FROM (SELECT days, count(*) AS c FROM quality GROUP BY 1 ORDER BY c DESC, days LIMIT 1)) AS md FROM quality)""",
    row("Q5", when("r > 0", "HIGH"), "Measurement Period Start Date", "r", "t"),
    row("Q5", when("u > t * 0.2", "MEDIUM"), "Measurement Period End Date", "u", "t"),
    row("Q5", "'INFO'", "Measurement Period End Date", "md", "t", "NULL"),
))
def period_lengths(spark, folder) -> DataFrame:
    return _run(b.quality(spark, folder), Context("quality"), ["Q5"])


@query("score_scale", found(
    f"""{b.SURVEYS}, m AS (SELECT count(*) AS t, count(*) FILTER (score IS NULL) AS z, max(score) AS hi, min(score) AS lo,
 count(*) FILTER (score > CASE WHEN (SELECT max(score) FROM surveys) <= 5 THEN 5 WHEN (SELECT max(score) FROM surveys) <= 10 THEN 10 ELSE 100 END) AS o FROM surveys)""",
    row("PS1", when("o > 0", "HIGH"), "Score", "o", "t", least="NULL", most="NULL", high="NULL"),
    row("PS1", when("z > 0", "HIGH"), "Score", "z", "t", least="NULL", most="NULL", high="NULL"),
    row("PS1", "'INFO'", "Score", None, "t", least="lo", most="hi", high="CASE WHEN hi <= 5 THEN 5 WHEN hi <= 10 THEN 10 ELSE 100 END"),
))
def score_scale(spark, folder) -> DataFrame:
    return _run(b.surveys(spark, folder), Context("patient_satisfaction"), ["PS1"], "least", "most", "high")


@query("survey_periods", found(
    f"{b.SURVEYS}, m AS (SELECT count(*) AS t, count(*) FILTER (days < 0) AS r, count(*) FILTER (days > 180) AS l, min(days) AS lo, max(days) AS hi FROM surveys)",
    row("PS2", when("r > 0", "HIGH"), "Survey Date Range End", "r", "t", shortest="NULL", longest="NULL"),
    row("PS2", when("l > 0", "MEDIUM"), "Survey Date Range End", "l", "t", shortest="NULL", longest="NULL"),
    row("PS2", "'INFO'", "Survey Date Range End", None, "t", shortest="lo", longest="hi"),
))
def survey_periods(spark, folder) -> DataFrame:
    return _run(b.surveys(spark, folder), Context("patient_satisfaction"), ["PS2"], "shortest", "longest")


_ORDERS = f"""{b.SURVEYS}, g AS (SELECT npi, max(q) - min(q) + 1 <> count(*) AS gap, count(*) <> count(DISTINCT q) AS dup FROM surveys GROUP BY 1)"""


@query("order_gaps", found(
    f"""{_ORDERS}, m AS (SELECT count(*) AS t, count(*) FILTER (gap) AS g, count(*) FILTER (dup) AS d,
 (SELECT count(*) FROM surveys) AS n, (SELECT count(*) FROM surveys WHERE q <= 0) AS z FROM g)""",
    row("PS3", when("z > 0", "MEDIUM"), "Question Order", "z", "n", repeats="NULL"),
    row("PS3", when("g > 0 OR d > 0", "MEDIUM"), "Question Order", "g", "t", repeats="d"),
))
def order_gaps(spark, folder) -> DataFrame:
    return _run(b.surveys(spark, folder), Context("patient_satisfaction"), ["PS3"], "repeats")


@query("order_gaps_per_provider", f"WITH {_ORDERS} SELECT npi AS provider, gap AS gaps, dup AS repeats FROM g")
def order_gaps_per_provider(spark, folder) -> DataFrame:
    return quality.question_orders(b.surveys(spark, folder))


@query("survey_npi", found(
    f"{b.SURVEYS}, m AS (SELECT count(*) AS t, count(DISTINCT npi) AS k, count(*) FILTER (length(npi) <> 10) AS z FROM surveys)",
    row("PS4", when("z > 0", "MEDIUM"), "Provider NPI", "z", "t"), row("PS4", "'INFO'", "Provider NPI", "k"),
))
def survey_npi(spark, folder) -> DataFrame:
    return _run(b.surveys(spark, folder), Context("patient_satisfaction"), ["PS4"])
