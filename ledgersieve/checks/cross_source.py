"""Checks between sources, C0 to C5.

Each check compares distinct values with their row counts and dollars; rows of
the two sources are never joined to each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..context import Context
from ..findings import emit, finding, over, percent, samples_per, union, with_samples
from ..functions import amount, key, present, strip, strip_zeros
from ..operators import frequency, fuzzy, keys
from ..operators.profile import charge_rows, charge_scope, transaction_rows
from ..sources.steps import stored
from .billing import link_column
from .payroll import npi_population

def eligible(sources: list[str]) -> bool:
    """Cross-source checks need two of billing, scheduling, payroll and ledger."""
    groups = {rules.SOURCE_GROUP.get(s) for s in sources}
    return len(groups & set(rules.CROSS_GROUPS)) >= 2


def _note(df: DataFrame, ctx: Context, check: str, text: str) -> DataFrame:
    return emit(df.sparkSession.range(1), ctx, [finding(check, "INFO", text)], phase=4)


def _positive(df: DataFrame) -> Column:
    if "ChargeAmountOriginal" not in df.columns:
        return F.lit(0).cast("decimal(20,4)")
    return F.greatest(amount("ChargeAmountOriginal"), F.lit(0).cast("decimal(20,4)"))


# C0: transactions and charges.

def split_combined(df: DataFrame, ctx: Context) -> tuple[DataFrame, DataFrame]:
    mask = charge_rows(df, ctx)
    return df.where(F.lit(False) if mask is None else mask), df.where(transaction_rows(df, ctx))


def transaction_match_rate(charges: DataFrame, transactions: DataFrame, ctx: Context) -> DataFrame:
    """C0a: share of transaction rows whose id belongs to a charge."""
    a, b = link_column(charges), link_column(transactions)
    if a is None or b is None:
        return _note(charges, ctx, "C0a", "C0a: skipped, since charges or transactions have no linking id")
    m = keys.overlap(keys.presence(transactions, strip(b), charges, strip(a)))
    pct = percent(F.col("left_rows_matched"), F.col("left_rows"))
    severity = F.when(pct < 75, "HIGH").when(pct < 90, "MEDIUM").when(pct.isNull(), "INFO").otherwise("PASS")
    return emit(m, ctx, [finding(
        "C0a", severity,
        F.format_string("C0a: %.1f%% of the transactions (%,d of %,d) belong to a charge", pct, "left_rows_matched", "left_rows"),
        affected=F.col("left_rows_matched"), total=F.col("left_rows"), column=b,
        metrics={"charge_ids": F.col("right_keys"), "transaction_ids": F.col("left_keys")},
    )], phase=4)


def charge_balances(charges: DataFrame, transactions: DataFrame) -> DataFrame:
    """``charge_id, charged, settled, outstanding`` of every charge, in one shuffle."""
    a, b = link_column(charges), link_column(transactions)
    zero = F.lit(0).cast("decimal(20,4)")
    paid = zero
    for c in ("PaymentOriginal", "AdjustmentOriginal", "RefundOriginal"):
        if c in transactions.columns:
            paid = paid + amount(c)
    owed = charges.select(
        strip(a).alias("charge_id"), F.lit(1).alias("is_charge"),
        amount("ChargeAmountOriginal").alias("charged"), zero.alias("settled"),
    )
    moved = transactions.select(
        strip(b).alias("charge_id"), F.lit(0).alias("is_charge"), zero.alias("charged"), paid.alias("settled"),
    )
    per_charge = owed.unionByName(moved).groupBy("charge_id").agg(
        F.max("is_charge").alias("is_charge"), F.sum("charged").alias("charged"), F.sum("settled").alias("settled"),
    ).where("is_charge = 1").drop("is_charge")
    return per_charge.withColumn("outstanding", F.col("charged") + F.col("settled"))


def payment_balance(charges: DataFrame, transactions: DataFrame, ctx: Context) -> DataFrame:
    """C0b: share of charges paid to zero, and what is still open."""
    if link_column(charges) is None or link_column(transactions) is None or "ChargeAmountOriginal" not in charges.columns:
        return _note(charges, ctx, "C0b", "C0b: skipped, since amounts or linking ids are missing")
    m = charge_balances(charges, transactions).agg(
        F.count("*").alias("charges"),
        F.count_if(F.abs("outstanding") < 0.01).alias("zero"),
        F.coalesce(F.sum("charged"), F.lit(0)).cast("double").alias("charged"),
        F.coalesce(F.sum("outstanding"), F.lit(0)).cast("double").alias("open"),
    )
    zero_pct = percent(F.col("zero"), F.col("charges"))
    rate = F.when(F.abs("charged") > 0.01, F.abs("open") / F.abs("charged") * 100).otherwise(0.0)
    severity = (
        F.when(F.col("charges") == 0, "INFO").when((zero_pct < 65) & (rate > 15), "HIGH")
        .when((zero_pct < 65) | (rate > 15), "MEDIUM").otherwise("PASS")
    )
    return emit(m, ctx, [finding(
        "C0b", severity,
        F.format_string(
            "C0b: %.1f%% of the charges are settled (65%% wanted); %.1f%% of the charged dollars are open (15%% allowed)",
            zero_pct, rate,
        ),
        affected=F.col("zero"), total=F.col("charges"), column="ChargeAmountOriginal",
        metrics={
            "outstanding": F.col("open"), "charged": F.col("charged"), "outstanding_rate": rate,
            "average_outstanding": F.try_divide(F.col("open"), F.col("charges").cast("double")),
        },
    )], phase=4)


# Values of several columns against one reference list.

def column_values(df: DataFrame, columns: list[str], money: Column | None = None) -> DataFrame:
    """``staging_column, value, shown, rows, amount``: one scan for all columns."""
    money = F.lit(0).cast("decimal(20,4)") if money is None else money
    cells = F.array(*[F.struct(F.lit(c).alias("staging_column"), strip(c).alias("shown")) for c in columns])
    rows = df.select(F.explode(cells).alias("cell"), money.alias("amount")).select("cell.*", "amount")
    return rows.groupBy("staging_column", F.lower("shown").alias("value")).agg(
        F.min("shown").alias("shown"), F.count("*").alias("rows"), F.sum("amount").alias("amount"),
    )


def reference_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct trimmed lower-case values of the columns that exist, as ``value``."""
    here = [c for c in columns if c in df.columns]
    cells = F.explode(F.array(*[key(F.col(c).cast("string")) for c in here])) if here else F.lit(None).cast("string")
    return df.select(cells.alias("value")).where(present("value")).distinct()


def _marked(values: DataFrame, reference: DataFrame) -> DataFrame:
    return values.join(reference.withColumn("hit", F.lit(True)), "value", "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def org_values(billing: DataFrame, ledger: DataFrame, ctx: Context) -> DataFrame:
    """Billing organisation values with rows, positive charge dollars and whether the ledger knows them."""
    rows = billing.where(charge_scope(billing, ctx))
    columns = [c for c in rules.BILLING_ORG_COLUMNS if c in billing.columns]
    return _marked(
        column_values(rows, columns, _positive(billing)),
        reference_values(ledger, ["CostCenterNumberOrig", "CostCenterNameOrig"]),
    )


def unmatched_org_values(billing: DataFrame, ledger: DataFrame, ctx: Context, k: int = 20) -> DataFrame:
    """The k unmatched values with the most dollars."""
    lost = org_values(billing, ledger, ctx).where(present("value") & ~F.col("hit"))
    return lost.select("staging_column", F.col("shown").alias("value"), "rows", F.col("amount").cast("double").alias("amount")).orderBy(
        F.desc("amount"), "staging_column", "value"
    ).limit(k)


def org_match(billing: DataFrame, ledger: DataFrame, ctx: Context) -> DataFrame:
    """C1: every billing organisation column against the ledger's cost centers."""
    if not any(c in billing.columns for c in rules.BILLING_ORG_COLUMNS):
        return _note(billing, ctx, "C1", "C1: skipped, since billing has no organisation column")
    named, lost = present("value"), present("value") & ~F.col("hit")
    values = org_values(billing, ledger, ctx)
    m = values.groupBy("staging_column").agg(
        F.count_if(named).alias("values"),
        F.count_if(lost).alias("lost"),
        F.sum("amount").cast("double").alias("dollars"),
        F.coalesce(F.sum(F.when(lost, F.col("amount"))), F.lit(0)).cast("double").alias("lost_dollars"),
    ).where("values > 0")
    m = m.join(samples_per(values.where(lost), "staging_column", "shown", count="rows", by="amount"), "staging_column", "left")
    dollar_pct = F.when(F.col("dollars") > 0.01, F.col("lost_dollars") / F.col("dollars") * 100).otherwise(0.0)
    many = F.col("lost") > F.col("values") * 0.2
    severity = F.when(F.col("lost") == 0, "PASS").when(many & (dollar_pct > 5), "HIGH").otherwise("MEDIUM")
    matched = F.col("values") - F.col("lost")
    return emit(m, ctx, [finding(
        "C1", severity,
        F.format_string("C1: of the values of %s the ledger knows %.1f%% (%d of %d); the others hold %.1f%% of the charged dollars",
                        "staging_column", percent(matched, F.col("values")), matched, "values", dollar_pct),
        affected=F.col("lost"), total=F.col("values"), pct=percent(matched, F.col("values")), column=F.col("staging_column"),
        metrics={"dollars": F.col("dollars"), "lost_dollars": F.col("lost_dollars"), "lost_dollar_pct": dollar_pct},
        samples=F.col("which"),
    )], phase=4)


# C2: providers.

def _providers(billing: DataFrame, payroll: DataFrame, ctx: Context, by_npi: bool | None) -> tuple[DataFrame, bool] | None:
    """Billing providers with rows, dollars, whether payroll has them and their most similar name; and whether NPIs decide.

    The lists are written to the shared folder once: the distinct ids with what payroll knows of
    them, payroll's names, and the ids with the names found.  Everything after that reads these, not
    the extracts, and names are matched once.
    """
    rows = billing.where(charge_scope(billing, ctx))
    npis = "EmployeeNpi" in payroll.columns and "RenderingProviderNpi" in rows.columns
    named = "EmployeeFullName" in payroll.columns and "RenderingProviderFullName" in rows.columns
    if not (npis if by_npi else named if by_npi is False else npis or named):
        return None
    by = npis if by_npi is None else by_npi
    if by_npi is None and npis:
        by = (npi_population(payroll).first()[0] or 0) > rules.NPI_PRESENT_PCT  # one row
    none = F.lit(None).cast("string")

    def ids(npi: str, name: str) -> Column:
        return (strip(npi) if npis else none) if by else (key(name) if named else none)

    text = key("RenderingProviderFullName") if named else none
    left = rows.select(ids("RenderingProviderNpi", "RenderingProviderFullName").alias("id"), text.alias("text"), _positive(rows).alias("dollars"))
    left = left.where(present("id")).groupBy("id").agg(F.min("text").alias("text"), F.count("*").alias("n"), F.sum("dollars").alias("dollars"))
    right = payroll.select(ids("EmployeeNpi", "EmployeeFullName").alias("id")).where(present("id")).distinct()
    marked = stored(left.join(right.withColumn("hit", F.lit(True)), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "providers")
    if not named:
        return marked.withColumns({"best": none, "score": F.lit(None).cast("double")}), by
    names = stored(payroll.select(key("EmployeeFullName").alias("text")).where(present("text")).distinct(), "names")
    lost = marked.where(~F.col("hit") & present("text")).select("text")
    similar = fuzzy.best_match(lost, names, rules.NPI_NAME_FUZZY if by else rules.NAME_FUZZY)
    return stored(marked.join(similar.select("text", "best", "score"), "text", "left"), "provider-matches"), by


def provider_candidates(billing: DataFrame, payroll: DataFrame, ctx: Context, by_npi: bool | None = None) -> DataFrame | None:
    """Billing providers that payroll lacks, with the payroll name most like theirs."""
    found = _providers(billing, payroll, ctx, by_npi)
    return found and found[0].where(~F.col("hit") & F.col("score").isNotNull()).select("id", "text", "best", "score", F.col("n").alias("rows"))


def provider_match(billing: DataFrame, payroll: DataFrame, ctx: Context, by_npi: bool | None = None) -> DataFrame:
    """C2: billing providers in payroll, by NPI where payroll has them, else by name."""
    found = _providers(billing, payroll, ctx, by_npi)
    if found is None:
        return _note(billing, ctx, "C2", "C2: no provider id or name is filled on both sides, nothing to compare")
    marked, by = found
    lost = ~F.col("hit")
    m = marked.agg(
        F.count("*").alias("providers"), F.count_if("hit").alias("found"), F.count_if(lost & F.col("score").isNotNull()).alias("similar"),
    )
    shown = F.concat_ws(" ~ ", "id", "best")
    m = with_samples(m, marked.where(lost).withColumn("shown", shown), "shown", by="dollars")
    lost_pct = percent(F.col("providers") - F.col("found"), F.greatest("providers", F.lit(1)))
    by_id = (
        F.when((lost_pct > 30) & (F.col("similar") == 0), "HIGH").when(lost_pct > 10, "MEDIUM")
        .when(F.col("similar") > 0, "INFO").otherwise("PASS")
    )
    by_name = F.when((lost_pct > 50) & (F.col("similar") == 0), "HIGH").when(lost_pct > 0, "MEDIUM").otherwise("PASS")
    pct = percent(F.col("found"), F.greatest("providers", F.lit(1)))
    return emit(m, ctx, [finding(
        "C2", by_id if by else by_name,
        F.format_string(f"C2: payroll has %d of %d billing providers (%.1f%%), compared by {'NPI' if by else 'name'}", "found", "providers", pct),
        affected=F.col("found"), total=F.col("providers"), pct=pct,
        column="RenderingProviderNpi" if by else "RenderingProviderFullName", metrics={"similar": F.col("similar")},
        samples=F.col("which"),
    )], phase=4)


def top_providers(billing: DataFrame, payroll: DataFrame, ctx: Context, by_npi: bool = True, k: int = 20) -> DataFrame:
    """The k providers with the most charge dollars, their usual other name, and whether payroll has them."""
    rows = billing.where(charge_scope(billing, ctx)).withColumn("dollars", _positive(billing))
    npi = strip("RenderingProviderNpi") if "RenderingProviderNpi" in rows.columns else F.lit("")
    name = strip("RenderingProviderFullName") if "RenderingProviderFullName" in rows.columns else F.lit("")
    pairs = rows.groupBy(npi.alias("npi"), name.alias("name")).agg(F.sum("dollars").alias("dollars"), F.count("*").alias("n"))
    by, other = ("npi", "name") if by_npi else ("name", "npi")
    ranked = F.min(F.struct((-F.col("n")).alias("r"), F.col(other).alias("v")))["v"]
    best = pairs.groupBy(by).agg(F.sum("dollars").alias("dollars"), ranked.alias(other))
    top = best.orderBy(F.desc("dollars"), by).limit(k)
    if by_npi:
        known = payroll.select(strip("EmployeeNpi").alias("k"))
        on = F.col(by)
    else:
        known, on = payroll.select(key("EmployeeFullName").alias("k")), F.lower(by)
    known = known.where(present("k")).distinct()
    return top.withColumn("k", on).join(known.withColumn("matched", F.lit(True)), "k", "left").select(
        "npi", "name", F.col("dollars").cast("double").alias("charge_amount"), F.coalesce("matched", F.lit(False)).alias("matched"),
    )


# C3 and C5: places.

def place_match(
    left: DataFrame, columns: list[str], reference: DataFrame, ctx: Context, check: str, high_pct: float,
) -> DataFrame:
    """Distinct values of each column in the reference list, similar ones counted as half found."""
    here = [c for c in columns if c in left.columns]
    if not here:
        return _note(left, ctx, check, f"{check}: skipped, since there is no column that names a place")
    reference = stored(reference, "places")
    marked = stored(_marked(column_values(left, here).where(present("value")), reference), "place-values")
    similar = fuzzy.best_match(
        marked.where(~F.col("hit")).select(F.col("value").alias("text")),
        reference.select(F.col("value").alias("text")), rules.LOCATION_FUZZY,
    )
    marked = marked.join(similar.select(F.col("text").alias("value"), "best", "score"), "value", "left")
    missed = marked.where(~F.col("hit")).withColumn("shown", F.concat_ws(" ~ ", "shown", "best"))
    m = marked.groupBy("staging_column").agg(
        F.count("*").alias("values"),
        F.count_if("hit").alias("found"),
        F.count_if(~F.col("hit") & F.col("score").isNotNull()).alias("similar"),
    )
    m = m.join(samples_per(missed, "staging_column", "shown", count="rows"), "staging_column", "left")
    lost = F.col("values") - F.col("found")
    severity = (
        F.when(percent(lost - F.col("similar"), F.col("values")) > high_pct, "HIGH").when(lost > 0, "MEDIUM").otherwise("PASS")
    )
    pct = percent(F.col("found"), F.col("values"))
    return emit(m, ctx, [finding(
        check, severity,
        F.format_string(f"{check}: of the values of %s, %.1f%% of %d are known on the other side; %d are not, of which %d resemble one", "staging_column", pct, "values", lost, "similar"),
        affected=F.col("found"), total=F.col("values"), pct=pct, column=F.col("staging_column"), metrics={"similar": F.col("similar")},
        samples=F.col("which"),
    )], phase=4)


def billing_scheduling_places(billing: DataFrame, scheduling: DataFrame, ctx: Context) -> DataFrame:
    """C3a: billing places among scheduling places, and department ids directly."""
    rows = billing.where(charge_scope(billing, ctx))
    parts = [place_match(
        rows, rules.BILLING_PLACE_COLUMNS, reference_values(scheduling, rules.SCHEDULING_PLACE_COLUMNS), ctx, "C3a", 50,
    )]
    if "BillDepartmentId" in rows.columns and "DeptId" in scheduling.columns:
        m = keys.overlap(keys.presence(rows, key("BillDepartmentId"), scheduling, key("DeptId")))
        lost = percent(F.col("left_only"), F.col("left_keys"))
        severity = F.when(lost > 30, "HIGH").when(lost > 0, "MEDIUM").otherwise("PASS")
        parts.append(emit(m.where("left_keys > 0 and right_keys > 0"), ctx, [finding(
            "C3a", severity,
            F.format_string("C3a: scheduling knows %.1f%% of %d billing department ids", "left_coverage", "left_keys"),
            affected=F.col("shared_keys"), total=F.col("left_keys"), column="BillDepartmentId",
        )], phase=4))
    return union(parts)


def _coverage(m: DataFrame, ctx: Context, check: str, what: str, high: float, medium: float, column: str, note: Column | None = None) -> DataFrame:
    least = F.least("left_coverage", "right_coverage")
    fine = F.when(note, "INFO").otherwise("PASS") if note is not None else F.lit("PASS")
    severity = F.when(least.isNull(), "INFO").when(least < high, "HIGH").when(least < medium, "MEDIUM").otherwise(fine)
    text = F.format_string(
        f"{check}: {what}: scheduling knows %.1f%% of those in billing, billing knows %.1f%% of those in scheduling", "left_coverage", "right_coverage"
    )
    return emit(m, ctx, [finding(
        check, severity, text, affected=F.col("shared_keys"), total=F.col("left_keys"), pct=F.col("left_coverage"), column=column,
        metrics={"other_keys": F.col("right_keys"), "other_coverage": F.col("right_coverage")},
    )], phase=4)


def npi_coverage(billing: DataFrame, scheduling: DataFrame, ctx: Context) -> DataFrame:
    """C3b: provider NPIs both ways."""
    if "RenderingProviderNpi" not in billing.columns or "ApptProvNPI" not in scheduling.columns:
        return _note(billing, ctx, "C3b", "C3b: skipped, since one side has no provider NPI")
    rows = billing.where(charge_scope(billing, ctx))
    m = keys.overlap(keys.presence(rows, key("RenderingProviderNpi"), scheduling, key("ApptProvNPI")))
    return _coverage(m, ctx, "C3b", "Provider NPI", 50, 80, "RenderingProviderNpi")


def patient_coverage(billing: DataFrame, scheduling: DataFrame, ctx: Context) -> DataFrame:
    """C3c: patient ids both ways; leading zeros are stripped where only one side has them.

    Keys are grouped once per side before the two zero flags are known, so the
    rewrite happens on distinct ids.
    """
    if "PatientId" not in billing.columns or "PatIdOrig" not in scheduling.columns:
        return _note(billing, ctx, "C3c", "C3c: skipped, since one side has no patient id")
    rows = billing.where(charge_scope(billing, ctx))
    ids = keys.presence(rows, key("PatientId"), scheduling, key("PatIdOrig"))
    zero = F.col("key").rlike(r"^0\d+")
    flags = ids.agg(F.struct(
        F.coalesce(F.bool_or(zero & (F.col("left_rows") > 0)), F.lit(False)).alias("l"),
        F.coalesce(F.bool_or(zero & (F.col("right_rows") > 0)), F.lit(False)).alias("r"),
    ))
    marked = ids.withColumn("flags", flags.scalar()).withColumns({"lz": F.col("flags.l"), "rz": F.col("flags.r")})
    bare = strip_zeros("key")
    sides = F.array(
        F.struct(
            F.when(F.col("lz") & ~F.col("rz"), bare).otherwise(F.col("key")).alias("key"),
            F.col("left_rows").alias("left_rows"), F.lit(0).cast("bigint").alias("right_rows"),
        ),
        F.struct(
            F.when(F.col("rz") & ~F.col("lz"), bare).otherwise(F.col("key")).alias("key"),
            F.lit(0).cast("bigint").alias("left_rows"), F.col("right_rows").alias("right_rows"),
        ),
    )
    stripped = F.col("lz") != F.col("rz")
    again = marked.select(F.explode(sides).alias("s"), stripped.alias("stripped")).select("s.*", "stripped").where(
        "left_rows > 0 or right_rows > 0"
    ).groupBy("key").agg(
        F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"), F.bool_or("stripped").alias("stripped"),
        F.lit(0).cast("decimal(20,4)").alias("left_amount"),
    )
    m = keys.overlap(again, F.bool_or("stripped").alias("stripped"))
    return _coverage(m, ctx, "C3c", "Patient IDs", 30, 65, "PatientId", F.col("stripped"))


def patient_id_forms(billing: DataFrame, scheduling: DataFrame, ctx: Context) -> DataFrame:
    """S5 across sources: whether patient ids are numbers on one side only."""
    if "PatientId" not in billing.columns or "PatIdOrig" not in scheduling.columns:
        return _note(billing, ctx, "S5", "S5: forms were not compared, since one side has no patient id")
    ours = frequency.shape_facts(billing, "PatientId").select(F.col("format").alias("ours"), F.col("all_digits").alias("our_digits"))
    theirs = frequency.shape_facts(scheduling, "PatIdOrig").select(F.col("format").alias("theirs"), F.col("all_digits").alias("their_digits"))
    m = ours.join(theirs)  # one row each
    differ = F.col("our_digits") != F.col("their_digits")
    return emit(m, ctx, [finding(
        "S5", F.when(differ, "HIGH").when(differ.isNotNull(), "INFO"),
        F.format_string("S5: patient ids have the form '%s' in billing and '%s' in scheduling", "ours", "theirs"), column="PatientId",
        metrics={"numbers_in_billing": F.col("our_digits").cast("int"), "numbers_in_scheduling": F.col("their_digits").cast("int")},
    )], phase=4)


def scheduling_ledger_places(scheduling: DataFrame, ledger: DataFrame, ctx: Context) -> DataFrame:
    """C5: scheduling places among cost-center names and numbers."""
    reference = reference_values(ledger, ["CostCenterNameOrig", "CostCenterNumberOrig"])
    return place_match(scheduling, rules.SCHEDULING_LEDGER_COLUMNS, reference, ctx, "C5", 30)


# C4: departments and cost centers.

def department_rows(payroll: DataFrame) -> DataFrame:
    """``dept, name, rows`` per payroll department; the name is the most frequent one."""
    name = strip("DepartmentName") if "DepartmentName" in payroll.columns else F.lit("")
    pairs = payroll.select(strip("DepartmentId").alias("dept"), name.alias("name")).where(present("dept")).groupBy(
        "dept", "name"
    ).agg(F.count("*").alias("n"))
    return pairs.groupBy("dept").agg(
        F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("r"), F.col("name").alias("v")))["v"].alias("name"),
    )


def _center_keys(ledger: DataFrame) -> DataFrame:
    """``kind, key``: numbers and names as written, numbers without leading zeros."""
    cells = []
    if "CostCenterNumberOrig" in ledger.columns:
        number_ = key("CostCenterNumberOrig")
        cells += [F.struct(F.lit("exact").alias("kind"), number_.alias("key")),
                  F.struct(F.lit("number").alias("kind"), number_.alias("key")),
                  # a blank number strips to "0" but is no number
                  F.struct(F.lit("bare").alias("kind"), F.when(number_ != "", strip_zeros(number_)).alias("key"))]
    if "CostCenterNameOrig" in ledger.columns:
        cells.append(F.struct(F.lit("exact").alias("kind"), key("CostCenterNameOrig").alias("key")))
    columns = [c for c in ("CostCenterNumberOrig", "CostCenterNameOrig") if c in ledger.columns]
    distinct = ledger.select(*columns).distinct()
    rows = distinct.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rows.where(present("key")).distinct()


def _probes(norm: Column, sizes: Column) -> Column:
    """What is looked up for a department: the id itself (``start`` -1) and every part of it as long as some center number."""
    def probe(kind: str, text: Column, start: Column, size: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("key"), start.alias("start"), size.alias("size"))

    none = F.lit(-1)
    whole = F.array(probe("exact", norm, none, none), probe("bare", strip_zeros(norm), none, none))

    def cut(size: Column, start: Column) -> Column:
        part = F.substr(norm, start + 1, size)
        return F.array(probe("number", part, start, size), probe("bare", strip_zeros(part), start, size))

    def of_size(size: Column) -> Column:
        last = F.length(norm) - size
        return F.when(last >= 0, F.flatten(F.transform(F.sequence(F.lit(0), last), lambda start: cut(size, start)))).otherwise(F.array())

    return F.concat(whole, F.flatten(F.transform(sizes, of_size)))


def department_match(payroll: DataFrame, ledger: DataFrame, offset: bool = True) -> DataFrame:
    """``dept, name, rows, matched, start, size`` of every payroll department.

    Ids and all their parts are looked up by one equality join.  A cut (``start``, from 0, and
    ``size``) counts for all departments if four in five of at least five ids hit a center with
    it, ids are longer than center numbers, and few ids match as they are; of such cuts the one
    with the most hits, then the shortest and the first.  What follows the join sees one row per
    department and cut.
    """
    departments, centers = department_rows(payroll), _center_keys(ledger)
    length = F.length("key").cast("int")
    numbers = centers.where(F.col("kind") == "number").agg(
        F.struct(F.collect_set(length).alias("sizes"), F.avg(length).alias("length")).alias("s")  # at most one size per length
    ).scalar() if offset else None
    sizes = numbers["sizes"] if offset else F.array().cast("array<int>")
    probes = departments.withColumn("sizes", sizes).withColumn("p", F.explode(_probes(F.lower("dept"), F.col("sizes")))).select("dept", "name", "rows", "p.*")
    hit, whole = F.col("found").isNotNull(), F.col("start") == -1
    looked_up = probes.join(centers.withColumn("found", F.lit(True)), ["kind", "key"], "left").groupBy("dept", "name", "rows").agg(
        F.bool_or(hit & whole).alias("direct"), F.collect_set(F.when(hit & ~whole, F.struct("start", "size"))).alias("cuts"),
    )
    if not offset:
        return looked_up.select("dept", "name", "rows", F.col("direct").alias("matched"))
    everyone, same_cut = Window.partitionBy(F.lit(0)), Window.partitionBy("cut.start", "cut.size")
    spread = looked_up.withColumns({
        "ids": F.count("*").over(everyone),
        "worth": (F.avg(F.length("dept")).over(everyone) > F.coalesce(numbers["length"], F.lit(1e9)) + 1)
        & (F.avg(F.col("direct").cast("double")).over(everyone) < rules.OFFSET_SHARE),
    }).withColumn("cut", F.explode_outer("cuts"))
    hits = F.when(F.col("cut").isNotNull(), F.count("*").over(same_cut))
    enough = F.col("worth") & (F.col("ids") >= rules.OFFSET_MIN_IDS) & (F.col("hits") >= F.col("ids") * rules.OFFSET_SHARE)
    order = F.struct(F.col("hits").alias("hits"), (-F.col("cut.size")).alias("size"), (-F.col("cut.start")).alias("start"))
    best = F.max(F.when(enough, order)).over(everyone)
    chosen = spread.withColumn("hits", hits).withColumn("best", best)
    start, size = -F.col("best.start"), -F.col("best.size")
    here = F.coalesce((F.col("cut.start") == start) & (F.col("cut.size") == size), F.lit(False))
    return chosen.groupBy("dept", "name", "rows").agg(
        F.bool_or(F.col("direct") | here).alias("matched"), F.max(start).alias("start"), F.max(size).alias("size"),
    )


def payroll_ledger_departments(payroll: DataFrame, ledger: DataFrame, ctx: Context) -> DataFrame:
    """C4: payroll departments among cost centers."""
    if "DepartmentId" not in payroll.columns:
        return _note(payroll, ctx, "C4", "C4: skipped, since payroll has no department id")
    if not {"CostCenterNumberOrig", "CostCenterNameOrig"} & set(ledger.columns):
        return _note(payroll, ctx, "C4", "C4: skipped, since the ledger has no cost centers")
    lost = ~F.col("matched")
    matched = department_match(payroll, ledger)
    m = matched.agg(
        F.count("*").alias("departments"), F.count_if("matched").alias("found"),
        F.count_if(lost & (F.col("rows") > 100)).alias("large"), F.max("start").alias("start"), F.max("size").alias("size"),
    )
    m = with_samples(m, matched.where(lost), "dept", count="rows")
    severity = (
        F.when(F.col("large") > 0, "HIGH").when(F.col("found") < F.col("departments"), "MEDIUM").otherwise("PASS")
    )
    pct = percent(F.col("found"), F.col("departments"))
    text = F.concat(
        F.format_string("C4: the ledger knows %.1f%% of %d payroll departments; %d of the others have more than 100 rows",
                        pct, "departments", "large"),
        F.when(F.col("start").isNotNull(),
               F.format_string("; the center is found in the characters %d to %d of the id", F.col("start"), F.col("start") + F.col("size"))).otherwise(""),
    )
    return emit(m, ctx, [finding(
        "C4", severity, text, affected=F.col("found"), total=F.col("departments"), pct=pct, column="DepartmentId",
        metrics={"large_unmatched": F.col("large"), "offset_start": F.col("start"), "offset_size": F.col("size")},
        samples=F.col("which"),
    )], phase=4)


def unmatched_departments(payroll: DataFrame, ledger: DataFrame, k: int = 20) -> DataFrame:
    lost = department_match(payroll, ledger).where(~F.col("matched"))
    return lost.select("dept", "name", "rows").orderBy(F.desc("rows"), "dept").limit(k)


def cross_checks(tables: dict[str, DataFrame], contexts: dict[str, Context]) -> list[Callable[[], DataFrame]]:
    """One function per check whose two sources are there."""
    if not eligible(list(tables)):
        return []
    billing_source = next((s for s in ("billing_combined", "billing_charges") if s in tables), None)
    out: list[Callable[[], DataFrame]] = []
    if billing_source:
        billing, ctx = tables[billing_source], contexts[billing_source]
        charges = transactions = None
        if billing_source == "billing_combined":
            charges, transactions = split_combined(billing, ctx)
        elif "billing_transactions" in tables:
            charges, transactions = billing, tables["billing_transactions"]
        if charges is not None:
            out += [lambda: transaction_match_rate(charges, transactions, ctx), lambda: payment_balance(charges, transactions, ctx)]
        if "gl" in tables:
            out.append(lambda: org_match(billing, tables["gl"], ctx))
        if "payroll" in tables:
            out.append(lambda: provider_match(billing, tables["payroll"], ctx))
        if "scheduling" in tables:
            scheduling = tables["scheduling"]
            out += [
                lambda: billing_scheduling_places(billing, scheduling, ctx), lambda: npi_coverage(billing, scheduling, ctx),
                lambda: patient_coverage(billing, scheduling, ctx), lambda: patient_id_forms(billing, scheduling, ctx),
            ]
    if "payroll" in tables and "gl" in tables:
        out.append(lambda: payroll_ledger_departments(tables["payroll"], tables["gl"], contexts["payroll"]))
    if "scheduling" in tables and "gl" in tables:
        out.append(lambda: scheduling_ledger_places(tables["scheduling"], tables["gl"], contexts["scheduling"]))
    return out


def reconciliation(billing: DataFrame, expected: DataFrame, keys_: list[str], value: str, expected_value: str) -> DataFrame:
    """Sums of two tables side by side per key (wRVUs by provider, ledger by center and account) and how far they agree."""
    zero = F.lit(0).cast("decimal(20,4)")
    sides = billing.select(*keys_, amount(value).alias("ours"), zero.alias("theirs")).unionByName(
        expected.select(*keys_, zero.alias("ours"), amount(expected_value).alias("theirs"))
    )
    sums = sides.groupBy(*keys_).agg(F.sum("ours").alias("ours"), F.sum("theirs").alias("theirs"))
    ratio = percent(F.least(F.abs("ours"), F.abs("theirs")), F.greatest(F.abs("ours"), F.abs("theirs")))
    return sums.select(
        *keys_, F.col("ours").cast("double").alias("ours"), F.col("theirs").cast("double").alias("theirs"),
        (F.col("ours") - F.col("theirs")).cast("double").alias("difference"), ratio.alias("agreement_pct"),
        F.coalesce(ratio > 98, F.lit(False)).alias("reconciled"),
    )
