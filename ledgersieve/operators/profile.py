"""Column profile of a whole table: one scan, one small shuffle, one row per column.

Every rule about single values (missing, malformed, too long, out of domain,
placeholder, garbled, impossible date) reads this table instead of the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..context import ColumnMeta, Context
from ..functions.parse import DATE_SHAPES, date_shape, moment_of, number
from ..functions.text import missing, strip
from . import quantiles as q

TEXT_TYPES = ("char", "text")
NUMBER_TYPES = ("int", "decimal", "numeric", "float", "money")
_INTEGERS = ("int", "integer", "bigint", "smallint")
_DECIMALS = ("decimal", "numeric", "float", "money")


def is_date(sql_type: str) -> bool:
    return "date" in sql_type


def is_numeric(sql_type: str) -> bool:
    return any(t in sql_type for t in NUMBER_TYPES)


def is_text(sql_type: str) -> bool:
    return not sql_type or any(t in sql_type for t in TEXT_TYPES)


def charge_rows(df: DataFrame, ctx: Context) -> Column | None:
    """Row condition "this is a charge" from the transaction type sets; None if there is nothing to test."""
    types, tests = ctx.types, []
    if "TransactionType" in df.columns and types.charge_codes:
        tests.append(strip("TransactionType").isin(sorted(types.charge_codes)))
    if "TransactionTypeDesc" in df.columns and types.charge_descriptions:
        tests.append(F.lower(strip("TransactionTypeDesc")).isin(sorted(types.charge_descriptions)))
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False)) if tests else None


def transaction_rows(df: DataFrame, ctx: Context) -> Column:
    types, tests = ctx.types, [F.lit(False)]
    if "TransactionType" in df.columns and types.transaction_codes:
        tests.append(strip("TransactionType").isin(sorted(types.transaction_codes)))
    if "TransactionTypeDesc" in df.columns and types.transaction_descriptions:
        tests.append(F.lower(strip("TransactionTypeDesc")).isin(sorted(types.transaction_descriptions)))
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False))


def with_charge_fact(df: DataFrame, ctx: Context) -> Context:
    """The context of a combined file with the fact whether any of its rows is a charge: one pass, one row."""
    mask = charge_rows(df, ctx) if ctx.source == "billing_combined" else None
    return ctx if mask is None else ctx.for_file(has_charges=bool(df.agg(F.bool_or(mask)).first()[0]))


def charge_scope(df: DataFrame, ctx: Context, fallback: str = "all") -> Column:
    """Charge rows of a combined file.

    When no row is a charge: ``all`` rows, ``none``, or those matching the charge ``keyword``.
    Whether there is one the context says, found once per file; without it, it is a value of the
    plan, found while it runs.
    """
    if ctx.source != "billing_combined":
        return F.lit(True)
    other = F.lit(fallback == "all")
    if fallback == "keyword":
        named = [c for c in ("TransactionType", "TransactionTypeDesc") if c in df.columns]
        tests = [F.coalesce(F.col(c).rlike(f"(?i){rules.CHARGE_KEYWORDS}"), F.lit(False)) for c in named]
        other = reduce(Column.__or__, tests, F.lit(False))
    mask = charge_rows(df, ctx)
    if mask is None:
        return other
    if ctx.has_charges is not None:
        return mask if ctx.has_charges else other
    some = F.coalesce(df.agg(F.bool_or(mask)).scalar(), F.lit(False))
    return F.when(some, mask).otherwise(other)


# What holds for a column's type, as bits of one small number.
DATE, TIME, WHOLE, DECIMAL, NUMERIC, TEXT, INT32, WINDOWED, SIZED, DOMAIN = (1 << i for i in range(10))
_DOMAINS = list(rules.DOMAIN_PATTERNS)


def _flags(meta: ColumnMeta, ctx: Context) -> int:
    kind = meta.sql_type.lower()
    tests = {
        DATE: is_date(kind),
        TIME: kind == "time",
        WHOLE: kind in _INTEGERS,
        DECIMAL: kind in _DECIMALS,
        NUMERIC: is_numeric(kind),
        TEXT: is_text(kind),
        INT32: kind in ("int", "integer"),
        WINDOWED: bool(ctx.window) and meta.staging == rules.FILTER_DATE.get(ctx.source),
        SIZED: kind in ("varchar", "nvarchar", "char") and bool(meta.max_length),
        DOMAIN: meta.staging in rules.DOMAIN_COLUMNS,
    }
    return sum(bit for bit, holds in tests.items() if holds)


def _per_column(values: list, kind: str) -> Column:
    """The i-th of a constant list."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("i"))


def _cells(df: DataFrame, metas: list[ColumnMeta], ctx: Context) -> DataFrame:
    """One row per cell, with what is parsed from it once: text, date, number, shape."""
    charge = charge_scope(df, ctx, fallback="none")
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.col(f"`{m.staging}`").cast("string").alias("v"),
            (charge if m.staging in rules.CHARGE_ONLY_COLUMNS else F.lit(True)).alias("scope"),
        )
        for i, m in enumerate(metas)
    ])
    used = {bit for m in metas for bit in (DATE, NUMERIC) if _flags(m, ctx) & bit}
    rows = df.select(F.inline(cells)).withColumns({
        "flags": _per_column([_flags(m, ctx) for m in metas], "int"), "t": strip("v"),
    }).withColumn("filled", F.coalesce(F.col("t") != "", F.lit(False)))
    none = F.lit(None)
    rows = rows.withColumn("shape", F.when(_has(DATE), date_shape("t")) if DATE in used else none.cast("string"))
    return rows.withColumns({
        "day": moment_of(F.col("t"), F.col("shape")).cast("date") if DATE in used else none.cast("date"),
        "number": F.when(_has(NUMERIC), number("t")) if NUMERIC in used else none.cast("double"),
    })


def _has(bit: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(bit)) != 0


def _used(metas: list[ColumnMeta], ctx: Context) -> int:
    used = 0
    for m in metas:
        used |= _flags(m, ctx)
    return used


def _wrong(metas: list[ColumnMeta], ctx: Context) -> tuple[Column, Column]:
    """Cells that do not have the shape of their type, and cells outside their domain."""
    used, t, filled = _used(metas, ctx), F.col("t"), F.col("filled")
    bad = F.lit(False)
    if used & DATE:
        bad |= _has(DATE) & filled & F.col("shape").isNull()
    if used & TIME:
        bad |= _has(TIME) & filled & ~t.rlike(rules.TIME_SHAPE)
    if used & WHOLE:
        bad |= _has(WHOLE) & filled & ~t.rlike(rules.INTEGER_SHAPE)
    if used & DECIMAL:
        bad |= _has(DECIMAL) & filled & ~_bare(t).rlike(rules.DECIMAL_SHAPE)
    off = F.lit(False)
    if used & DOMAIN:
        names = [rules.DOMAIN_COLUMNS.get(m.staging) for m in metas]
        domain = _per_column([_DOMAINS.index(n) if n else None for n in names], "int")
        for code, name in enumerate(_DOMAINS):
            if name in names:
                off |= (domain == code) & filled & ~t.rlike(rules.DOMAIN_PATTERNS[name][0])
        off = _has(DOMAIN) & off
    return bad, off


def _bare(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def _metrics(metas: list[ColumnMeta], ctx: Context) -> dict[str, Column]:
    """Aggregates over the cells of a column; only those some column of the file needs.

    All buffers are numbers, so Spark folds them in a hash table: a minimum of texts
    would make it sort every cell.
    """
    used = _used(metas, ctx)
    v, t, filled, day, value = (F.col(c) for c in ("v", "t", "filled", "day", "number"))
    bad, off = _wrong(metas, ctx)
    out = {
        "rows": F.count("*"),
        "scoped_rows": F.count_if("scope"),
        "nulls": F.count_if(F.col("scope") & v.isNull()),
        "missing": F.count_if(F.col("scope") & ~filled),
        "filled": F.count_if(filled),
        "bad_type": F.count_if(bad),
        "off_domain": F.count_if(off),
        "placeholders": F.count_if(F.lower(t).isin(rules.PLACEHOLDERS)),
    }
    if used & DECIMAL:
        whole = F.length(F.split_part(F.ltrim(_bare(t), F.lit("-")), F.lit("."), F.lit(1)))
        room = _per_column([m.precision - m.scale if m.precision and m.scale is not None else None for m in metas], "int")
        out["digit_overflow"] = F.count_if(_has(DECIMAL) & filled & (whole > room))
    if used & SIZED:
        limit = _per_column([m.max_length for m in metas], "int")
        out["longest"] = F.max(F.when(_has(SIZED), F.length(v)))
        out["too_long"] = F.count_if(_has(SIZED) & (F.length(v) > limit))
    if used & TEXT:
        # Every trace of a wrong character set is outside ASCII, so plain text is not searched.
        out["mojibake"] = F.count_if(_has(TEXT) & (F.octet_length(v) > F.length(v)) & v.rlike(rules.MOJIBAKE))
        out["control"] = F.count_if(_has(TEXT) & v.rlike(rules.CONTROL))
    if used & DATE:
        out |= {
            "dates": F.count(day),
            "dates_impossible": F.count_if((day < "1900-01-01") | (day > "2099-12-31")),
            "dates_epoch": F.count_if(day == "1970-01-01"),
            "first_date": F.min(day),
            "last_date": F.max(day),
            "shapes": F.array(*[F.count_if(F.col("shape") == label) for label, _, _ in DATE_SHAPES]),
        }
        if ctx.test_month:
            out["dates_far_future"] = F.count_if(day > F.add_months(F.to_date(F.lit(f"{ctx.test_month}-01")), 132))
        if ctx.window:
            out["dates_outside"] = F.count_if(_has(WINDOWED) & ((day < F.lit(ctx.window[0])) | (day > F.lit(ctx.window[1]))))
    if used & NUMERIC:
        out |= {
            "numbers": F.count(value),
            "zeros": F.count_if(value == 0),
            "negatives": F.count_if(value < 0),
            "smallest": F.min(value),
            "largest": F.max(value),
            "mean": F.avg(value),
            "deviation": F.stddev_samp(value),
            "int32_overflow": F.count_if(_has(INT32) & ((value > 2147483647) | (value < -2147483648))),
        }
    return out


# The bit a column must have for a metric to say anything about it.
APPLIES = {
    "digit_overflow": DECIMAL, "int32_overflow": INT32, "longest": SIZED, "too_long": SIZED, "off_domain": DOMAIN,
    "mojibake": TEXT, "control": TEXT, "dates": DATE, "dates_impossible": DATE, "dates_epoch": DATE, "dates_far_future": DATE,
    "dates_outside": WINDOWED, "shapes": DATE, "numbers": NUMERIC, "zeros": NUMERIC, "negatives": NUMERIC,
    "bad_type": DATE | TIME | WHOLE | DECIMAL,
}
# Every column of a file gives all of these; null where the type has no such metric.
METRIC_TYPES = dict.fromkeys(
    [
        "rows", "scoped_rows", "nulls", "missing", "filled", "bad_type", "digit_overflow", "int32_overflow", "longest", "too_long",
        "off_domain", "placeholders", "mojibake", "control", "dates", "dates_impossible", "dates_epoch", "dates_far_future",
        "dates_outside", "numbers", "zeros", "negatives",
    ],
    "bigint",
) | {
    "first_date": "date", "last_date": "date", "smallest": "double",
    "largest": "double", "mean": "double", "deviation": "double", "shapes": "array<bigint>",
}


def mapped(df: DataFrame, ctx: Context) -> list[ColumnMeta]:
    return [m for m in ctx.columns if m.staging in df.columns]


def profile(df: DataFrame, ctx: Context) -> DataFrame:
    """One row per mapped column of ``df``; ``ctx.columns`` says what each should hold.

    Cells become rows inside the scan's stage and are folded there, one group per
    column, so what is shuffled is one row per column and task.
    """
    metas = mapped(df, ctx)
    levels = ctx.levels()
    measured = _metrics(metas, ctx)
    folded = _cells(df, metas, ctx).groupBy("i").agg(*[e.alias(k) for k, e in measured.items()])
    folded = folded.withColumn("flags", _per_column([_flags(m, ctx) for m in metas], "int"))
    fixed = {
        "staging_column": ([m.staging for m in metas], "string"),
        "sql_type": ([m.sql_type.lower() for m in metas], "string"),
        "level": ([levels.get(m.staging, m.level) for m in metas], "string"),
        "max_length": ([m.max_length for m in metas], "int"),
        "precision": ([m.precision for m in metas], "int"),
        "scale": ([m.scale for m in metas], "int"),
        "domain": ([rules.DOMAIN_COLUMNS.get(m.staging) for m in metas], "string"),
    }

    def metric(name: str) -> Column:
        value = F.col(name) if name in measured else F.lit(None)
        return F.when(_has(APPLIES[name]), value) if name in APPLIES and name in measured else value

    return folded.select(
        *[_per_column(*spec).alias(name) for name, spec in fixed.items()],
        *[metric(name).cast(kind).alias(name) for name, kind in METRIC_TYPES.items()],
    )


def bad_examples(df: DataFrame, ctx: Context) -> DataFrame:
    """``staging_column, example_low, example_high`` over malformed cells only."""
    metas = mapped(df, ctx)
    bad, off = _wrong(metas, ctx)
    wrong = _cells(df, metas, ctx).where(bad | off).groupBy("i").agg(F.min("t").alias("example_low"), F.max("t").alias("example_high"))
    return wrong.select(_per_column([m.staging for m in metas], "string").alias("staging_column"), "example_low", "example_high")


def _long(df: DataFrame, columns: list[str], value, name: str = "value") -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("staging_column"), value(F.col(f"`{c}`")).alias(name)) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def numeric_outliers(df: DataFrame, ctx: Context) -> DataFrame:
    """Per numeric column: quartiles, range, and values beyond three inter-quartile ranges."""
    columns = [m.staging for m in mapped(df, ctx) if is_numeric(m.sql_type.lower())]
    return outliers(df, columns)


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = q.value_counts(_long(df, columns, number), ["staging_column"], "value")
    quartiles = q.from_counts(counts, ["staging_column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 3 * (F.col("q3") - F.col("q1"))
    outside = (F.col("q3") > F.col("q1")) & (
        (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
    )
    return (
        counts.join(F.broadcast(quartiles), "staging_column")  # one row per column of the file
        .groupBy("staging_column")
        .agg(
            F.sum("n").alias("numbers"),
            F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outliers"),
            *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
            F.min("value").alias("smallest"),
            F.max("value").alias("largest"),
        )
    )


def placeholder_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``staging_column, value, n`` of dummy values; at most one row per literal and spelling.

    Cells are tested before they become rows, so a clean table yields no rows to shuffle.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("staging_column"), strip(F.col(f"`{c}`")).alias("value")) for c in columns])
    dummy = F.filter(cells, lambda cell: F.lower(cell["value"]).isin(rules.PLACEHOLDERS))
    return df.select(F.inline(dummy)).groupBy("staging_column", "value").agg(F.count("*").alias("n"))
