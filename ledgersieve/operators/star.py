"""Star-schema load: insert-new dimension members, then facts with foreign keys and typed measures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import day, day_form
from ..functions.formula import apply_transforms
from ..rules import NULL_KEY
from ..sources.steps import stored

BUCKETS = 1024

def keyed(df: DataFrame, *names: str) -> Column:
    """First of the columns that exists, or its calculated twin, with the null key for nulls."""
    found = _present(df, names)
    return F.coalesce(F.col(found).cast("string"), F.lit(NULL_KEY)) if found else F.lit(NULL_KEY)


def plain(df: DataFrame, *names: str) -> Column:
    """The same without the null key, for dates and measures."""
    found = _present(df, names)
    return F.col(found) if found else F.lit(None).cast("string")


def _present(df: DataFrame, names: tuple[str, ...]) -> str | None:
    here = df.columns
    return next((c for name in names for c in (name, f"{name}_Calculated") if c in here), None)


@dataclass(frozen=True)
class Expression:
    """A column of the fact or of a member, made from the columns ``names``; equal ones are computed once.

    Where a value is costly to read, ``form`` builds a text that stands for it and ``read`` makes the
    value of that text; the members' forms are then read, not those of all rows.
    """

    build: Callable[..., Column]
    names: tuple[str, ...] = ()
    extra: tuple = ()
    form: Callable[..., Column] | None = None
    read: Callable[[Column], Column] | None = None

    def __call__(self, df: DataFrame) -> Column:
        return self.build(df, *self.names, *self.extra)

    def constant(self, df: DataFrame) -> bool:
        return not any(_present(df, (name,)) for name in self.names)


def _constant(df: DataFrame, text: str) -> Column:
    return F.lit(text)


def _joined(df: DataFrame, first: str, second: str, separator: str) -> Column:
    return F.concat_ws(separator, keyed(df, first), keyed(df, second))


def _prefix(df: DataFrame, name: str, size: int) -> Column:
    return F.left(keyed(df, name), F.lit(size))


def _day(df: DataFrame, *names: str) -> Column:
    return day(plain(df, *names))


def _day_form(df: DataFrame, *names: str) -> Column:
    return day_form(plain(df, *names))


def col(*names: str) -> Expression:
    return Expression(keyed, names)


def const(text: str = NULL_KEY) -> Expression:
    return Expression(_constant, (), (text,))


def joined(separator: str, first: str, second: str) -> Expression:
    return Expression(_joined, (first, second), (separator,))


def prefix(name: str, size: int) -> Expression:
    return Expression(_prefix, (name,), (size,))


def a_date(*names: str) -> Expression:
    return Expression(_day, names, form=_day_form, read=day)


@dataclass(frozen=True)
class Dimension:
    """Natural attributes per role (several roles feed one dimension), and attributes derived from them."""

    name: str
    key: str
    roles: dict[str, dict[str, Expression]]
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)
    required: bool = False  # leave out members whose attributes are all null (dates, periods)
    kinds: dict[str, str] = field(default_factory=dict)  # types of the attributes that are no texts

    @property
    def attributes(self) -> list[str]:
        return list(next(iter(self.roles.values())))


def members(df: DataFrame, dimension: Dimension) -> DataFrame:
    """Distinct members over all roles of a dimension, in one pass over the rows."""
    roles = [
        F.struct(*[expression(df).alias(name) for name, expression in role.items()]) for role in dimension.roles.values()
    ]
    rows = df.select(F.explode(F.array_distinct(F.array(*roles))).alias("m")).select("m.*")
    if dimension.required:
        rows = rows.where(reduce(Column.__or__, [F.col(a).isNotNull() for a in dimension.attributes]))
    return rows.distinct()


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, [a[n].eqNullSafe(b[n]) for n in names])


def number_members(new: DataFrame, attributes: list[str], key: str, after: Column) -> DataFrame:
    """Dense surrogate keys without sorting everything in one task.

    Members are split into hash buckets; a running total over the bucket sizes gives
    each bucket its first number, and members are numbered inside their bucket.
    """
    bucketed = new.withColumn("bucket", F.pmod(F.xxhash64(*attributes), F.lit(BUCKETS)))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("bucket")) - F.col("size"))  # at most BUCKETS rows
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(*attributes))
    return (
        bucketed.join(before.select("bucket", "before"), "bucket")
        .withColumn(key, (after + F.col("before") + inside).cast("bigint"))
        .drop("bucket", "before")
    )


def insert_new(existing: DataFrame | None, candidates: DataFrame, dimension: Dimension) -> DataFrame:
    """Members not yet in the dimension, with new surrogate keys; loading the same rows again adds none."""
    names = dimension.attributes
    if existing is None:
        fresh, after = candidates, F.lit(0)
    else:
        fresh = candidates.join(existing, _same(candidates, existing, names), "left_anti")
        after = F.coalesce(existing.agg(F.max(dimension.key)).scalar(), F.lit(0))
    numbered = number_members(fresh, names, dimension.key, after)
    return numbered.withColumns({k: build() for k, build in dimension.derived.items()})


def upsert(existing: DataFrame | None, candidates: DataFrame, dimension: Dimension) -> DataFrame:
    """The dimension after the load."""
    new = insert_new(existing, candidates, dimension)
    return new if existing is None else existing.unionByName(new.select(*existing.columns))


# All dimensions of a source together: their members are one table, ``dimension, natural, attributes, key``.

LOOKUP_ROWS = 200_000  # members of all dimensions that a fact looks up in memory, together; larger dimensions are joined


def _natural(columns: list[str]) -> str:
    """One text for several attributes, different ones for different attributes: every one behind its length, nulls as a dash."""
    return f"concat({', '.join(f"coalesce(concat(length(string({c})), ':', string({c})), '-')" for c in columns)})"


def _computed(df: DataFrame, expressions: list[Expression]) -> tuple[DataFrame, dict[Expression, str]]:
    """Every different expression once, as a column of its own, and the names."""
    names = {e: f"e{i}" for i, e in enumerate(dict.fromkeys(expressions))}
    return df.select(*[e(df).alias(n) for e, n in names.items()]), names


def _readers(dimension: Dimension) -> dict[str, Callable[[Column], Column]]:
    """Attributes that all roles give as a form, and what reads it."""
    kinds = {a: {(role[a].form, role[a].read) for role in dimension.roles.values()} for a in dimension.attributes}
    return {a: read for a, ((_, read), *others) in ((a, list(k)) for a, k in kinds.items()) if read and not others}


def _in_forms(dimension: Dimension) -> Dimension:
    """The dimension with forms for the attributes that have them."""
    forms = _readers(dimension)
    return replace(dimension, roles={
        role: {a: Expression(e.form, e.names, e.extra) if a in forms else e for a, e in attributes.items()}
        for role, attributes in dimension.roles.items()
    })


def stacked_forms(df: DataFrame, dimensions: list[Dimension]) -> DataFrame:
    """Distinct ``dimension, forms`` over all roles of all dimensions, in one pass over the rows."""
    dimensions = [_in_forms(d) for d in dimensions]
    rows, at = _computed(df, [e for d in dimensions for role in d.roles.values() for e in role.values()])
    # A role without columns is one member: the first row of a partition stands for all of them.
    rows = rows.withColumn("first", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    width = max(len(d.attributes) for d in dimensions)
    cells, some = [], ["dimension IS NOT NULL"]
    for d in dimensions:
        for role in d.roles.values():
            columns = [at[e] for e in role.values()]
            name = f"CASE WHEN first THEN '{d.name}' END" if all(e.constant(df) for e in role.values()) else f"'{d.name}'"
            cells.append(", ".join([name, *[f"string({c})" for c in columns], *["CAST(NULL AS STRING)"] * (width - len(columns))]))
        if d.required:
            some.append(f"dimension <> '{d.name}' OR " + " OR ".join(f"a{i} IS NOT NULL" for i in range(len(d.attributes))))
    cells, names = list(dict.fromkeys(cells)), [f"a{i}" for i in range(width)]
    found = rows.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (dimension, {', '.join(names)})")
    for condition in some:
        found = found.where(condition)
    found = found.distinct()
    sizes = " ".join(f"WHEN '{d.name}' THEN {len(d.attributes)}" for d in dimensions)
    return found.selectExpr("dimension", f"slice(array({', '.join(names)}), 1, CASE dimension {sizes} END) AS forms")


def load_forms(df: DataFrame, dimensions: list[Dimension]) -> DataFrame:
    """The forms of a source's members, written to the shared folder: for :func:`load_members` and :func:`build_fact` of the same rows."""
    return stored(stacked_forms(df, dimensions).sortWithinPartitions("dimension"), "forms")


def _listed(array: str) -> str:
    """The natural key of a list of attributes, as :func:`_natural` gives it for columns."""
    return f"array_join(transform({array}, a -> coalesce(concat(length(a), ':', a), '-')), '')"


def _read_forms(forms: DataFrame, dimension: Dimension) -> DataFrame:
    """``dimension, forms, attributes`` of one dimension whose forms must be read."""
    readers = _readers(dimension)
    cells = [F.get("forms", F.lit(i)) for i in range(len(dimension.attributes))]
    values = [readers[a](c).cast("string") if a in readers else c for a, c in zip(dimension.attributes, cells)]
    return forms.where(F.col("dimension") == dimension.name).select("dimension", "forms", F.array(*values).alias("attributes"))


def _hashed(dimension: str, cells: list[str], width: int) -> str:
    """64 bits for a member's form; a hash passes over nulls, so that their places are hashed as well."""
    cells = cells + ["CAST(NULL AS STRING)"] * (width - len(cells))
    return f"xxhash64({', '.join([dimension, *[part for c in cells for part in (f'string({c})', f'{c} IS NULL')]])})"


def stacked_members(forms: DataFrame, dimensions: list[Dimension]) -> DataFrame:
    """Distinct ``dimension, natural, attributes`` of the members that the forms stand for."""
    read = [d for d in dimensions if _readers(d)]
    plain_ones = [d.name for d in dimensions if not _readers(d)]
    found = forms.where(F.col("dimension").isin(plain_ones)).select("dimension", F.col("forms").alias("attributes"))
    for d in read:
        rows = _read_forms(forms, d).select("dimension", "attributes").distinct()
        found = found.unionByName(rows.where(F.exists("attributes", lambda a: a.isNotNull())) if d.required else rows)
    return found.selectExpr("dimension", f"{_listed('attributes')} AS natural", "attributes")


def new_members(existing: DataFrame | None, forms: DataFrame, dimensions: list[Dimension]) -> DataFrame:
    """The members of :func:`load_forms` that ``existing`` lacks, with dense keys after each dimension's last one.

    Sizes and places are both taken from a list in the shared folder, and the source is read once.
    """
    fresh = stacked_members(forms, dimensions).withColumn("bucket", F.pmod(F.xxhash64("dimension", "natural"), F.lit(BUCKETS)))
    if existing is not None:
        fresh = stored(fresh.join(existing.select("dimension", "natural"), ["dimension", "natural"], "left_anti"), "new-members")
    sizes = fresh.groupBy("dimension", "bucket").agg(F.count("*").alias("size"))
    in_order = Window.partitionBy("dimension").orderBy("bucket")  # at most BUCKETS rows per dimension
    before = sizes.select("dimension", "bucket", (F.sum("size").over(in_order) - F.col("size")).alias("before"))
    if existing is not None:
        last = existing.groupBy("dimension").agg(F.max("key").alias("last"))
        before = before.join(last, "dimension", "left").withColumn("before", F.col("before") + F.coalesce("last", F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("dimension", "bucket").orderBy("natural"))
    return fresh.withColumn("inside", inside).join(F.broadcast(before), ["dimension", "bucket"]).select(
        "dimension", "natural", "attributes", (F.col("before") + F.col("inside")).cast("bigint").alias("key")
    )


def load_members(forms: DataFrame, dimensions: list[Dimension], existing: DataFrame | None = None) -> DataFrame:
    """All members of a source's dimensions after the load, from :func:`load_forms`; new ones are written to the shared folder first."""
    fresh = stored(new_members(existing, forms, dimensions).sortWithinPartitions("dimension"), "members")
    return fresh if existing is None else existing.select(*fresh.columns).unionByName(fresh)


def dimension_table(members: DataFrame, dimension: Dimension) -> DataFrame:
    """One dimension with its columns: key, attributes in their types, and what is derived from them."""
    kinds = {a: dimension.kinds.get(a, "string") for a in dimension.attributes}
    rows = members.where(F.col("dimension") == dimension.name).select(
        F.col("key").alias(dimension.key), *[F.get("attributes", F.lit(i)).cast(kinds[a]).alias(a) for i, a in enumerate(kinds)]
    )
    return rows.withColumns({k: build() for k, build in dimension.derived.items()})


def _date_parts(c: str = "date") -> dict[str, Callable[[], Column]]:
    return {
        "year": lambda: F.year(c), "month": lambda: F.month(c), "year_month": lambda: F.date_format(c, "yyyyMM"),
    }


@dataclass(frozen=True)
class Fact:
    name: str
    dimensions: list[Dimension]
    links: dict[str, tuple[str, str]]  # foreign key -> dimension, role
    measures: dict[str, Expression]


def build_fact(df: DataFrame, fact: Fact, members: DataFrame, forms: DataFrame, source_id: int = 1, file_id: int = 1, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Rows with foreign keys and measures; ``members`` and ``forms`` are written tables, as :func:`load_members` and :func:`load_forms` give them.

    The smallest dimensions, of ``lookup_rows`` members together at most, are one table in memory
    that all their roles look up: it is read and sent once.  Rows carry 64 bits per role to it, and
    no text.  ``forms`` has what the rows can ask for, so no other row is taken for a member; a
    dimension with two forms of equal bits is joined by text.  So is each larger one, after the lookups;
    one as long as the fact moves the fact.  Rows look a member up by its form: dates are not read
    again.  A role for which the rows have no column is the same member for all rows.
    """
    spark, specs = df.sparkSession, {d.name: d for d in fact.dimensions}
    roles = {place: specs[place[0]].roles[place[1]] for place in fact.links.values()}
    formed = {place: _in_forms(specs[place[0]]).roles[place[1]] for place in roles}
    read = {name for name, d in specs.items() if _readers(d)}
    plain_members = members.where(~F.col("dimension").isin(sorted(read)))
    named = plain_members.selectExpr("dimension", "attributes AS cells", "key")
    for name in sorted(read):
        of_forms = _read_forms(forms, specs[name]).selectExpr("dimension", f"{_listed('attributes')} AS natural", "forms AS cells")
        named = named.unionByName(of_forms.join(members.select("dimension", "natural", "key"), ["dimension", "natural"], "left").select(*named.columns))
    listed = plain_members.select("dimension").unionByName(forms.where(F.col("dimension").isin(sorted(read))).select("dimension"))
    sizes = {r["dimension"]: r["count"] for r in listed.groupBy("dimension").count().collect()}  # one row per dimension
    small, held = set(), 0
    for name in sorted(specs, key=lambda n: (sizes.get(n, 0), n)):
        held += sizes.get(name, 0)
        if held <= lookup_rows:
            small.add(name)
    width = max(len(d.attributes) for d in fact.dimensions)
    hashed = named.selectExpr("dimension", f"{_hashed('dimension', [f'get(cells, {i})' for i in range(width)], width)} AS member", "key")
    texts = named.selectExpr("dimension", f"concat(dimension, '/', {_listed('cells')}) AS member", "key")
    alike = hashed.where(F.col("dimension").isin(sorted(small))).groupBy("member").agg(
        F.count("*").alias("n"), F.collect_set("dimension").alias("dimensions")).where("n > 1")
    small -= {name for r in alike.collect() for name in r["dimensions"]}  # as good as never a row

    rows, at = _computed(df, [*fact.measures.values(), *[e for role in formed.values() for e in role.values()]])
    fixed = {place for place, role in roles.items() if all(e.constant(df) for e in role.values())}
    text = {}
    for place, role in formed.items():
        cells = [at[e] for e in role.values()]
        text[place] = f"concat('{place[0]}/', {_natural(cells)})" if place[0] not in small else _hashed(f"'{place[0]}'", cells, width)
        if specs[place[0]].required:
            text[place] = f"CASE WHEN {' OR '.join(f'{c} IS NOT NULL' for c in cells)} THEN {text[place]} END"
    known = {}
    if fixed:
        bare, names = _computed(spark.range(1), [e for place in fixed for e in roles[place].values()])
        wanted = bare.selectExpr("explode(array(" + ", ".join(
            f"named_struct('role', '{role}', 'dimension', '{name}', 'natural', {_natural([names[e] for e in roles[name, role].values()])})" for name, role in fixed
        ) + ")) AS m").select("m.*")
        found = wanted.join(members.select("dimension", "natural", "key"), ["dimension", "natural"]).collect()  # one row per role
        known = {(r["dimension"], r["role"]): r["key"] for r in found}

    # Equal joins are made once; the lookup is the same table for all of them, so it is sent once.
    joins = {t: f"k{i}" for i, t in enumerate(dict.fromkeys(text[p] for p in roles if p not in fixed))}
    owner = {text[p]: p[0] for p in roles}
    tables = {"lookup": hashed.where(F.col("dimension").isin(sorted(small))).select("member", "key")}
    tables |= {f"large_{n}": texts.where(F.col("dimension") == n).select("member", "key") for n in {owner[t] for t in joins} - small}
    sides = {alias: "lookup" if owner[t] in small else f"large_{owner[t]}" for t, alias in joins.items()}
    sides = dict(sorted(sides.items(), key=lambda side: side[1] != "lookup"))
    in_memory = ", ".join(alias for alias, table in sides.items() if table == "lookup")
    keys = {p: f"{joins[text[p]]}.key" if p not in fixed else f"CAST({known.get(p, 'NULL')} AS BIGINT)" for p in roles}
    wanted = [f"{source_id} AS SourceFnbr", f"{file_id} AS FileFnbr", *[f"{keys[p]} AS {fk}" for fk, p in fact.links.items()]]
    wanted += [f"r.{at[e]} AS {name}" for name, e in fact.measures.items()]
    asking = rows.selectExpr("*", *[f"{t} AS t_{alias}" for t, alias in joins.items()])
    steps = " ".join(f"LEFT JOIN {{{sides[alias]}}} {alias} ON r.t_{alias} = {alias}.member" for alias in sides)
    hint = f"/*+ BROADCAST({in_memory}) */ " if in_memory else ""
    used = {name: table for name, table in tables.items() if name in sides.values()}
    return spark.sql(f"SELECT {hint}{', '.join(wanted)} FROM {{rows}} r {steps}", rows=asking, **used)


def load_fact(df: DataFrame, fact: Fact, **more) -> tuple[DataFrame, DataFrame]:
    """The members of all dimensions and the fact, as a first load gives them; ``more`` goes to :func:`build_fact`."""
    forms = load_forms(df, fact.dimensions)
    members = load_members(forms, fact.dimensions)
    return members, build_fact(df, fact, members, forms, **more)


def load_log(fact: DataFrame, source_id: int, file: str) -> DataFrame:
    """One log row: the file and how many rows it brought."""
    return fact.agg(F.count("*").alias("RowsAffected")).select(
        F.lit(source_id).alias("SourceFnbr"), F.lit(file).alias("FileName"), F.lit("Load").alias("EventDesc"), "RowsAffected"
    )


def _sized(df: DataFrame, *names_and_kind: str) -> Column:
    *names, kind = names_and_kind
    return plain(df, *names).try_cast(kind)


def money(*names: str) -> Expression:
    return sized("decimal(14,2)", *names)


def sized(kind: str, *names: str) -> Expression:
    return Expression(_sized, names, (kind,))


def _one(**attributes: Expression) -> dict[str, dict[str, Expression]]:
    return {"row": attributes}


def _dates(name: str, key: str, **roles: str) -> Dimension:
    return Dimension(name, key, {role: {"date": a_date(column)} for role, column in roles.items()}, _date_parts(), required=True, kinds={"date": "date"})


PAYROLL = Fact(
    "PayFact",
    [
        Dimension("PayEmployee", "PayEmpUnbr", _one(
            PayEmpId=col("EmployeeId"), PayEmpFirstName=col("EmployeeFirstName"), PayEmpMidName=col("EmployeeMiddleName"),
            PayEmpLastName=col("EmployeeLastName"), PayEmpFullNameOrig=col("EmployeeFullName"), PayEmpNpi=col("EmployeeNpi"))),
        Dimension("PayDepartment", "PayDeptUnbr", _one(PayDeptId=col("DepartmentId"), PayDeptName=col("DepartmentName"))),
        Dimension("JobCode", "JobCodeUnbr", _one(JobCodeOrig=col("JobCode"), JobCodeDesc=col("JobCodeDesc"))),
        Dimension("PayCode", "PayCodeUnbr", _one(
            PayCodeOrig=joined("_", "JobCode", "EarningsCode"), PayCodeDesc=joined(": ", "JobCodeDesc", "EarningsCodeDesc"))),
        _dates("PayrollDate", "PayrollDateUnbr", start="PayPeriodStartDate", end="PayPeriodEndDate", check="CheckDate"),
    ],
    {
        "PayEmpFnbr": ("PayEmployee", "row"), "PayDeptFnbr": ("PayDepartment", "row"), "JobCodeFnbr": ("JobCode", "row"),
        "PayCodeFnbr": ("PayCode", "row"), "PayPeriodStartDateFnbr": ("PayrollDate", "start"),
        "PayPeriodEndDateFnbr": ("PayrollDate", "end"), "PayChkDateFnbr": ("PayrollDate", "check"),
    },
    {
        "AmountOrig": sized("decimal(10,2)", "AmountOrig", "AmountClean"), "AmountClean": sized("decimal(10,2)", "AmountOrig", "AmountClean"),
        "PayHoursOrig": sized("decimal(7,2)", "Hours"), "PayPeriodStartDate": a_date("PayPeriodStartDate"),
        "PayPeriodEndDate": a_date("PayPeriodEndDate"), "PayChkDate": a_date("CheckDate"),
    },
)
LEDGER = Fact(
    "GlFact",
    [
        Dimension("CostCenter", "CostCenterUnbr", _one(
            CostCenterNumberOrig=col("CostCenterNumberOrig"), CostCenterNameOrig=col("CostCenterNameOrig"))),
        Dimension("Account", "AcctUnbr", _one(AcctNumber=col("AcctNumber"), AcctDesc=col("AcctDesc"))),
        Dimension("SubAccount", "SubAcctUnbr", _one(SubAcctNumber=col("SubAcctNumber"), SubAcctDesc=col("SubAcctDesc"))),
        Dimension("ReportPeriod", "ReportPeriodUnbr", _one(YearMonth=Expression(plain, ("YearMonth",))), {
            "year": lambda: F.left("YearMonth", F.lit(4)), "month": lambda: F.right("YearMonth", F.lit(2))}, required=True),
    ],
    {
        "CostCenterFnbr": ("CostCenter", "row"), "AcctFnbr": ("Account", "row"), "SubAcctFnbr": ("SubAccount", "row"),
        "ReportPeriodFnbr": ("ReportPeriod", "row"),
    },
    {"AmountOrig": money("AmountOrig", "AmountClean"), "AmountClean": money("AmountOrig", "AmountClean"),
     "ReportPeriod": Expression(plain, ("YearMonth",))},
)
SCHEDULING = Fact(
    "SchdApptFact",
    [
        Dimension("SchdLocation", "SchdLocUnbr", _one(SchdLocId=col("BillLocId", "LocationId"), SchdLocName=col("BillLocNameOrig", "LocationName"))),
        Dimension("SchdDepartment", "SchdDeptUnbr", _one(SchdDeptId=col("DeptId", "DepartmentId"), SchdDeptName=col("DeptNameOrig", "DepartmentName"))),
        Dimension("SchdProvider", "SchdProvUnbr", _one(
            SchdProvNpi=col("ApptProvNPI", "RenderingProviderNpi"), SchdProvFirstName=col("ApptProvFirstName", "RenderingProviderFirstName"),
            SchdProvLastName=col("ApptProvLastName", "RenderingProviderLastName"),
            SchdProvFullName=col("ApptProvFullNameOrig", "RenderingProviderFullName"))),
        _dates("SchdDate", "DateUnbr", appointment="ApptDate"),
    ],
    {
        "SchdLocFnbr": ("SchdLocation", "row"), "SchdDeptFnbr": ("SchdDepartment", "row"), "SchdProvFnbr": ("SchdProvider", "row"),
        "ApptDateFnbr": ("SchdDate", "appointment"),
    },
    {"ApptId": col("ApptId"), "ApptStatus": col("ApptStatus"), "PatientId": col("PatIdOrig", "PatientId"), "ApptDate": a_date("ApptDate")},
)


def _provider(role: str) -> dict[str, Expression]:
    return {
        "ProvFirstName": col(f"{role}ProviderFirstName"), "ProvMidName": col(f"{role}ProviderMiddleName"),
        "ProvLastName": col(f"{role}ProviderLastName"), "ProvFullNameOrig": col(f"{role}ProviderFullName"),
        "ProvId": const(), "ProvNpi": col(f"{role}ProviderNpi"), "ProvCredentials": col(f"{role}ProviderCredentials"),
    }


def _year(df: DataFrame, first: str, second: str) -> Column:
    """Year of the first date, or of the second where that is blank."""
    return F.coalesce(F.year(day(plain(df, first))), F.year(day(plain(df, second))))


#: Of service, or of posting, so that a later load of the same rows finds the same member.
_service_year = Expression(_year, ("DateOfService", "PostDate"))


_PAYER = Dimension("Payer", "PayerUnbr", _one(
    PayerName=col("ChargePayerName"), PayerPlan=col("ChargePayerPlan"), PayerFinClass=col("ChargePayerFinancialClass")))
_INVOICE = Dimension("Invoice", "InvoiceUnbr", _one(InvoiceNumber=col("InvoiceNumber")))
_BILL_DATES = _dates("Date", "DateUnbr", service="DateOfService", post="PostDate")

CHARGES = Fact(
    "ChargeFact",
    [
        Dimension("ChargeId", "ChrgIdUnbr", _one(ChrgId=col("ChargeId"))),
        _INVOICE,
        _BILL_DATES,
        Dimension("TransactionType", "TranTypeUnbr", _one(TranType=const(), TranTypeDesc=const())),
        Dimension("PatientAge", "PatAgeUnbr", _one(PatAge=col("PatientAge"))),
        Dimension("PatientGender", "GenderUnbr", _one(GenderOrig=col("PatientGender"))),
        Dimension("BillDepartment", "BillDeptUnbr", _one(BillDeptId=col("BillDepartmentId"), BillDeptNameOrig=col("BillDepartmentName"))),
        Dimension("BillLocation", "BillLocUnbr", _one(
            BillLocId=const(), BillLocNameOrig=col("BillLocationName"), BillLocAddress=const(), BillLocCity=const(),
            BillLocState=const(), BillLocZipOrig=const())),
        Dimension("BillPractice", "BillPracUnbr", _one(BillPracId=const(), BillPracNameOrig=col("BillPracticeName"))),
        _PAYER,
        Dimension("BillPatient", "PatUnbr", _one(
            PatIdOrig=col("PatientId"), PatCity=col("PatientCity"), PatState=prefix("PatientState", 30),
            PatZipOrig=col("PatientZip"), PatMrn=col("PatientMrn")),
            {"PatIdClean": lambda: F.col("PatIdOrig"), "PatZipClean": lambda: F.left("PatZipOrig", F.lit(5))}),
        Dimension("PatientRace", "PatRaceUnbr", _one(PatRace=col("PatientRaceEthnicity", "PatientRace"))),
        Dimension("PatientMaritalStatus", "PatMarStatusUnbr", _one(PatMaritalStatus=col("PatientMaritalStatus"))),
        Dimension("Pos", "PosUnbr", _one(PosCode=col("PlaceOfServiceCode"), PosName=const(), PosDesc=const())),
        Dimension("CptCodes", "CptUnbr", _one(
            CptCodeOrig=col("CptCode"), CptCodeDescOrig=prefix("CptCodeDesc", 250), CptServiceYear=_service_year,
            Modifier1=col("Modifier1"), Modifier2=col("Modifier2"), Modifier3=col("Modifier3"), Modifier4=col("Modifier4")),
            kinds={"CptServiceYear": "int"}),
        Dimension("ProviderSpecialty", "ProvSpecialtyUnbr", {
            role: {"ProvSpecialty": col(f"{role}ProviderSpecialty")} for role in ("Rendering", "Billing", "Referring")}),
        Dimension("Provider", "ProvUnbr", {role: _provider(role) for role in ("Rendering", "Billing", "Referring")}),
        Dimension("IcdCodes", "IcdCodeUnbr", {
            "primary": {"IcdCodeOrig": col("PrimaryIcdCode"), "IcdCodeDesc": col("PrimaryIcdCodeDesc", "PrimaryIcdDesc")},
            "none": {"IcdCodeOrig": const(), "IcdCodeDesc": const()}}),
        Dimension("ReasonCodes", "ReasonCodeUnbr", _one(ReasonCodeOrig=const(), ReasonCodeDescOrig=const(), ReasonCodeCatOrig=const())),
        Dimension("TaxIdNumber", "TinUnbr", _one(Tin=col("BillingProviderTaxId"))),
    ],
    {
        "ChrgIdFnbr": ("ChargeId", "row"), "TransactionPostDateFnbr": ("Date", "post"), "ChargePostDateFnbr": ("Date", "post"),
        "DateOfServiceFnbr": ("Date", "service"), "TranTypeFnbr": ("TransactionType", "row"), "PatAgeFnbr": ("PatientAge", "row"),
        "GenderFnbr": ("PatientGender", "row"), "BillDeptFnbr": ("BillDepartment", "row"), "BillLocFnbr": ("BillLocation", "row"),
        "BillPracFnbr": ("BillPractice", "row"), "ChargePayerFnbr": ("Payer", "row"), "TransactionPayerFnbr": ("Payer", "row"),
        "PatFnbr": ("BillPatient", "row"), "PatRaceFnbr": ("PatientRace", "row"), "PatMarStatusFnbr": ("PatientMaritalStatus", "row"),
        "PosFnbr": ("Pos", "row"), "CptFnbr": ("CptCodes", "row"), "BillProvSpecialtyFnbr": ("ProviderSpecialty", "Billing"),
        "RenderProvSpecialtyFnbr": ("ProviderSpecialty", "Rendering"), "ReferProvSpecialtyFnbr": ("ProviderSpecialty", "Referring"),
        "BillProvFnbr": ("Provider", "Billing"), "RenderProvFnbr": ("Provider", "Rendering"), "ReferProvFnbr": ("Provider", "Referring"),
        "PrimaryIcdCodeFnbr": ("IcdCodes", "primary"), "SecondaryIcdCodeFnbr": ("IcdCodes", "none"),
        "InvoiceFnbr": ("Invoice", "row"), "ReasonCodeFnbr": ("ReasonCodes", "row"), "TinFnbr": ("TaxIdNumber", "row"),
    },
    {
        "UnitsOrig": sized("decimal(8,0)", "UnitsOrig", "Units"),
        "ChargeAmtOrig": money("ChargeAmountOriginal", "ChargeAmountOrig"), "ChargeAmtClean": money("ChargeAmountOriginal", "ChargeAmountOrig"),
        "WorkRvuOrig": sized("decimal(8,2)", "WorkRvuOriginal", "WorkRvuOrig"),
        "WorkRvuInflowAdjusted": sized("decimal(8,2)", "WorkRvuClean", "WorkRvuOriginal", "WorkRvuOrig"),
        "TransactionPostDate": a_date("PostDate"), "ChargePostDate": a_date("PostDate"), "DateOfService": a_date("DateOfService"),
    },
)
TRANSACTIONS = Fact(
    "TransactionFact",
    [
        _BILL_DATES,
        Dimension("TransactionType", "TranTypeUnbr", _one(TranType=col("TransactionType"), TranTypeDesc=col("TransactionTypeDesc"))),
        _PAYER,
        Dimension("ReasonCodes", "ReasonCodeUnbr", _one(
            ReasonCodeOrig=col("ReasonCode"), ReasonCodeDescOrig=col("ReasonCodeDesc"), ReasonCodeCatOrig=col("ReasonCodeCat", "ReasonCodeCategory"))),
        _INVOICE,
    ],
    {
        "TransactionPostDateFnbr": ("Date", "post"), "DateOfServiceFnbr": ("Date", "service"), "TranTypeFnbr": ("TransactionType", "row"),
        "ChargePayerFnbr": ("Payer", "row"), "TransactionPayerFnbr": ("Payer", "row"), "ReasonCodeFnbr": ("ReasonCodes", "row"),
        "InvoiceFnbr": ("Invoice", "row"),
    },
    {
        "PaymentOrig": money("PaymentOriginal", "PaymentOrig"), "PaymentClean": money("PaymentOriginal", "PaymentOrig"),
        "AdjustmentOrig": money("AdjustmentOriginal", "AdjustmentOrig"), "AdjustmentClean": money("AdjustmentOriginal", "AdjustmentOrig"),
        "TransactionPostDate": a_date("PostDate"), "DateOfService": a_date("DateOfService"),
    },
)

# Which load a source takes; a combined file loads as charges.
LOADS = {
    "payroll": PAYROLL,
    "gl": LEDGER,
    "scheduling": SCHEDULING,
    "billing_charges": CHARGES,
    "billing_combined": CHARGES,
    "billing_transactions": TRANSACTIONS,
}


def calculated_columns(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add ``<column>_Calculated`` per transform rule, leaving the raw column as it came."""
    named = {c: f"{c}_Calculated" for c, _ in rules if c in df.columns}
    twins = df.withColumns({twin: F.col(c) for c, twin in named.items()}) if named else df
    return apply_transforms(twins, [(named[c], f) for c, f in rules if c in named])


def column_catalog(mapping: DataFrame, calculated: DataFrame, uncovered: DataFrame) -> DataFrame:
    """``file, column, position, in_client_file``: raw headers, calculated columns and placeholders still to be written.

    ``calculated`` has ``file, staging``; ``uncovered`` has ``file, staging``.
    """
    raw = mapping.select("file", F.col("raw").alias("column"), F.col("position"), F.lit(True).alias("in_client_file"))
    extra = calculated.select("file", "staging").unionByName(uncovered.select("file", "staging")).distinct().select(
        "file", F.concat("staging", F.lit("_Calculated")).alias("column"), F.lit(0).alias("position"), F.lit(False).alias("in_client_file")
    )
    return raw.unionByName(extra)


def mapping_catalog(pairs: DataFrame, catalog: DataFrame, structure: DataFrame) -> DataFrame:
    """``file, column, staging`` pairs with ``accepted``: both the raw column and the staging column must be known.

    ``structure`` has ``staging``.
    """
    known_raw = catalog.select("file", "column").distinct().withColumn("raw_known", F.lit(True))
    known_staging = structure.select("staging").distinct().withColumn("staging_known", F.lit(True))
    return pairs.join(known_raw, ["file", "column"], "left").join(known_staging, "staging", "left").select(
        "file", "column", "staging",
        F.when(F.col("raw_known").isNull(), "raw column not found").when(F.col("staging_known").isNull(), "staging column not found").alias("rejected"),
        (F.col("raw_known").isNotNull() & F.col("staging_known").isNotNull()).alias("accepted"),
    )
