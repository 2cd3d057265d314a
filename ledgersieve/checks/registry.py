"""Checks by id.

A *row check* contributes aggregates and findings over them; all row checks of a
table share one aggregate, so one scan.  A *table check* groups or joins and
returns its findings itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..context import Context
from ..findings import emit, finding, union

Row = tuple[dict[str, Column], Callable[[Callable[[str], Column]], list[Column]]]


@dataclass(frozen=True)
class Check:
    id: str
    sources: tuple[str, ...]
    needs: tuple[str, ...]
    run: Callable
    by_row: bool

    def applies(self, df: DataFrame) -> bool:
        return all(any(c in df.columns for c in need.split("|")) for need in self.needs)


REGISTRY: dict[str, Check] = {}


def register_check(id: str, sources, run: Callable, *, needs=(), by_row: bool = False) -> Check:
    """Add a check.  ``needs`` are staging columns; ``a|b`` means one of them is enough."""
    check = Check(id, tuple(sources), tuple(needs), run, by_row)
    REGISTRY[id] = check
    return check


def row_check(id: str, *sources: str, needs=()):
    return lambda run: (register_check(id, sources, run, needs=needs, by_row=True), run)[1]


def table_check(id: str, *sources: str, needs=()):
    return lambda run: (register_check(id, sources, run, needs=needs), run)[1]


def run_row_checks(df: DataFrame, ctx: Context, checks: list[Check]) -> DataFrame:
    """All measures of all checks in one aggregate, all findings from its one row."""
    measures, builders = [F.count("*").alias("rows")], []
    for check in checks:
        columns, build = check.run(df, ctx)
        prefix = check.id.replace(".", "_")
        measures += [column.alias(f"{prefix}_{name}") for name, column in columns.items()]
        builders.append((prefix, build))

    def reader(prefix: str) -> Callable[[str], Column]:
        return lambda name: F.col("rows") if name == "rows" else F.col(f"{prefix}_{name}")

    findings = [f for prefix, build in builders for f in build(reader(prefix))]
    return emit(df.agg(*measures), ctx, findings)


def skipped(df: DataFrame, ctx: Context, checks: list[Check]) -> DataFrame:
    """One INFO finding per check whose columns are absent: nothing is passed over in silence."""
    rows = [
        finding(c.id, "INFO", f"{c.id}: skipped - needs {', '.join(n.replace('|', ' or ') for n in c.needs)}")
        for c in checks
    ]
    return emit(df.sparkSession.range(1), ctx, rows)


def check_runs(df: DataFrame, ctx: Context, ids: list[str] | None = None) -> list[Callable[[], DataFrame]]:
    """What to run for the source, or for the named checks: one function per job."""
    chosen = [c for c in REGISTRY.values() if ctx.source in c.sources and (ids is None or c.id in ids)]
    ready = [c for c in chosen if c.applies(df)]
    runs: list[Callable[[], DataFrame]] = []
    by_row = [c for c in ready if c.by_row]
    if by_row:
        runs.append(lambda: run_row_checks(df, ctx, by_row))
    runs += [lambda c=c: c.run(df, ctx) for c in ready if not c.by_row]
    absent = [c for c in chosen if not c.applies(df)]
    if absent:
        runs.append(lambda: skipped(df, ctx, absent))
    return runs


def run_checks(df: DataFrame, ctx: Context, ids: list[str] | None = None) -> DataFrame:
    """Findings of every check registered for the source, or of the named ones, as one plan."""
    return union([run() for run in check_runs(df, ctx, ids)])
