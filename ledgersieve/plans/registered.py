"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Queries that write a step to the shared folder while they are built; all others run nothing before they are read.
STORING: set[str] = set()


def query(name: str, sql: str | None = None, stores: bool = False):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if stores:
            STORING.add(name)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# Writing finding rows in SQL, in the shape of ``findings.report``.

def row(
    check: str, severity: str, column: str | None = None, affected: str | None = None, total: str | None = None,
    pct: str | None = None, source: str = "m", **metrics: str,
) -> str:
    """One SELECT; ``pct`` follows from ``affected`` and ``total`` unless given (``NULL`` to leave it out)."""
    if pct is None:
        pct = f"CAST({affected} AS DOUBLE) / NULLIF({total}, 0) * 100" if affected and total else "NULL"
    cells = [
        f"'{check}' AS check_id", f"({severity}) AS severity",
        f"CAST({'NULL' if column is None else column if column.startswith('(') else repr(column)} AS VARCHAR) AS staging_column",
        f"CAST({affected or 'NULL'} AS DOUBLE) AS affected", f"CAST({total or 'NULL'} AS DOUBLE) AS total",
        f"CAST({pct} AS DOUBLE) AS pct",
    ]
    cells += [f"CAST({value} AS DOUBLE) AS {name}" for name, value in metrics.items()]
    return f"SELECT {', '.join(cells)} FROM {source}"


def found(ctes: str, *rows: str) -> str:
    return f"WITH {ctes} SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE severity IS NOT NULL"


def over(value: str, *steps: tuple[float, str], above_zero: str | None = None, otherwise: str | None = None) -> str:
    cases = [f"WHEN {value} > {limit} THEN '{name}'" for limit, name in steps]
    if above_zero:
        cases.append(f"WHEN {value} > 0 THEN '{above_zero}'")
    return f"CASE {' '.join(cases)} ELSE {repr(otherwise) if otherwise else 'NULL'} END"


def when(condition: str, severity: str) -> str:
    return f"CASE WHEN {condition} THEN '{severity}' END"


def pct(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) / NULLIF({whole}, 0) * 100)"
