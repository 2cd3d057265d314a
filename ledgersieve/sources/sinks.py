"""Result tables of a review, partitioned by client and round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules
from ..checks import billing, cross_source, ledger, payroll, quality
from ..checks.conformance import compatibility, overall_compatibility
from ..operators import catalog, issues as iss
from .publish import Publication, drop_superseded, in_force


def report_tables(review) -> dict[str, DataFrame]:
    """Every table a report needs, by name.

    Inventory and mapping, coverage and conformance, data quality, cross-source
    results, issues and verdicts, roll-ups.
    """
    findings, marked = review.findings, review.issues
    client_rows = iss.client_issues(marked)
    compat = compatibility(findings)
    tables = {
        "files": review.files,
        "column_map": review.column_map,
        "mapping_gaps": catalog.mapping_gaps(review.sources, review.column_map),
        "billing_format": review.billing_format,
        "file_months": review.months,
        "date_ranges": iss.date_ranges(review.months),
        "schema_coverage": review.coverage,
        "coverage_summary": catalog.coverage_summary(review.coverage),
        "datatype_findings": findings.where("check_id = 'datatype'"),
        "unrecognised_columns": review.unrecognised,
        "compatibility": compat,
        "overall_compatibility": overall_compatibility(compat),
        "findings": findings,
        "null_findings": findings.where("check_id = 'null_blank'"),
        "duplicate_findings": findings.where("check_id IN ('full_row_duplicates', 'duplicate_records')"),
        "file_severities": iss.file_severities(findings),
        "cross_findings": findings.where("phase = 4"),
        "cross_passed": iss.cross_passed(findings),
        "issues": marked,
        "client_issues": client_rows,
        "findings_sheet": iss.findings_sheet(client_rows, marked),
        "source_verdicts": iss.source_verdicts(marked),
        "cross_summary": iss.cross_summary(marked),
        "readiness": review.readiness,
        "checklist": review.checklist,
        "cost_centers": review.cost_centers,
        "providers": review.providers,
    }
    return tables | _value_tables(review)


def _value_tables(review) -> dict[str, DataFrame]:
    """The values behind the findings, for the sources that are there."""
    tables, contexts = review.tables, review.contexts
    out: dict[str, DataFrame | None] = {}
    source = next((s for s in ("billing_combined", "billing_charges") if s in tables), None)
    if "gl" in tables:
        out["cost_center_pl"] = ledger.cost_center_pl(tables["gl"], contexts["gl"])
    if source:
        df, ctx = tables[source], contexts[source]
        if ctx.ref_cpt is not None and "CptCode" in df.columns:
            out["unmatched_codes"] = billing.unmatched_codes(df, ctx)
        if ctx.ref_pos is not None and "PlaceOfServiceCode" in df.columns:
            out["place_distribution"] = billing.place_distribution(df, ctx)
        if "gl" in tables and any(c in df.columns for c in rules.BILLING_ORG_COLUMNS):
            out["unmatched_org_values"] = cross_source.unmatched_org_values(df, tables["gl"], ctx)
        if "payroll" in tables:
            by_npi = {"EmployeeNpi"} <= set(tables["payroll"].columns) and "RenderingProviderNpi" in df.columns
            out["top_providers"] = cross_source.top_providers(df, tables["payroll"], ctx, by_npi=by_npi)
            out["provider_candidates"] = cross_source.provider_candidates(df, tables["payroll"], ctx)
    if "payroll" in tables and "JobCodeDesc" in tables["payroll"].columns:
        out["staff_totals"] = payroll.staff_totals(tables["payroll"])
    if {"payroll", "gl"} <= set(tables) and "DepartmentId" in tables["payroll"].columns:
        out["unmatched_departments"] = cross_source.unmatched_departments(tables["payroll"], tables["gl"])
    if "quality" in tables and "Is_Inverse" in tables["quality"].columns:
        out["inverse_flag_values"] = quality.inverse_flag_values(tables["quality"])
    return {name: df for name, df in out.items() if df is not None}


SCOPE = ("client", "round")


def write_tables(review, path: str, names: list[str] | None = None, format: str = "parquet") -> list[str]:
    """Write the tables under ``path/<name>``; only this client's round is replaced.

    All tables of a call are one batch: they are in force together, with the commit after the last
    one.  A write that fails half-way leaves the former tables in force for :func:`read_table`.
    """
    batch = Publication(review.files.sparkSession, path)
    for name, df in report_tables(review).items():
        if names is None or name in names:
            batch.write(df.withColumns({"client": F.lit(review.client), "round": F.lit(review.round)}), name, *SCOPE, format=format)
    batch.commit()
    for name in batch.tables:
        drop_superseded(batch.spark, path, name, *SCOPE, format=format)
    return batch.tables


def read_table(spark: SparkSession, path: str, name: str, format: str = "parquet") -> DataFrame | None:
    """A written table: of every client and round the rows of the last committed batch."""
    return in_force(spark, path, name, *SCOPE, format=format)
