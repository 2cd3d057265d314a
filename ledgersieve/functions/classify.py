"""First-match keyword classification, compiled to one CASE chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import as_col

Rules = Sequence[tuple[str, str]]


def any_match(c: Column | str, pattern: str) -> Column:
    """Case-insensitive search."""
    return as_col(c).rlike(f"(?i){pattern}")


def classify(c: Column | str, rules: Rules, default: str | None = None) -> Column:
    """Label of the first rule whose pattern is found in the text."""
    label = F.lit(default).cast("string")
    for name, pattern in reversed(list(rules)):
        label = F.when(any_match(c, pattern), name).otherwise(label)
    return label


def match_count(c: Column | str, rules: Rules) -> Column:
    """How many rules match; 1 is a confident label, more is an ambiguous one."""
    total = F.lit(0)
    for _, pattern in rules:
        total = total + F.coalesce(any_match(c, pattern).cast("int"), F.lit(0))
    return total


def confidence(c: Column | str, rules: Rules) -> Column:
    hits = match_count(c, rules)
    return F.when(hits == 1, "HIGH").when(hits > 1, "LOW").otherwise("NONE")
