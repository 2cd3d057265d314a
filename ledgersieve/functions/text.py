"""Text helpers shared by every check."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\f\x0b"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of whitespace; the built-in ``trim`` only knows blanks."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def missing(c: Column | str) -> Column:
    """Null or whitespace only.  Never null itself."""
    return F.coalesce(strip(c) == "", F.lit(True))


def present(c: Column | str) -> Column:
    return ~missing(c)


def key(c: Column | str) -> Column:
    """Join key form of a name or id: trimmed, lower case."""
    return F.lower(strip(c))


def header_key(c: Column | str) -> Column:
    """Header form used by mapping and coverage."""
    return F.lower(F.regexp_replace(as_col(c), r"[\s_\-/.()#]", ""))


def source_key(c: Column | str) -> Column:
    """Weaker header form used by source detection."""
    return F.lower(F.regexp_replace(as_col(c), r"[\s_\-]", ""))


def strip_zeros(c: Column | str) -> Column:
    """Drop leading zeros; an all-zero or empty value becomes ``0``."""
    bare = F.ltrim(as_col(c), F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def pad_code(c: Column | str, width: int = 2) -> Column:
    """Zero-fill on the left without ever cutting (``lpad`` would truncate)."""
    c = strip(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def digits_number(c: Column | str) -> Column:
    """The digits of a code read as one number; null when there are none."""
    return F.regexp_replace(as_col(c), r"\D", "").try_cast("double")
