"""Lenient parsing: a value that does not parse becomes null, it never fails the job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import as_col, strip

AMOUNT_TYPE = "decimal(20,4)"


def number(c: Column | str) -> Column:
    """Text to double.  Java's ``1d``/``1f`` spellings are refused and NaN counts as absent."""
    text = strip(c)
    parsed = F.when(~F.right(text, F.lit(1)).isin("d", "D", "f", "F"), text.try_cast("double"))
    return F.nanvl(parsed, F.lit(None).cast("double"))


def amount(c: Column | str) -> Column:
    """Money text to a decimal, thousands separators dropped, failures as zero.

    Decimals keep sums independent of the order partitions arrive in.
    """
    text = F.replace(strip(c), F.lit(","), F.lit(""))
    return F.coalesce(text.try_cast(AMOUNT_TYPE), F.lit(0).cast(AMOUNT_TYPE))


# The accepted date shapes and what reads them.  In a picture every
# digit is a 9; a date and time is recognised by its first 16 characters.
DATE_SHAPES = [
    ("YYYY-MM-DD", ["9999-99-99"], None),
    ("M/D/YYYY", ["9/9/9999", "9/99/9999", "99/9/9999", "99/99/9999"], "M/d/yyyy"),
    ("M/D/YY", ["9/9/99", "9/99/99", "99/9/99", "99/99/99"], "two-digit"),
    ("YYYYMMDD", ["99999999"], "yyyyMMdd"),
    ("YYYY/MM/DD", ["9999/99/99"], "yyyy/MM/dd"),
    ("M-D-YYYY", ["9-9-9999", "9-99-9999", "99-9-9999", "99-99-9999"], "M-d-yyyy"),
    ("ISO datetime", ["9999-99-99T99:99", "9999-99-99 99:99"], None),
]


def date_shape(c: Column | str) -> Column:
    """Label of the date shape the trimmed text has, else null.

    One character translation and one lookup instead of a regular expression per shape.
    """
    picture = F.translate(F.left(strip(c), F.lit(16)), "012345678", "9" * 9)
    known = [F.lit(x) for label, pictures, _ in DATE_SHAPES for p in pictures for x in (p, label)]
    return F.try_element_at(F.create_map(*known), picture)


def moment_of(text: Column, shape: Column) -> Column:
    """Trimmed text of a known shape to timestamp; month comes before day."""
    head, tail = F.regexp_extract(text, r"^(.*/)", 1), F.right(text, F.lit(2))
    century = F.when(tail >= "69", "19").otherwise("20")
    parsed = F.when(shape.isin("YYYY-MM-DD", "ISO datetime"), text.try_cast("timestamp"))
    for label, _, fmt in DATE_SHAPES:
        if fmt == "two-digit":
            parsed = parsed.when(shape == label, F.try_to_timestamp(F.concat(head, century, tail), F.lit("M/d/yyyy")))
        elif fmt:
            parsed = parsed.when(shape == label, F.try_to_timestamp(text, F.lit(fmt)))
    return parsed


def moment(c: Column | str) -> Column:
    """Text to timestamp over the accepted shapes."""
    return moment_of(strip(c), date_shape(c))


def day(c: Column | str) -> Column:
    return moment(c).cast("date")


def day_form(c: Column | str) -> Column:
    """A text of the same day: of an ISO date and time only the date, everything else as it came.

    It costs a fraction of :func:`day`, which may then read each different text once.
    """
    c = as_col(c).cast("string")
    stamped = (F.length(c) > 10) & c.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d")
    date = c.try_cast("timestamp").cast("date").cast("string")
    return F.when(stamped, F.coalesce(F.when(F.length(date) == 10, date), c)).otherwise(c)


def year_month(c: Column | str) -> Column:
    """Date or timestamp column to an integer YYYYMM."""
    c = as_col(c)
    return F.year(c) * 100 + F.month(c)


def month_label(ym: Column) -> Column:
    """Integer YYYYMM to ``YYYY-MM``."""
    return F.format_string("%04d-%02d", F.floor(ym / 100).cast("int"), F.pmod(ym.cast("int"), F.lit(100)))


def month_bounds(month: str) -> tuple[Column, Column]:
    """First and last day of a ``YYYY-MM`` month."""
    first = F.to_date(F.lit(f"{month}-01"))
    return first, F.last_day(first)


def billing_window(month: str) -> tuple[Column, Column]:
    """The 15th of the month before to the 14th of the month."""
    first = F.to_date(F.lit(f"{month}-01"))
    return F.date_add(F.add_months(first, -1), 14), F.date_add(first, 13)
