"""Column helpers: text, lenient parsing, classification, formulas, similarity."""

from .text import (  # noqa: F401
    as_col, digits_number, header_key, key, missing, pad_code, present, source_key, strip, strip_zeros,
)
from .parse import amount, day, day_form, moment, number, year_month  # noqa: F401
from .classify import any_match, classify, match_count  # noqa: F401
