"""Column transform rules: one text formula over the column's own value ``x``.

Formulas are read by Spark's own SQL parser.  Four names get the rule language's
meaning through SQL functions, which Catalyst inlines: positions start at 1, and
a start, length or part that does not exist gives empty text, never an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SQL_FUNCTIONS = {
    "rule_substring": (
        "(x STRING, start INT, len INT) RETURNS STRING "
        "RETURN CASE WHEN start <= 0 OR len <= 0 THEN '' ELSE substr(x, start, len) END"
    ),
    "rule_split_part": (
        "(x STRING, delimiter STRING, part INT) RETURNS STRING "
        "RETURN CASE WHEN part <= 0 THEN '' ELSE split_part(x, delimiter, greatest(part, 1)) END"
    ),
    "rule_trim": r"(x STRING) RETURNS STRING RETURN btrim(x, ' \t\n\r\f\u000b')",
    "rule_position": "(needle STRING, x STRING) RETURNS INT RETURN locate(needle, x)",
}

# Rule language name -> Spark SQL name.
NAMES = {
    "LEFT": "left",
    "RIGHT": "right",
    "SUBSTRING": "rule_substring",
    "SPLIT_PART": "rule_split_part",
    "CHARINDEX": "rule_position",
    "LEN": "length",
    "TRIM": "rule_trim",
    "UPPER": "upper",
    "LOWER": "lower",
    "REPLACE": "replace",
}

_TOKEN = re.compile(r"'[^']*'|[A-Za-z_]\w*|\d+|\|\||[(),+\-]|\s+|.", re.S)
_EMPTY_SEARCH = re.compile(r"REPLACE\s*\([^']*''\s*,", re.I)


def install(spark: SparkSession) -> None:
    for name, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def to_sql(formula: str, column: str) -> str:
    """The formula as a Spark SQL expression over ``column``; ValueError if it uses anything else."""
    if _EMPTY_SEARCH.search(formula):
        raise ValueError(f"REPLACE needs a text to look for: {formula}")
    out, calls = [], 0
    for token in _TOKEN.findall(formula):
        if token[0] == "'" and len(token) > 1 or token.isdigit() or token.isspace() or token in ("||", "(", ")", ",", "+", "-"):
            out.append(token.replace("\\", "\\\\") if token[0] == "'" else token)
        elif token.lower() == "x":
            out.append(f"`{column}`")
        elif token.upper() in NAMES:
            calls += 1
            out.append(NAMES[token.upper()])
        else:
            raise ValueError(f"unsupported in a formula: {token!r} in {formula}")
    if not calls:
        raise ValueError(f"no function in formula: {formula}")
    return "".join(out)


def expression(formula: str, column: str) -> Column:
    """Column for one rule; call :func:`install` on the session first."""
    return F.expr(to_sql(formula, column)).cast("string")


def is_valid(spark: SparkSession, formula: str) -> bool:
    """Known functions only, and an expression Spark can analyse."""
    from pyspark.errors import AnalysisException, ParseException

    install(spark)
    try:
        spark.range(0).selectExpr("'' AS x").select(expression(formula, "x")).schema
    except (ValueError, AnalysisException, ParseException):
        return False
    return True


def apply_transforms(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Overwrite staging columns by their rules, in order; rules on absent columns are passed over."""
    install(df.sparkSession)
    for column, formula in rules:
        if column in df.columns:
            text = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))
            df = text.withColumn(column, expression(formula, column))
    return df
