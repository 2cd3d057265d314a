"""Registered queries of the reader: lines made from whole tables, parsed and cleaned as files are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import extracts
from . import bindings as b
from .registered import query

_COLUMNS = ("id", "status", "price", "priority", "note")
# What a line is like follows from the order's key; footers also stand in the middle, where they must stay.
_KINDS = [(97, "long"), (89, "blank"), (83, "short"), (79, "quoted"), (73, "garbled"), (71, "open"), (61, "footer"), (59, "piped")]
_KIND_SQL = "CASE " + " ".join(f"WHEN o_orderkey % {n} = 0 THEN '{kind}'" for n, kind in _KINDS) + " ELSE 'plain' END"


def _lines(spark, folder) -> DataFrame:
    orders = b.table(spark, folder, "orders")
    key, base = b.text("o_orderkey"), F.concat_ws("|", b.text("o_orderkey"), "o_orderstatus", b.text(b.cents("o_totalprice")), "o_orderpriority")
    shapes = {
        "long": F.concat(base, F.lit("||x|y")), "blank": F.lit(" | ||  |"), "short": F.concat_ws("|", key, "o_orderstatus"),
        "quoted": F.concat(base, F.lit('|"one, two"')), "garbled": F.concat(F.lit("Ã©"), base, F.lit("|")), "open": F.concat(base, F.lit('|"open')),
        "footer": F.lit("Grand Total||||"), "piped": F.concat(base, F.lit('|"a|b"')),
    }
    value = F.concat(base, F.lit("|"))
    kind = F.expr(_KIND_SQL)
    for name, shape in shapes.items():
        value = F.when(kind == name, shape).otherwise(value)
    body = orders.select(value.alias("value"), F.lit(0).cast("bigint").alias("__block"), F.col("o_orderkey").alias("__row"))
    ends = orders.agg(F.max("o_orderkey").alias("k")).select(
        F.explode(F.array(F.lit("TOTAL||||"), F.lit("||||"), F.lit(" eof ||||"))).alias("value"), F.lit(1).cast("bigint").alias("__block"), F.col("k").alias("__row")
    )
    return body.unionByName(ends)


_CTE = f"""WITH o AS (SELECT *, {_KIND_SQL} AS kind FROM orders),
p AS (SELECT max(o_orderkey) FILTER (kind NOT IN ('long', 'blank', 'footer')) AS last FROM o)"""


@query("reader_facts", f"""{_CTE} SELECT count(*) FILTER (kind = 'long') AS bad, count(*) FILTER (kind = 'open') AS open_quotes,
 count(*) FILTER (kind NOT IN ('long', 'blank')) + 2 AS "rows", count(*) FILTER (kind = 'footer') + 2 AS footer_like,
 count(*) FILTER (kind = 'garbled') > 0 AS garbled, count(*) FILTER (kind = 'footer' AND o_orderkey > last) + 2 AS stripped,
 count(*) FILTER (kind NOT IN ('long', 'blank')) + 2 AS id_filled, count(*) FILTER (kind IN ('quoted', 'open', 'piped')) AS note_filled,
 count(*) FILTER (kind = 'piped') > 0 AS note_pipes FROM o, p""")
def reader_facts(spark, folder) -> DataFrame:
    parsed = extracts.parse_lines(_lines(spark, folder), "|", _COLUMNS)
    facts = extracts.line_facts(parsed, "|", _COLUMNS)
    kept = extracts.clean_rows(parsed, "|", _COLUMNS, facts).agg(F.count("*").alias("kept"))
    return facts.join(kept).select(
        "bad", "open_quotes", "rows", "footer_like", "garbled", (F.col("rows") - F.col("kept")).alias("stripped"),
        F.get("filled", F.lit(0)).alias("id_filled"), F.get("filled", F.lit(4)).alias("note_filled"), F.get("pipes", F.lit(4)).alias("note_pipes"),
    )


@query("reader_rows", f"""{_CTE} SELECT
 CASE WHEN kind = 'footer' THEN 'Grand Total' WHEN kind = 'garbled' THEN 'Ã©' ELSE '' END || CASE WHEN kind = 'footer' THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS id,
 CASE WHEN kind <> 'footer' THEN o_orderstatus END AS status,
 CASE WHEN kind NOT IN ('footer', 'short') THEN CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS VARCHAR) END AS price,
 CASE WHEN kind NOT IN ('footer', 'short') THEN o_orderpriority END AS priority,
 CASE kind WHEN 'quoted' THEN 'one, two' WHEN 'open' THEN 'open' WHEN 'piped' THEN 'a|b' END AS note
 FROM o, p WHERE kind NOT IN ('long', 'blank') AND NOT (kind = 'footer' AND o_orderkey > last)""")
def reader_rows(spark, folder) -> DataFrame:
    parsed = extracts.parse_lines(_lines(spark, folder), "|", _COLUMNS)
    return extracts.clean_rows(parsed, "|", _COLUMNS, extracts.line_facts(parsed, "|", _COLUMNS)).select(*_COLUMNS)
