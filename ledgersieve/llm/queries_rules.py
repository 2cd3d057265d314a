"""Registered queries of the operators written with built-in functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersieve.llm import mixing, pii, quality, secrets
from ledgersieve.llm.common import table
from ledgersieve.llm.registered import query

_QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM win, range(0, 3) AS t(k) WHERE n > 1 GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_kinds
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_lines - n_kinds, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)
), b AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END
    AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""


@query("op4_quality_rules", _QUALITY_SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.verdicts(quality.ledger(table(spark, folder, "documents", "doc_id", "text")), "strict-1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_bits",
    )


@query("op10_source_mix")
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents", "doc_id", "text", "source"))


def _span_sql(kind: str, place: int, pattern: str, keep: str) -> str:
    """Spans of one kind: the pieces between the matches and the matches give the places."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place, s AS start, s + length(m) AS "end"
  FROM (
    SELECT doc_id, found[i] AS m,
           CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (
      SELECT doc_id, found, pieces, unnest(range(1, len(found) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS pieces
            FROM documents WHERE regexp_matches(text, '{p}'))
    )
  ) WHERE {keep}"""


def _secrets_sql() -> str:
    rules = secrets.RULES[secrets.CURRENT]
    parts = []
    for place, rule in enumerate(rules):
        p = rule.pattern.replace("'", "''")
        measured = f"regexp_extract(m, '{p}', {rule.group})" if rule.group else "m"
        parts.append(_span_sql(rule.kind, place, rule.pattern, f"length({measured}) >= {rule.least}"))
    base = "kind IN ('assign', 'access', 'hex')"
    text = "kind || ':' || start || ':' || \"end\""
    return f"""
WITH s AS ({' UNION ALL '.join(parts)}
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg({text}, ',' ORDER BY start, place) FILTER ({base}) AS base,
         string_agg({text}, ',' ORDER BY start, place) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""


@query("op9_secrets", _secrets_sql())
def secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = secrets.findings(docs, secrets.updated(docs))
    count = {k: F.size(secrets.of_kinds(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in secrets.BASE}
    base = secrets.listed(secrets.of_kinds(F.col("spans"), *secrets.BASE))
    return found.select(
        F.col("path").alias("doc_id"), *count.values(), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query("op6_surrogates")
def surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replaced(table(spark, folder, "documents", "doc_id", "text"), count_col="n_entities")
