"""Registered queries of the operators that work on texts in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersieve.llm import decontaminate, html, language, repeats, simhash, toxicity
from ledgersieve.llm.common import table
from ledgersieve.llm.registered import query

_LEAKS_SQL = r"""
WITH lower_d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), lower_b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM lower_b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lower_d, (SELECT DISTINCT k FROM win))
), hit AS (
  SELECT doc_id, pos.k, i, item_id FROM pos JOIN win USING (k, g)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM lower_d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_decontamination", _LEAKS_SQL)
def benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = decontaminate.match(docs, table(spark, folder, "benchmark", "item_id", "text"))
    n_hit = decontaminate.n_hit()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query("op3_simhash")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.components(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op2_language_mixture")
def language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = language.fold(F.col("doc_id"), 4) == 2
    model = language.fit(docs.filter(~held_out))
    found = language.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares")


@query("op8_toxicity")
def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    held_out = language.fold(F.col("doc_id"), 5) == 0
    labels = table(spark, folder, "labels", "doc_id", "toxic").filter(~held_out)
    return toxicity.scored(docs, toxicity.fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op7_html")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return html.extracted(table(spark, folder, "pages", "page_id", "url", "html"))


@query("op5_repeated_strings")
def repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    # Texts go to Python three times; batches of fewer rows keep what the JVM holds outside its heap small.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return repeats.deduplicated(table(spark, folder, "documents", "doc_id", "text"), with_kept=False)
