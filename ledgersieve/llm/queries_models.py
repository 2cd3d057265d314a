"""Registered queries of the infilling, whitening and language-model operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersieve.llm import infill, katz, language, whitening
from ledgersieve.llm.common import stored, table
from ledgersieve.llm.registered import query

_INFILL_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents
), k AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


@query("op13_infill", _INFILL_SQL)
def infilled(spark: SparkSession, folder: str) -> DataFrame:
    frames = stored(infill.framed(table(spark, folder, "documents", "doc_id", "text")), "frames")
    found = infill.digests(infill.arranged(frames, infill.Policy(seed=7, rate=100, spm=50, unit="line")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query("op11_whitening")
def whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.scaled(table(spark, folder, "embeddings", "vec_id", "embedding"))
    return whitening.whitened(rows, whitening.fit(rows, components=16))


@query("op12_katz")
def text_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = katz.scored(katz.fit(docs, train=language.fold(F.col("doc_id"), 10) != 0, order=2))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
