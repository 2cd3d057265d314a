"""All queries of this folder, with the pipeline."""

from __future__ import annotations

import corpus_pipeline
from ledgersieve.llm import queries_models, queries_rules, queries_text  # noqa: F401
from ledgersieve.llm.registered import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
