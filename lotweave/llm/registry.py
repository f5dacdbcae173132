"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from lotweave.llm import bpe, decontaminate, exact_dedup, jaccard_join, language, line_dedup, lm_score, quality, secrets, toxicity

MODULES = [bpe, secrets, lm_score, decontaminate, quality, language, line_dedup, exact_dedup, jaccard_join, toxicity]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
