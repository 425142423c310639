"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ("lexical", "vectors", "graph", "matching", "text", "quality", "search", "feeds", "chains", "recommend")

_RANKED = "profile_search reranked_reasons bm25_filtered bm25_topk bm25_normalized bm25_page bm25_multifield more_like_this cosine_topk cosine_subset_rank skill_hops1 skill_hops2 graph_text_match applications_latest recommendations rerank_six_factor keyword_rerank fusion_rank label_pool structured_filter_page hybrid_search"
#: Columns whose type DuckDB would give otherwise: its window numbers have 64 bits, its plain
#: fractions are decimals.
TYPES = {name: {"rank": "INTEGER"} for name in _RANKED.split()} | {
    "fuzzy_vocab": {"distance": "INTEGER"},
    "rank_texts": {"rank": "INTEGER"},
    "candidate_rerank": {"rank": "INTEGER"},
    "text_search": {"rank": "INTEGER"},
    "search_chain": {"rank": "INTEGER"},
    "multi_get": {"pos": "INTEGER"},
    "candidate_union": {"position": "INTEGER"},
    "pool_report": {"best": "INTEGER", "last": "INTEGER"},
    "match_score": {"location": "DOUBLE", "salary": "DOUBLE", "visa": "DOUBLE"},
    "rerank_six_factor": {"rank": "INTEGER", "experience": "DOUBLE", "location": "DOUBLE", "salary": "DOUBLE", "company": "DOUBLE"},
}


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {k: v for name in PLANS for k, v in import_module(f"matchweave.plans.{name}").QUERIES.items()}


def _typed(name: str, sql: str) -> str:
    if name not in TYPES:
        return sql
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in TYPES[name].items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) AS typed"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: _typed(k, sql) for k, (_, sql) in _all().items() if sql}
