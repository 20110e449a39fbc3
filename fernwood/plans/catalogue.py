"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernwood.plans import canonical_queries, evidence_queries, lookup_queries, record_queries, search_queries, stream_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (search_queries, text_queries, record_queries, evidence_queries, lookup_queries, stream_queries, canonical_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid evidence search."""
    return search_queries.hybrid_search(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
