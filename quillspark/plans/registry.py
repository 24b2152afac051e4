"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import advice, algorithms, analytics, answers, chats, collections, exports, flows, formulas, markup, pages, quality, reader, records, search, texts, upkeep

FAMILIES = [search, analytics, texts, collections, chats, quality, flows, records, reader, upkeep, exports, advice, pages, formulas, algorithms, answers, markup]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, (query, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence search over documents."""
    return search.bm25_top_documents(spark, sf_dir)
