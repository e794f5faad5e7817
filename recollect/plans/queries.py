"""The registry of queries and of the SQL that checks them. Each part module holds ``QUERIES`` and ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.plans import data_queries, exchange_queries, log_queries, record_queries, store_queries

PARTS = (store_queries, log_queries, exchange_queries, record_queries, data_queries)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def all_oracle_sql() -> dict[str, str]:
    return {k: q for part in PARTS for k, q in part.ORACLE_SQL.items()}
