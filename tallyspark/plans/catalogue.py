"""The driver's query catalogue: name -> query, name -> DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chain_queries, job_queries, scalar_queries, stream_queries

MODULES = (chain_queries, scalar_queries, job_queries, stream_queries)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger, three reads, row and field votes, reconciliation and a verdict for each customer."""
    return chain_queries.verdict(spark, sf_dir)
