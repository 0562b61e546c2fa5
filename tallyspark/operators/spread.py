"""Dealing rows out to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` to as many tasks as the session shuffles to, few bytes or many.

    Adaptive execution merges partitions by their bytes, which for small rows with
    dear expressions on them leaves a task or two. Branches that start from the same
    dealt rows share the exchange.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
