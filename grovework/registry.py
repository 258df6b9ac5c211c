"""Names, Spark queries and oracle SQL of the retrieval operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grovework.plans.queries import ORACLES, QUERIES

FLAGSHIP = "i03_collapsed_tree"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
