"""Every query of the engine with the DuckDB SQL that says the same.

Queries run over whole tables. Numbers that come from sines, roots or means are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.queries import aggregation, deltas, each, filters, graphs, ordered, storage

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (filters, ordered, aggregation, deltas, graphs, storage, each)


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.QUERIES["g07_knowledge_traversal"][0](spark, sf_dir)
