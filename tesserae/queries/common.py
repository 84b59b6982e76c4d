"""What the query modules share: registering, rounding, and the canonical views as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

NODES = """nodes AS (
    SELECT event_id AS node_id, user_id, ts, epoch_us(ts) / 1e6 AS t, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS time,
           value / 100.0 AS distance, CAST((user_id * 37) % 360 AS DOUBLE) AS angle, radians(CAST((user_id * 37) % 360 AS DOUBLE)) AS theta,
           value / 100.0 * cos(radians(CAST((user_id * 37) % 360 AS DOUBLE))) AS x,
           value / 100.0 * sin(radians(CAST((user_id * 37) % 360 AS DOUBLE))) AS y,
           event_type AS node_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value
    FROM events)"""
CHAIN = (
    NODES
    + """, chain AS (
    SELECT *, lag(node_id) OVER (PARTITION BY user_id ORDER BY ts, node_id) AS parent_id,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, node_id) AS seq
    FROM nodes)"""
)
EDGES = (
    CHAIN
    + """, edges AS (
    SELECT node_id AS src, parent_id AS dst, node_type AS type, k / 100.0 AS strength FROM chain WHERE parent_id IS NOT NULL)"""
)
VERSIONS = """versions AS (
    SELECT o_custkey AS node_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
           o_orderkey, o_orderdate, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority
    FROM orders)"""
FACTS = """facts AS (
    SELECT c_custkey AS fact_id, c_nationkey AS topic_id, c_name AS fact,
           least(1.0::DOUBLE, greatest(0.0::DOUBLE, (c_acctbal + 1000.0) / 11000.0)) AS confidence, c_mktsegment AS segment
    FROM customer)"""
VECTORS = "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS dims, label FROM embeddings)"


class Registry(dict):
    """name -> (query, SQL)."""

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self[name] = (query, sql)
            return query

        return keep


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)
