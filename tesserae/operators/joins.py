"""Joins and set operations on id-keyed tables. Sides are never hinted: Spark broadcasts one only by its measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inner_join(left: DataFrame, right: DataFrame, key: str = "node_id") -> DataFrame:
    """Rows of the right side whose id the left side has."""
    return right.join(left.select(key).distinct(), key, "left_semi")


def intersection(left: DataFrame, right: DataFrame, key: str = "node_id") -> DataFrame:
    return inner_join(left, right, key)


def union(left: DataFrame, right: DataFrame, key: str = "node_id") -> DataFrame:
    """All rows of the left side, and those of the right whose id it lacks."""
    return left.unionByName(right.join(left.select(key), key, "left_anti"))


def difference(left: DataFrame, right: DataFrame, key: str = "node_id") -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def outer_join(left: DataFrame, right: DataFrame, key: str = "node_id", how: str = "left") -> DataFrame:
    return left.join(right, key, how)


def connected_nodes(edges: DataFrame, nodes: DataFrame, type_: str | None = None, direction: str = "outgoing") -> DataFrame:
    """``(src, node...)``: what each node is joined to; ``both`` also follows edges backwards."""
    edges = edges if type_ is None else edges.where(F.col("type") == type_)
    ahead = edges.select(F.col("src").alias("from_id"), F.col("dst").alias("node_id"), "type")
    back = edges.select(F.col("dst").alias("from_id"), F.col("src").alias("node_id"), "type")
    made = {"outgoing": ahead, "incoming": back, "both": ahead.union(back).distinct()}[direction]
    return made.join(nodes, "node_id")


def parents(chain: DataFrame) -> DataFrame:
    """Rows with the time and kind of the row they changed, if any."""
    up = chain.select(F.col("node_id").alias("parent_id"), F.col("time").alias("parent_time"), F.col("node_type").alias("parent_type"))
    return chain.join(up, "parent_id", "left")


def referring(nodes: DataFrame, references: str = "delta_references", key: str = "node_id") -> DataFrame:
    """``(node_id, referred_by)`` from arrays of references."""
    return nodes.select(F.col(key).alias("referred_by"), F.explode(references).alias(key))


def as_of_join(probes: DataFrame, states: DataFrame, key: str, when: str, value: str, probe_id: str) -> DataFrame:
    """For each probe the last state of its key not after it: one shuffle by key, one sorted pass."""
    a = states.select(key, F.col(when).alias("at"), F.lit(0).alias("side"), F.col(value).alias("value"), F.lit(None).cast(probes.schema[probe_id].dataType).alias("probe"))
    b = probes.select(key, F.col(when).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(states.schema[value].dataType).alias("value"), F.col(probe_id).alias("probe"))
    w = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn("state", F.last("value", ignorenulls=True).over(w)).where("side = 1").select(key, F.col("probe").alias(probe_id), F.col("at").alias(when), "state")


def interval_join(intervals: DataFrame, points: DataFrame, key: str, bucket: float, when: str = "t") -> DataFrame:
    """Points of the same key in ``(start, end]``: buckets of time are the key, the bounds are checked after it."""
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket).cast("long"), F.floor(F.col("end") / bucket).cast("long"))))
    placed = points.withColumn("_b", F.floor(F.col(when) / bucket).cast("long"))
    return spread.join(placed, [key, "_b"]).where((F.col(when) > F.col("start")) & (F.col(when) <= F.col("end"))).drop("_b")


def shared_values(df: DataFrame, key: str, values: str) -> DataFrame:
    """``(key, other, shared)``: how many values two rows have in common."""
    spread = df.select(key, F.explode(F.array_distinct(values)).alias("v"))
    other = spread.select(F.col(key).alias("other"), "v")
    # each pair meets once and is turned round after it is counted
    once = spread.join(other, "v").where(F.col(key) < F.col("other")).groupBy(key, "other").agg(F.count("*").alias("shared"))
    return once.unionByName(once.select(F.col("other").alias(key), F.col(key).alias("other"), "shared"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def added_removed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``(key, change)`` at the level of sets."""
    a = new.select(key).exceptAll(old.select(key)).withColumn("change", F.lit("added"))
    return a.unionByName(old.select(key).exceptAll(new.select(key)).withColumn("change", F.lit("removed")))
