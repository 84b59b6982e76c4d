"""Edges, neighbourhoods, traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import geometry
from tesserae.operators.delta import chain_closure
from tesserae.operators.search import nearest_nodes


def connect(edges: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ways for pairs ``(a, b)`` whose ends exist, each once."""
    known = nodes.select("node_id")
    real = pairs.join(known, pairs["a"] == known["node_id"], "left_semi").join(known, pairs["b"] == known["node_id"], "left_semi")
    made = real.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(real.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return edges.select("src", "dst").union(made).distinct()


def add_edges(edges: DataFrame, new: DataFrame, type_: str = "RELATED_TO") -> DataFrame:
    """Typed edges; a strength outside [0, 1] is an error."""
    checked = new.withColumn("strength", F.when(F.col("strength").between(0.0, 1.0), F.col("strength")).otherwise(F.raise_error(F.lit("strength is not within 0 and 1")).cast("double")))
    return edges.unionByName(checked.withColumn("type", F.coalesce("type", F.lit(type_)) if "type" in new.columns else F.lit(type_)).select("src", "dst", "type", "strength"))


def of_type(edges: DataFrame, type_: str) -> DataFrame:
    return edges.where(F.col("type") == type_)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without some nodes and every edge that touches them."""
    ids = gone.select("node_id")
    left = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_anti").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), left


def degrees(edges: DataFrame) -> DataFrame:
    """``(node_id, degree)`` over both ends."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id")))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def listed_connections(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the time and distance between their ends."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("time").alias("t1"), F.col("distance").alias("r1"), F.col("angle").alias("a1"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("time").alias("t2"), F.col("distance").alias("r2"), F.col("angle").alias("a2"))
    d = geometry.polar_distance("t1", "r1", "a1", "t2", "r2", "a2")
    return edges.join(a, "src").join(b, "dst").select("src", "dst", F.round(F.col("t2") - F.col("t1"), 6).alias("dt"), F.round(d, 6).alias("d"))


def traverse(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``(start, node_id, depth)`` within so many hops, following edges either way."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return chain_closure(both, starts, depth)


def contains_edges(topics: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges from domains to topics to facts."""
    a = topics.select(F.concat(F.lit("domain:"), "domain_id").alias("src"), F.concat(F.lit("topic:"), "topic_id").alias("dst"))
    b = facts.select(F.concat(F.lit("topic:"), "topic_id").alias("src"), F.concat(F.lit("fact:"), "fact_id").alias("dst"))
    return a.union(b).withColumn("type", F.lit("CONTAINS"))


def fact_network(contains: DataFrame, related: DataFrame) -> DataFrame:
    """Edges with the style they are drawn in."""
    return contains.select("src", "dst", F.lit("solid").alias("style")).union(related.select("src", "dst", F.lit("dashed").alias("style")))


def branch_candidates(nodes: DataFrame, edges: DataFrame, threshold: float, strength: float = 0.5, least: int = 5) -> DataFrame:
    """Far nodes with enough strong neighbours of their own branch."""
    far = nodes.where(F.col("distance") > threshold).select("node_id", "branch_id")
    strong = edges.where(F.col("strength") >= strength).select(F.col("src").alias("node_id"), F.col("dst").alias("other"))
    own = nodes.select(F.col("node_id").alias("other"), F.col("branch_id").alias("other_branch"))
    met = strong.join(far, "node_id").join(own, "other").where("branch_id = other_branch")
    return met.groupBy("node_id", "branch_id").agg(F.countDistinct("other").alias("satellites")).where(F.col("satellites") >= least)


def related_filter(nodes: DataFrame, edges: DataFrame, type_: str) -> DataFrame:
    """Nodes with an edge of a type at either end."""
    typed = of_type(edges, type_)
    return nodes.join(typed.select(F.col("src").alias("node_id")).union(typed.select(F.col("dst").alias("node_id"))), "node_id", "left_semi")


def knowledge_traversal(chain: DataFrame, edges: DataFrame, at: tuple[float, float, float], k: int, names: list[str], near: DataFrame | None = None) -> DataFrame:
    """The nearest nodes to a position, what they are linked to, and the latest change and state of what that belongs to.

    The k nearest are found with k rows a task and written; only histories that they lead to are sorted. ``near`` may
    give the nearest nodes if they are known.
    """
    from tesserae.operators.delta import running_states
    from tesserae.sources.store import written

    near = nearest_nodes(chain, *at, k=k) if near is None else near
    near = near.select(F.col("node_id").alias("near_id"), F.col("d"))
    linked = written(near.join(edges, near["near_id"] == edges["src"]).select("near_id", "d", F.col("dst").alias("node_id")), "linked")
    users = written(chain.join(linked.select("node_id"), "node_id", "left_semi").select("user_id").distinct(), "users")
    own = chain.join(users, "user_id", "left_semi")
    states = running_states(own, "user_id", ["t", "node_id"], names)
    at_node = states.select("node_id", "user_id", *[f"state_{n}" for n in names])
    last = own.groupBy("user_id").agg(F.max_by("node_id", F.struct("t", "node_id")).alias("last_id"))
    return linked.join(at_node, "node_id").join(last, "user_id").select("near_id", "d", "node_id", "user_id", "last_id", *[F.col(f"state_{n}").cast("double").alias(n) for n in names])
