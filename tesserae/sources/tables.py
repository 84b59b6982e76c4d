"""Canonical views over the test tables: nodes, edges, deltas, versions, facts, messages, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START_MICROS = 1704067200000000  # 2024-01-01
BUCKET_SECONDS = 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nodes of a cylinder: hours since the start, value over 100, an angle by user."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    angle = F.pmod(F.col("user_id") * 37, F.lit(360)).cast("double")
    distance = F.col("value") / 100.0
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("node_id"),
        "user_id",
        "ts",
        (micros / 1e6).alias("t"),
        ((micros - START_MICROS) / 3.6e9).alias("time"),
        distance.alias("distance"),
        angle.alias("angle"),
        F.radians(angle).alias("theta"),
        (distance * F.cos(F.radians(angle))).alias("x"),
        (distance * F.sin(F.radians(angle))).alias("y"),
        F.col("event_type").alias("node_type"),
        k.alias("k"),
        F.create_map(F.col("event_type"), F.col("value").cast("string")).alias("content"),
        F.floor(micros / 1e6 / BUCKET_SECONDS).cast("long").alias("t_bucket"),
    )


def chain(nodes_: DataFrame) -> DataFrame:
    """Deltas: each user's nodes in order; a node changes the one before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "node_id")
    return nodes_.withColumn("parent_id", F.lag("node_id").over(w)).withColumn("seq", F.row_number().over(w).cast("long"))


def edges(nodes_: DataFrame) -> DataFrame:
    """Directed edges from a node to the one before it, with its type and a strength."""
    made = chain(nodes_).where("parent_id is not null")
    return made.select(F.col("node_id").alias("src"), F.col("parent_id").alias("dst"), F.col("node_type").alias("type"), (F.col("k") / 100.0).alias("strength"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"), F.row_number().over(w).cast("long").alias("version"), "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("domain_id"), F.col("r_name").alias("domain"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("topic"), F.col("n_regionkey").alias("domain_id"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("c_acctbal") + 1000.0) / 11000.0))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fact_id"), F.col("c_nationkey").alias("topic_id"), F.col("c_name").alias("fact"), confidence.alias("confidence"), F.col("c_mktsegment").alias("segment"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("dims"), "label")
