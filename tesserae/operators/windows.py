"""Ordered analytics: chains, running counts, gaps, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linked_messages(messages: DataFrame) -> DataFrame:
    """Each message with the one before it, and its place on a spiral."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    index = F.row_number().over(w) - 1
    return messages.withColumn("index", index).withColumn("previous", F.lag("turn").over(w)).withColumn("distance", F.lit(0.2) + F.lit(0.05) * F.col("index")).withColumn("angle", ((F.col("index") * 30) % 360).cast("double"))


def running_count(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("running", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def latest_delta(chain: DataFrame, key: str = "user_id") -> DataFrame:
    """The last delta of each key: a maximum, so nothing is sorted."""
    return chain.groupBy(key).agg(F.max_by(F.struct("node_id", "time", "node_type"), F.struct("t", "node_id")).alias("d")).select(key, "d.*")


def velocity(chain: DataFrame, key: str = "user_id", when: str = "time") -> DataFrame:
    """1 / (1 + mean gap) of each chain; 0 for a single row."""
    gap = F.abs(F.col(when) - F.lag(when).over(Window.partitionBy(key).orderBy("t", "node_id")))
    gaps = chain.select(key, "t", "node_id", when).withColumn("gap", gap)
    return gaps.groupBy(key).agg(F.coalesce(1.0 / (1.0 + F.avg("gap")), F.lit(0.0)).alias("velocity"))


def significant(chain: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Evenly spaced rows of a history, the last among them; all where there are no more than ``most``."""
    w = Window.partitionBy(key)
    placed = chain.withColumn("i", F.row_number().over(w.orderBy("t", "node_id")) - 1).withColumn("n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 2)), lambda k: F.floor(k * F.col("n") / F.lit(float(most - 1))).cast("int"))
    return placed.where((F.col("n") <= most) | (F.col("i") == F.col("n") - 1) | F.array_contains(wanted, F.col("i"))).drop("i", "n")


def keep_latest(versions: DataFrame, n: int, key: str = "node_id", version: str = "version") -> DataFrame:
    return versions.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where(F.col("_r") <= n).drop("_r")


def transitions(log: DataFrame, key: str, item: str, *order: str) -> DataFrame:
    """``(previous, next, n, p)``: how often one item follows another, and what share of what follows it."""
    before = F.lag(item).over(Window.partitionBy(key).orderBy(*order))
    counts = log.withColumn("previous", before).where("previous is not null").groupBy("previous", F.col(item).alias("next")).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("previous")))


def predicted_next(moves: DataFrame, linked: DataFrame, bonus: float = 0.5) -> DataFrame:
    """Transition shares, more for what is linked (``previous, next``), ranked."""
    both = moves.select("previous", "next", F.col("p").alias("s")).union(linked.select("previous", "next").distinct().withColumn("s", F.lit(bonus)))
    score = both.groupBy("previous", "next").agg(F.sum("s").alias("score"))
    return score.withColumn("rank", F.row_number().over(Window.partitionBy("previous").orderBy(F.desc(F.round("score", 9)), "next")))


def normalised(df: DataFrame, column: str) -> DataFrame:
    """The column between 0 and 1; its ends are one row, joined to all."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.crossJoin(ends).withColumn("scaled", F.coalesce((F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))).drop("_lo", "_hi")


def last_of_each(log: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def numbered_versions(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
