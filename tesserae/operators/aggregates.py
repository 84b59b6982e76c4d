"""Aggregations: time series, histograms, statistics, percentiles, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.geometry import TWO_PI


def time_series(df: DataFrame, start: float, end: float, interval: float, when: str = "t") -> DataFrame:
    """Rows by interval since the start; empty intervals are absent."""
    at = F.floor((F.col(when) - F.lit(start)) / F.lit(interval)).cast("long")
    return df.where(F.col(when).between(start, end)).groupBy(at.alias("interval")).agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"), F.max("node_id").alias("last_id"))


def time_series_ids(df: DataFrame, start: float, end: float, interval: float, when: str = "t") -> DataFrame:
    """Ids by interval, for intervals that are known to be small."""
    at = F.floor((F.col(when) - F.lit(start)) / F.lit(interval)).cast("long")
    return df.where(F.col(when).between(start, end)).groupBy(at.alias("interval")).agg(F.sort_array(F.collect_set("node_id")).alias("ids"))


def bucket_histogram(df: DataFrame, size: float, when: str = "t") -> DataFrame:
    return df.groupBy(F.floor(F.col(when) / F.lit(size)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, size: float, when: str = "t") -> DataFrame:
    """One row: rows, buckets, and the buckets' largest and mean counts."""
    return bucket_histogram(df, size, when).agg(F.sum("n").alias("rows"), F.count("*").alias("buckets"), F.max("n").alias("largest"), F.avg("n").alias("mean"))


def angular_histogram(spark: SparkSession, df: DataFrame, segments: int = 12) -> DataFrame:
    """Rows by segment of the circle, with zeros."""
    at = (F.floor(F.col("angle") / F.lit(360.0 / segments)) % segments).cast("int")
    counts = df.groupBy(at.alias("segment")).agg(F.count("*").alias("n"))
    return spark.range(segments).select(F.col("id").cast("int").alias("segment")).join(counts, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"))


def balanced_angle(spark: SparkSession, df: DataFrame, segments: int = 12) -> DataFrame:
    """The middle of the emptiest segment, the lowest of equals."""
    best = angular_histogram(spark, df, segments).agg(F.min_by("segment", F.struct("n", "segment")).alias("segment"))
    return best.select("segment", ((F.col("segment") + 0.5) * F.lit(360.0 / segments)).alias("angle"))


def timeline(df: DataFrame, bins: int, when: str = "time") -> DataFrame:
    """Rows by equal bins between the first and last time."""
    ends = df.agg(F.min(when).alias("lo"), F.max(when).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(when) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1))).otherwise(0)
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)).cast("int")
    return df.select(when).crossJoin(ends).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def node_statistics(chain: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row: counts, spans, distances, degrees, nodes with and without deltas."""
    own = chain.agg(F.count("*").alias("n_nodes"), F.min("time").alias("min_time"), F.max("time").alias("max_time"), (F.max("time") - F.min("time")).alias("time_span"), F.avg("distance").alias("avg_distance"), F.max("distance").alias("max_distance"), F.count_if(F.col("parent_id").isNotNull()).alias("n_deltas"))
    deg = degrees.agg(F.sum("degree").alias("sum_degree"), F.max("degree").alias("max_degree"))
    return own.crossJoin(deg).withColumn("avg_degree", F.col("sum_degree") / F.col("n_nodes")).drop("sum_degree")


def change_frequency(df: DataFrame, key: str, when: str, window: float) -> DataFrame:
    """``(key, window_start, n)``: windows close on the right and start anew by whole windows after a gap.

    The times of one key are folded in order within its row, so each key must have a history that fits one.
    """
    times = df.groupBy(key).agg(F.sort_array(F.collect_list(F.col(when))).alias("ts"))
    kind = "struct<cur:double,n:bigint,done:array<struct<window_start:double,n:bigint>>>"
    start = F.struct(F.element_at("ts", 1).alias("cur"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<window_start:double,n:bigint>>").alias("done")).cast(kind)
    size = F.lit(float(window))

    def step(acc: Column, t: Column) -> Column:
        inside = t <= acc["cur"] + size
        moved = acc["cur"] + F.floor((t - acc["cur"]) / size) * size
        return F.struct(
            F.when(inside, acc["cur"]).otherwise(moved).alias("cur"),
            F.when(inside, acc["n"] + 1).otherwise(F.lit(1).cast("bigint")).alias("n"),
            F.when(inside, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["cur"].alias("window_start"), acc["n"].alias("n"))))).alias("done"),
        ).cast(kind)

    folded = times.select(key, F.aggregate("ts", start, step).alias("a"))
    every = F.concat(F.col("a.done"), F.array(F.struct(F.col("a.cur").alias("window_start"), F.col("a.n").alias("n"))))
    return folded.select(key, F.explode(every).alias("w")).select(key, "w.window_start", "w.n")


def group_count(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Counts by keys with the total."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return out.withColumn("total", F.sum("n").over(Window.partitionBy()))


def by_period(df: DataFrame, unit: str, value: str, when: str = "ts") -> DataFrame:
    return df.groupBy(F.date_trunc(unit, when).cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def aggregate(df: DataFrame, group_by: list, aggregates: dict[str, Column], how: str = "groupBy") -> DataFrame:
    """Any keys and aggregates; ``how`` may be ``rollup`` or ``cube``."""
    return getattr(df, how)(*group_by).agg(*[c.alias(n) for n, c in aggregates.items()])


def compare_contexts(df: DataFrame, entity: str, context: str, contexts: list, value: str) -> DataFrame:
    """An entity's mean in each context, side by side."""
    return df.groupBy(entity).agg(*[F.avg(F.when(F.col(context) == c, F.col(value))).alias(f"mean_{c}") for c in contexts])


def cardinality(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def selectivity(df: DataFrame, column: str, value) -> DataFrame:
    """Share of rows with a value; a half where nothing is known."""
    return df.agg(F.coalesce(F.avg((F.col(column) == value).cast("double")), F.lit(0.5)).alias("selectivity"))


def exclusive_percentile(values: Column, percent: float) -> Column:
    """Of a sorted array: quantiles that leave out the ends, extrapolating like them; a single value stands for all."""
    n = F.size(values)
    at = F.lit(percent) * (n + 1) / 100.0
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(at).cast("int")))
    low, high = F.element_at(values, j), F.element_at(values, j + 1)
    return F.when(n == 0, 0.0).when(n == 1, F.element_at(values, 1)).otherwise(low + (high - low) * (at - j))


def percentile_of(df: DataFrame, column: str, percent: float, *keys: str) -> DataFrame:
    """Exact exclusive percentile: equal values are counted before the shuffle, and running sums over the counts give the
    two neighbours of the rank."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("c").over(w))
    at = F.lit(float(percent)) * (F.col("n") + 1) / 100.0
    j = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(at).cast("int")))
    near = ranked.withColumn("at", at).withColumn("j", j).where("j <= upto and j + 1 > upto - c")
    pair = near.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.first("at").alias("at"), F.first("j").alias("j"))
    return pair.select(*keys, (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.col("j"))).alias("percentile"))


def query_summary(log: DataFrame) -> DataFrame:
    """By query type: count, mean, least and most milliseconds, the 90th percentile, mean result size."""
    base = log.groupBy("query_type").agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.avg("size").alias("avg_size"))
    return base.join(percentile_of(log, "ms", 90, "query_type"), "query_type").withColumnRenamed("percentile", "p90_ms")


def hit_ratio(log: DataFrame, key: str, hit: Column) -> DataFrame:
    return log.groupBy(key).agg(F.avg(hit.cast("double")).alias("hit_ratio"))


def estimate(log: DataFrame, column: str, default: float) -> DataFrame:
    """The 75th percentile of a query type's past, or a default where there is none."""
    return percentile_of(log, column, 75, "query_type").withColumn("estimate", F.coalesce("percentile", F.lit(float(default)))).drop("percentile")


def term_counts(df: DataFrame, key: str, text: str, min_length: int = 3, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """``(key, term, n, first)``: how often a term is in a row's text, and where it stands first."""
    split = df.select(key, F.posexplode(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")).alias("pos", "term"))
    kept = split.where(F.length("term") >= min_length)
    if stop_words:
        kept = kept.where(~F.col("term").isin(list(stop_words)))
    return kept.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def top_terms(df: DataFrame, key: str, text: str, k: int = 5, min_length: int = 3, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent terms; of equals the one that comes first."""
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first", "term")
    return term_counts(df, key, text, min_length, stop_words).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "term", "n")


def equal_bins(df: DataFrame, column: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """A histogram of equal bins; the last one holds its upper end."""
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / ((high - low) / bins))).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def bounding_box(df: DataFrame) -> DataFrame:
    """The smallest box around all positions; of angles, the arc that leaves out the largest gap."""
    ends = df.agg(F.min("time").alias("t_lo"), F.max("time").alias("t_hi"), F.min("distance").alias("r_lo"), F.max("distance").alias("r_hi"))
    angles = df.select("theta").distinct()
    w = Window.orderBy("theta")
    gaps = angles.withColumn("before", F.lag("theta").over(w)).crossJoin(angles.agg(F.max("theta").alias("last"), F.count("*").alias("n")))
    gap = F.when(F.col("before").isNull(), F.col("theta") - F.col("last") + TWO_PI).otherwise(F.col("theta") - F.col("before"))
    gaps = gaps.withColumn("hi", F.coalesce("before", "last")).withColumn("gap", F.when(F.col("n") > 1, F.round(gap, 9)).otherwise(0.0))
    arc = gaps.agg(F.max_by(F.struct("theta", "hi"), F.struct(F.col("gap"), -F.col("theta"))).alias("arc"))
    return ends.crossJoin(arc.select(F.col("arc.theta").alias("theta_lo"), F.col("arc.hi").alias("theta_hi")))


def mean_position(df: DataFrame, *keys: str) -> DataFrame:
    """Circular mean of positions: averaged in the plane, back in polar coordinates (degrees), the latest time and one more."""
    flat = df.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.max("time").alias("last"))
    angle = F.degrees(F.atan2("my", "mx"))
    return flat.select(*keys, (F.col("last") + 1.0).alias("time"), F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2).alias("distance"), F.when(angle < 0, angle + 360.0).otherwise(angle).alias("angle"))


def describe(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Least, most, mean, median, 95th and 99th percentile, deviation."""
    p = [F.percentile(column, q).alias(n) for n, q in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), *p, F.stddev_samp(column).alias("stddev"))

