"""Slices, windows, boxes and nearest neighbours over node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import geometry


def temporal_slice(df: DataFrame, time: float, tolerance: float = 0.01, column: str = "time") -> DataFrame:
    """Within a tolerance of a time, as a range that reaches the scan."""
    return df.where(F.col(column).between(time - tolerance, time + tolerance))


def radial_band(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.where(F.col("distance").between(low, high))


def angular_sector(df: DataFrame, low: float, high: float, wrap: bool = False) -> DataFrame:
    """Angles in degrees; without ``wrap`` a sector over 0 is empty."""
    angle = F.col("angle")
    return df.where((angle >= low) | (angle <= high) if wrap and low > high else angle.between(low, high))


def time_range(df: DataFrame, start, end, column: str = "t") -> DataFrame:
    return df.where(F.col(column).between(start, end))


def bucketed_range(df: DataFrame, start: float, end: float, size: float = 3600.0) -> DataFrame:
    """A time range that also bounds the bucket column, for tables partitioned by it."""
    return df.where(F.col("t_bucket").between(int(start // size), int(end // size)) & F.col("t").between(start, end))


def temporal_window(nodes: DataFrame, edges: DataFrame, start: float, end: float, column: str = "time") -> tuple[DataFrame, DataFrame]:
    """The nodes of a window and the edges with both ends in it."""
    kept = time_range(nodes, start, end, column)
    ids = kept.select("node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return kept, inside


def exactly_at(df: DataFrame, t: float, r: float, theta: float, slack: float = 1e-10) -> DataFrame:
    return df.where((F.abs(F.col("time") - t) <= slack) & (F.abs(F.col("distance") - r) <= slack) & (F.abs(F.col("theta") - theta) <= slack))


def in_box(df: DataFrame, box: geometry.Box) -> DataFrame:
    return df.where(box.contains("time", "distance", "theta"))


def in_shape(df: DataFrame, shape: dict) -> DataFrame:
    return df.where(geometry.in_shape("x", "y", shape))


def near_path(df: DataFrame, points: list[tuple[float, float]], radius: float) -> DataFrame:
    return df.where(geometry.near_path("x", "y", points, radius))


def multi_get(df: DataFrame, ids: list, column: str = "node_id") -> DataFrame:
    """A stated list of ids is a literal of the plan, so nothing is shuffled."""
    return df.where(F.col(column).isin(ids))


def by_distance(df: DataFrame, distance: Column, k: int, most: float | None = None, tie: str = "node_id") -> DataFrame:
    """The k rows nearest by a distance, rounded so that ties are the same everywhere; the plan keeps k rows a task."""
    out = df.withColumn("d", F.round(distance, 6))
    if most is not None:
        out = out.where(F.col("d") <= most)
    return out.orderBy("d", tie).limit(k)


def nearest_nodes(df: DataFrame, time: float, distance: float, angle: float, k: int = 10, but: int | None = None) -> DataFrame:
    out = df if but is None else df.where(F.col("node_id") != but)
    return by_distance(out, geometry.polar_distance("time", "distance", "angle", time, distance, angle), k)


def nearest_in_time(df: DataFrame, t: float, k: int = 10, most: float | None = None) -> DataFrame:
    return by_distance(df, F.abs(F.col("t") - t), k, most)


def nearest_vectors(df: DataFrame, point: list[float], k: int = 10, metric: str = "euclidean", most: float | None = None) -> DataFrame:
    return by_distance(df, geometry.metric_distance(F.col("dims"), F.array(*[F.lit(float(v)) for v in point]), metric), k, most, "vec_id")


def knn_join(queries: DataFrame, data: DataFrame, k: int, cell: float, columns: tuple[str, ...] = ("time", "x", "y"), max_rounds: int = 40) -> DataFrame:
    """The k nearest rows of ``data`` for every row of ``queries``, exact, without comparing all with all.

    Rows meet in grid cells: a query looks into its cell and all around it. Its k-th best is final if it is not farther
    than a cell is wide; for the others the cell is doubled. When cells cover the whole space, what is found is final.
    Each round writes what is settled and what is left, so plans stay short and lost executors lose nothing.
    """
    from tesserae.sources.store import written

    # the data are written once, narrow; each round reads them again
    data = written(data.select("node_id", *columns), "knn_data")
    spans = data.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    ends = queries.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    if spans[0] is None or ends[0] is None:
        return queries.limit(0).crossJoin(data.limit(0).select(F.col("node_id").alias("neighbour"))).select(F.col("node_id").alias("query_id"), "neighbour", F.lit(0.0).alias("d"), F.lit(0).alias("rank"))
    widest = max(max(spans[f"hi_{c}"], ends[f"hi_{c}"]) - min(spans[f"lo_{c}"], ends[f"lo_{c}"]) for c in columns)
    left, done = queries.select(F.col("node_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in columns]), None
    around = F.array(*[F.lit(o) for o in (-1, 0, 1)])
    for _ in range(max_rounds):
        final = cell > widest
        placed = data.select(F.col("node_id").alias("neighbour"), *columns, *[F.floor(F.col(c) / cell).alias(f"c_{c}") for c in columns])
        spread = left
        for c in columns:
            spread = spread.withColumn(f"o_{c}", F.explode(around)).withColumn(f"c_{c}", F.floor(F.col(f"q_{c}") / cell) + F.col(f"o_{c}")).drop(f"o_{c}")
        met = spread.join(placed, [f"c_{c}" for c in columns]).where("query_id <> neighbour")
        square = sum(((F.col(c) - F.col(f"q_{c}")) ** 2 for c in columns), F.lit(0.0))
        met = met.withColumn("d", F.round(F.sqrt(square), 6))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "neighbour"))
        best = written(met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "neighbour", "d", "rank"), "knn")
        settled = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("d").alias("far")).where(F.lit(final) | ((F.col("n") == k) & (F.col("far") < cell))).select("query_id")
        found = best.join(settled, "query_id", "left_semi")
        done = found if done is None else done.union(found)
        if final:
            break
        left = written(left.join(settled, "query_id", "left_anti"), "knn_left")
        if left.isEmpty():
            break
        cell *= 2
    return done


def box_join(left: DataFrame, right: DataFrame, cell: float, box: str = "box") -> DataFrame:
    """Pairs ``(left_id, right_id)`` whose boxes meet: cells of time are the key, the rest is checked after it."""

    def spread(df: DataFrame, side: str) -> DataFrame:
        first, last = (F.floor(F.col(box)[e] / cell).cast("long") for e in ("t_lo", "t_hi"))
        return df.select(F.col("id").alias(f"{side}_id"), F.col(box).alias(f"{side}_box"), first.alias(f"{side}_first"), F.explode(F.sequence(first, last)).alias("cell"))

    met = spread(left, "left").join(spread(right, "right"), "cell")
    # a pair may meet in many cells; it counts in the first they share
    once = F.col("cell") == F.greatest("left_first", "right_first")
    return met.where(once & geometry.box_intersects(F.col("left_box"), F.col("right_box"))).select("left_id", "right_id")


def incremental_nearest(df: DataFrame, distance: Column, max_results: int | None = None, max_distance: float | None = None, tie: str = "node_id") -> DataFrame:
    """Rows by distance with it as a column, to be read lazily: ``toLocalIterator`` fetches one sorted partition after
    the other, so whoever stops early has the rest neither sent nor kept."""
    out = df.withColumn("d", distance)
    if max_distance is not None:
        out = out.where(F.col("d") <= max_distance)
    out = out.orderBy("d", tie)
    return out if max_results is None else out.limit(max_results)
