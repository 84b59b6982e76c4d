"""Nearest neighbours, sorting, pages, windows over histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators import search, windows
from tesserae.plans.results import Result, sorted_by
from tesserae.queries.common import CHAIN, NODES, VECTORS, VERSIONS, Registry, r6
from tesserae.sources import tables as t

QUERIES = Registry()
add = QUERIES.add
START = 1704067200.0
_POLAR = "round(sqrt(greatest(0.0::DOUBLE, distance * distance + 0.25 - distance * cos(radians(angle - 90))) + (time - 360) * (time - 360)), 6)"


@add("l01_nearest_nodes", f"WITH {NODES} SELECT node_id, {_POLAR} AS d FROM nodes ORDER BY d, node_id LIMIT 10")
def l01(spark, d):
    return search.nearest_nodes(t.nodes(spark, d), 360.0, 0.5, 90.0, 10).select("node_id", "d")


def _vector(metric, sql):
    parts = ", ".join(f"abs(dims[{i}] - {v})" for i, v in zip((1, 2, 3, 4), (0.1, -0.1, 0.05, 0.0), strict=True))
    full = {"euclidean": f"sqrt(list_sum(list_transform([{parts}], lambda z: z * z)))", "manhattan": f"list_sum([{parts}])", "chebyshev": f"list_max([{parts}])"}[metric]

    @add(f"l02_nearest_{sql}", f"WITH {VECTORS} SELECT vec_id, round({full}, 6) AS d FROM vectors ORDER BY d, vec_id LIMIT 15")
    def q(spark, d):
        return search.nearest_vectors(t.vectors(spark, d), [0.1, -0.1, 0.05, 0.0], 15, metric).select("vec_id", "d")

    return q


l02 = [_vector(m, n) for m, n in (("euclidean", "l2"), ("manhattan", "l1"), ("chebyshev", "linf"))]


@add("l02_nearest_within", f"WITH {NODES} SELECT node_id, {_POLAR} AS d FROM nodes WHERE {_POLAR} <= 3 ORDER BY d, node_id LIMIT 100")
def l02w(spark, d):
    from tesserae.functions.geometry import polar_distance

    return search.by_distance(t.nodes(spark, d), polar_distance("time", "distance", "angle", 360.0, 0.5, 90.0), 100, 3.0).select("node_id", "d")


@add("l06_nearest_in_time", f"WITH {NODES} SELECT node_id, round(abs(t - {START + 1e6}), 6) AS d FROM nodes ORDER BY d, node_id LIMIT 12")
def l06(spark, d):
    return search.nearest_in_time(t.nodes(spark, d), START + 1e6, 12).select("node_id", "d")


@add("l07_sorted", f"WITH {NODES} SELECT node_id, k FROM nodes ORDER BY k DESC, node_id")
def l07(spark, d):
    return Result(t.nodes(spark, d)).sort("k", reverse=True).map("node_id", "k").df


@add("l08_page", f"WITH {NODES} SELECT node_id, node_type FROM nodes ORDER BY node_id LIMIT 25 OFFSET 75")
def l08(spark, d):
    return Result(t.nodes(spark, d)).page(4, 25).select("node_id", "node_type")


@add("l10_sorted_default_zero", "SELECT event_id AS node_id, CASE WHEN event_type = 'click' THEN value END AS clicked FROM events ORDER BY coalesce(clicked, 0) DESC, node_id LIMIT 40")
def l10(spark, d):
    n = t.table(spark, d, "events").select(F.col("event_id").alias("node_id"), F.when(F.col("event_type") == "click", F.col("value")).alias("clicked"))
    return sorted_by(n, F.col("clicked"), descending=True).limit(40)


@add("l16_newest_first", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 ORDER BY conv_id DESC")
def l16(spark, d):
    return t.messages(spark, d).groupBy("conv_id").agg(F.count("*").alias("n")).orderBy(F.desc("conv_id"))


@add(
    "j07_knn_join",
    """WITH v AS (SELECT o_orderkey AS node_id, o_totalprice / 1e5 AS x, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS time FROM orders),
    q AS (SELECT s_suppkey AS node_id, s_acctbal / 2e3 AS x, 1995.0 AS y, CAST(s_nationkey % 12 + 1 AS DOUBLE) AS time FROM supplier),
    m AS (SELECT q.node_id AS query_id, v.node_id AS neighbour, round(sqrt(power(v.time - q.time, 2) + power(v.x - q.x, 2) + power(v.y - q.y, 2)), 6) AS d FROM q JOIN v ON q.node_id <> v.node_id)
    SELECT query_id, neighbour, d, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour) AS rank FROM m
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour) <= 5""",
)
def j07(spark, d):
    v = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), (F.col("o_totalprice") / 1e5).alias("x"), F.year("o_orderdate").cast("double").alias("y"), F.month("o_orderdate").cast("double").alias("time"))
    q = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_acctbal") / 2e3).alias("x"), F.lit(1995.0).alias("y"), (F.col("s_nationkey") % 12 + 1).cast("double").alias("time"))
    return search.knn_join(q, v, 5, 0.5).select("query_id", "neighbour", "d", F.col("rank").cast("long").alias("rank"))


@add("w01_linked_messages", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, round(0.2::DOUBLE + 0.05 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1), 6) AS distance FROM conversations")
def w01(spark, d):
    return windows.linked_messages(t.messages(spark, d)).select("conv_id", "turn", "previous", r6("distance").alias("distance"))


@add("w02_topic_growth", "SELECT n_regionkey AS domain_id, n_nationkey AS topic_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS topics_so_far FROM nation")
def w02(spark, d):
    from tesserae.operators.knowledge import topic_growth

    return topic_growth(t.domains(spark, d), t.topics(spark, d)).select("domain_id", "topic_id", "topics_so_far")


@add("w03_latest_delta", f"WITH {CHAIN} SELECT user_id, node_id, node_type FROM chain QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, node_id DESC) = 1")
def w03(spark, d):
    return windows.latest_delta(t.chain(t.nodes(spark, d))).select("user_id", "node_id", "node_type")


@add("w04_velocity", f"WITH {NODES}, g AS (SELECT user_id, abs(time - lag(time) OVER (PARTITION BY user_id ORDER BY t, node_id)) AS gap FROM nodes) SELECT user_id, round(coalesce(1.0 / (1.0 + avg(gap)), 0.0), 6) AS velocity FROM g GROUP BY 1")
def w04(spark, d):
    return windows.velocity(t.nodes(spark, d)).select("user_id", r6("velocity").alias("velocity"))


@add(
    "w05_significant",
    f"""WITH {NODES}, r AS (SELECT user_id, node_id, row_number() OVER (PARTITION BY user_id ORDER BY t, node_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM nodes)
    SELECT user_id, node_id FROM r WHERE n <= 10 OR i = n - 1 OR list_contains(list_transform(range(0, 9), lambda j: CAST(floor(j * n / 9.0) AS BIGINT)), i)""",
)
def w05(spark, d):
    return windows.significant(t.nodes(spark, d), "user_id", 10).select("user_id", "node_id")


@add("w06_history", f"WITH {CHAIN} SELECT user_id, seq, node_id, node_type FROM chain ORDER BY user_id, seq")
def w06(spark, d):
    return t.chain(t.nodes(spark, d)).select("user_id", "seq", "node_id", "node_type").orderBy("user_id", "seq")


@add("w08_keep_latest", f"WITH {VERSIONS} SELECT node_id, version, o_orderkey FROM versions QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY version DESC) <= 3")
def w08(spark, d):
    return windows.keep_latest(t.versions(spark, d), 3).select("node_id", "version", "o_orderkey")


_MOVES = """m AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type AS next FROM events),
    c AS (SELECT previous, next, count(*) AS n FROM m WHERE previous IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT previous, next, n, n / sum(n) OVER (PARTITION BY previous)::DOUBLE AS p FROM c)"""


@add("w10_transitions", f"WITH {_MOVES} SELECT previous, next, n, round(p, 6) AS p FROM p")
def w10(spark, d):
    return windows.transitions(t.nodes(spark, d), "user_id", "node_type", "ts", "node_id").select("previous", "next", "n", r6("p").alias("p"))


@add(
    "w11_predicted_next",
    f"""WITH {_MOVES}, b AS (SELECT previous, next, p AS s FROM p UNION ALL SELECT 'view', 'purchase', 0.5 UNION ALL SELECT 'error', 'click', 0.5), s AS (SELECT previous, next, round(sum(s), 9) AS score FROM b GROUP BY 1, 2)
    SELECT previous, next, round(score, 6) AS score, row_number() OVER (PARTITION BY previous ORDER BY score DESC, next) AS rank FROM s""",
)
def w11(spark, d):
    moves = windows.transitions(t.nodes(spark, d), "user_id", "node_type", "ts", "node_id")
    linked = spark.createDataFrame([("view", "purchase"), ("error", "click")], "previous string, next string")
    return windows.predicted_next(moves, linked).select("previous", "next", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@add("w12_top_facts", "SELECT c_custkey AS fact_id, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def w12(spark, d):
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("fact_id"), "c_acctbal").orderBy(F.desc("c_acctbal"), "fact_id").limit(10)


@add("w13_normalised", f"WITH {NODES} SELECT node_id, round((time - min(time) OVER ()) / (max(time) OVER () - min(time) OVER ()), 6) AS scaled FROM nodes")
def w13(spark, d):
    return windows.normalised(t.nodes(spark, d), "time").select("node_id", r6("scaled").alias("scaled"))


@add("w14_last_of_each", "SELECT event_type AS node_type, event_id AS node_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def w14(spark, d):
    return windows.last_of_each(t.nodes(spark, d), "node_type", 100, F.desc("ts"), F.desc("node_id")).select("node_type", "node_id")


@add("w15_versions", f"WITH {VERSIONS} SELECT node_id, version, o_orderkey, status FROM versions")
def w15(spark, d):
    return t.versions(spark, d).select("node_id", "version", "o_orderkey", "status")


@add("w16_sql_windows", "SELECT o_orderkey, rank() OVER w AS rk, ntile(4) OVER w AS quarter, round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey ROWS 2 PRECEDING), 2) AS last3 FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)")
def w16(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.table(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rk"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"))


