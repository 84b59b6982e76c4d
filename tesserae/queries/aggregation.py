"""Aggregations, histograms, statistics, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import geometry as g
from tesserae.functions.scalars import STOP_WORDS
from tesserae.operators import aggregates as a
from tesserae.operators import joins, search
from tesserae.queries.common import CHAIN, EDGES, FACTS, NODES, VERSIONS, Registry, r6
from tesserae.sources import tables as t

QUERIES = Registry()
add = QUERIES.add
START = 1704067200.0
DAY = 86400.0


@add("a01_time_series", f"WITH {NODES} SELECT CAST(floor((t - {START + DAY}) / 7200.0) AS BIGINT) AS interval, count(*) AS n, min(node_id) AS first_id, max(node_id) AS last_id FROM nodes WHERE t BETWEEN {START + DAY} AND {START + 20 * DAY} GROUP BY 1")
def a01(spark, d):
    return a.time_series(t.nodes(spark, d), START + DAY, START + 20 * DAY, 7200.0)


@add("a02_time_series_in_space", f"WITH {NODES} SELECT CAST(floor((t - {START}) / 86400.0) AS BIGINT) AS interval, count(*) AS n FROM nodes WHERE t BETWEEN {START} AND {START + 40 * DAY} AND x BETWEEN -0.3 AND 0.3 AND y BETWEEN -0.3 AND 0.3 GROUP BY 1")
def a02(spark, d):
    inside = search.in_shape(t.nodes(spark, d), {"min": (-0.3, -0.3), "max": (0.3, 0.3)})
    return a.time_series(inside, START, START + 40 * DAY, DAY).select("interval", "n")


@add("a03_bucket_histogram", f"WITH {NODES} SELECT CAST(floor(t / 3600.0) AS BIGINT) AS bucket, count(*) AS n FROM nodes GROUP BY 1")
def a03(spark, d):
    return a.bucket_histogram(t.nodes(spark, d), 3600.0)


@add("a04_distribution", f"WITH {NODES}, h AS (SELECT floor(t / 3600.0) AS b, count(*) AS n FROM nodes GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS buckets, max(n) AS largest, round(avg(n), 6) AS mean FROM h")
def a04(spark, d):
    return a.distribution(t.nodes(spark, d), 3600.0).withColumn("mean", r6("mean"))


@add("a05_angular_histogram", f"WITH {NODES}, c AS (SELECT CAST(floor(angle / 30.0) AS INTEGER) % 12 AS segment, count(*) AS n FROM nodes WHERE time BETWEEN 99 AND 101 GROUP BY 1) SELECT CAST(s.i AS INTEGER) AS segment, coalesce(n, 0) AS n FROM range(12) s(i) LEFT JOIN c ON c.segment = s.i")
def a05(spark, d):
    return a.angular_histogram(spark, search.temporal_slice(t.nodes(spark, d), 100.0, 1.0))


@add("a06_balanced_angle", f"WITH {NODES}, c AS (SELECT CAST(floor(angle / 30.0) AS INTEGER) % 12 AS segment, count(*) AS n FROM nodes GROUP BY 1), z AS (SELECT CAST(s.i AS INTEGER) AS segment, coalesce(n, 0) AS n FROM range(12) s(i) LEFT JOIN c ON c.segment = s.i) SELECT segment, (segment + 0.5) * 30.0::DOUBLE AS angle FROM z ORDER BY n, segment LIMIT 1")
def a06(spark, d):
    return a.balanced_angle(spark, t.nodes(spark, d))


@add("a07_timeline", f"WITH {NODES}, e AS (SELECT min(time) AS lo, max(time) AS hi FROM nodes) SELECT CAST(least(69, greatest(0, floor((time - lo) / (hi - lo) * 69))) AS INTEGER) AS bin, count(*) AS n FROM nodes, e GROUP BY 1")
def a07(spark, d):
    return a.timeline(t.nodes(spark, d), 70)


@add(
    "a08_node_statistics",
    f"""WITH {EDGES}, e AS (SELECT src AS i FROM edges UNION ALL SELECT dst FROM edges), g AS (SELECT i, count(*) AS degree FROM e GROUP BY 1)
    SELECT count(*) AS n_nodes, round(max(time) - min(time), 6) AS time_span, round(avg(distance), 6) AS avg_distance, max(distance) AS max_distance,
           count(parent_id) AS n_deltas, (SELECT max(degree) FROM g) AS max_degree, round((SELECT sum(degree) FROM g) / count(*), 6) AS avg_degree FROM chain""",
)
def a08(spark, d):
    from tesserae.operators.graph import degrees

    n = t.nodes(spark, d)
    s = a.node_statistics(t.chain(n), degrees(t.edges(n)))
    return s.select("n_nodes", r6("time_span").alias("time_span"), r6("avg_distance").alias("avg_distance"), "max_distance", "n_deltas", "max_degree", r6("avg_degree").alias("avg_degree"))


@add("a10_group_count", "SELECT event_type AS node_type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM events WHERE value BETWEEN 10 AND 60 GROUP BY 1")
def a10(spark, d):
    return a.group_count(search.radial_band(t.nodes(spark, d), 0.1, 0.6), "node_type")


@add("a11_by_period", "SELECT date_trunc('day', ts) AS period, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a11(spark, d):
    return a.by_period(t.table(spark, d, "events"), "day", "value").withColumn("mean", r6("mean"))


@add("a12_grouped_average", "SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def a12(spark, d):
    return a.aggregate(t.table(spark, d, "events"), ["event_type"], {"mean": r6(F.avg("value")), "n": F.count("*")})


@add("a13_multi_key", "SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_totalprice > 1000 GROUP BY 1, 2")
def a13(spark, d):
    o = t.table(spark, d, "orders").where("o_totalprice > 1000")
    return a.aggregate(o, ["o_orderpriority", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")], {"n": F.count("*"), "mean": F.round(F.avg("o_totalprice"), 4)})


@add("a13_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a13r(spark, d):
    return a.aggregate(t.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count("*"), "quantity": F.round(F.sum("l_quantity"), 2)}, "rollup")


@add("a13_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a13c(spark, d):
    return a.aggregate(t.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count("*"), "quantity": F.round(F.sum("l_quantity"), 2)}, "cube")


@add("a14_compare_contexts", "SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS mean_click, round(avg(value) FILTER (event_type = 'purchase'), 6) AS mean_purchase FROM events GROUP BY 1")
def a14(spark, d):
    c = a.compare_contexts(t.table(spark, d, "events"), "user_id", "event_type", ["click", "purchase"], "value")
    return c.select("user_id", r6("mean_click").alias("mean_click"), r6("mean_purchase").alias("mean_purchase"))


@add("a15_cardinality", "SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT event_type) AS n_event_type FROM events")
def a15(spark, d):
    return a.cardinality(t.table(spark, d, "events"), "user_id", "event_type")


@add("a16_selectivity", "SELECT round(avg(CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0 END), 9) AS selectivity FROM events")
def a16(spark, d):
    return a.selectivity(t.table(spark, d, "events"), "event_type", "view").select(F.round("selectivity", 9).alias("selectivity"))


_PERCENT = """r AS (SELECT {key}{value} AS v, row_number() OVER ({part}ORDER BY {value}) AS i, count(*) OVER ({own}) AS n FROM {table} WHERE {value} IS NOT NULL),
    j AS (SELECT *, {p} * (n + 1) / 100.0::DOUBLE AS pos, greatest(1, least(n - 1, CAST(floor({p} * (n + 1) / 100.0) AS BIGINT))) AS j FROM r)"""


@add("a17_percentile", "WITH " + _PERCENT.format(key="event_type, ", value="value", part="PARTITION BY event_type ", own="PARTITION BY event_type", table="events", p=90) + " SELECT event_type, round(min(v) + (max(v) - min(v)) * (first(pos) - first(j)), 6) AS percentile FROM j WHERE i = j OR i = j + 1 OR n = 1 GROUP BY 1")
def a17(spark, d):
    return a.percentile_of(t.table(spark, d, "events"), "value", 90, "event_type").withColumn("percentile", r6("percentile"))


@add("a18_query_summary", "WITH " + _PERCENT.format(key="event_type, ", value="value", part="PARTITION BY event_type ", own="PARTITION BY event_type", table="events", p=90) + ", p AS (SELECT event_type, min(v) + (max(v) - min(v)) * (first(pos) - first(j)) AS p90 FROM j WHERE i = j OR i = j + 1 OR n = 1 GROUP BY 1) SELECT e.event_type AS query_type, count(*) AS n, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, round(any_value(p90), 6) AS p90_ms FROM events e JOIN p USING (event_type) GROUP BY 1")
def a18(spark, d):
    log = t.table(spark, d, "events").select(F.col("event_type").alias("query_type"), F.col("value").alias("ms"), F.col("user_id").alias("size"))
    return a.query_summary(log).select("query_type", "n", r6("avg_ms").alias("avg_ms"), "min_ms", "max_ms", r6("p90_ms").alias("p90_ms"))


@add("a19_hit_ratio", "SELECT event_type, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_ratio FROM events GROUP BY 1")
def a19(spark, d):
    return a.hit_ratio(t.table(spark, d, "events"), "event_type", F.col("value") > 50).withColumn("hit_ratio", r6("hit_ratio"))


@add("a20_estimates", "WITH " + _PERCENT.format(key="event_type AS query_type, ", value="value", part="PARTITION BY event_type ", own="PARTITION BY event_type", table="events", p=75) + " SELECT query_type, round(min(v) + (max(v) - min(v)) * (first(pos) - first(j)), 6) AS estimate FROM j WHERE i = j OR i = j + 1 OR n = 1 GROUP BY 1")
def a20(spark, d):
    log = t.table(spark, d, "events").select(F.col("event_type").alias("query_type"), F.col("value").alias("ms"))
    return a.estimate(log, "ms", 100.0).withColumn("estimate", r6("estimate"))


@add("a24_top_terms", "WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(lower(text), '\\s+')) AS term, generate_subscripts(string_split_regex(lower(text), '\\s+'), 1) AS pos FROM conversations), c AS (SELECT conv_id, turn, term, count(*) AS n, min(pos) AS f FROM w WHERE length(term) >= 3 AND term NOT IN (" + ", ".join(f"'{x}'" for x in STOP_WORDS) + ") GROUP BY 1, 2, 3) SELECT conv_id * 1000 + turn AS id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, f, term) AS rank, term, n FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, f, term) <= 5")
def a24(spark, d):
    m = t.messages(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return a.top_terms(m, "id", "text", 5, 3, STOP_WORDS).select("id", F.col("rank").cast("long").alias("rank"), "term", "n")


@add("a25_confidence_histogram", f"WITH {FACTS} SELECT CAST(least(9, floor(confidence / 0.1::DOUBLE)) AS INTEGER) AS bin, count(*) AS n FROM facts GROUP BY 1")
def a25(spark, d):
    return a.equal_bins(t.facts(spark, d), "confidence", 10)


@add("a26_facts_per_topic", f"WITH {FACTS} SELECT n_nationkey AS topic_id, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM facts JOIN nation ON n_nationkey = topic_id GROUP BY 1")
def a26(spark, d):
    from tesserae.operators.knowledge import facts_per_topic

    return facts_per_topic(t.topics(spark, d), t.facts(spark, d)).select("topic_id", "n", r6("mean_confidence").alias("mean_confidence"))


@add("a27_bytes", "SELECT event_type AS node_type, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def a27(spark, d):
    return t.table(spark, d, "events").groupBy(F.col("event_type").alias("node_type")).agg(F.sum(F.octet_length("props")).alias("bytes"))


@add("a32_describe", "SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_samp(value), 6) AS stddev FROM events GROUP BY 1")
def a32(spark, d):
    s = a.describe(t.table(spark, d, "events"), "value", "event_type")
    return s.select("event_type", "n", "min", "max", *[r6(c).alias(c) for c in ("mean", "median", "p95", "p99", "stddev")])


@add(
    "a34_bounding_box",
    f"""WITH {NODES}, e AS (SELECT min(time) AS t_lo, max(time) AS t_hi, min(distance) AS r_lo, max(distance) AS r_hi FROM nodes),
    th AS (SELECT DISTINCT theta FROM nodes), b AS (SELECT theta, lag(theta) OVER (ORDER BY theta) AS bef, max(theta) OVER () AS last FROM th),
    g AS (SELECT theta, coalesce(bef, last) AS hi, round(CASE WHEN bef IS NULL THEN theta - last + 2 * pi() ELSE theta - bef END, 9) AS gap FROM b)
    SELECT round(t_lo, 6) AS t_lo, round(t_hi, 6) AS t_hi, r_lo, r_hi, round(theta, 6) AS theta_lo, round(hi, 6) AS theta_hi FROM e, (SELECT * FROM g ORDER BY gap DESC, theta LIMIT 1)""",
)
def a34(spark, d):
    b = a.bounding_box(t.nodes(spark, d))
    return b.select(r6("t_lo").alias("t_lo"), r6("t_hi").alias("t_hi"), "r_lo", "r_hi", r6("theta_lo").alias("theta_lo"), r6("theta_hi").alias("theta_hi"))


@add("a37_mean_position", f"WITH {NODES}, m AS (SELECT user_id, avg(x) AS mx, avg(y) AS my, max(time) AS last FROM nodes GROUP BY 1) SELECT user_id, round(last + 1, 6) AS time, round(sqrt(mx * mx + my * my), 6) AS distance FROM m")
def a37(spark, d):
    return a.mean_position(t.nodes(spark, d), "user_id").select("user_id", r6("time").alias("time"), r6("distance").alias("distance"))


@add("j01_inner_join", f"WITH {VERSIONS} SELECT node_id, version, price FROM versions WHERE node_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j01(spark, d):
    left = t.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node_id"))
    return joins.inner_join(left, t.versions(spark, d)).select("node_id", "version", "price")


_TWO = "a AS (SELECT event_id AS node_id, event_type FROM events WHERE value < 40), b AS (SELECT event_id AS node_id, event_type FROM events WHERE value > 30)"


def _two(spark, d):
    e = t.table(spark, d, "events").select(F.col("event_id").alias("node_id"), "event_type", "value")
    return e.where("value < 40").drop("value"), e.where("value > 30").drop("value")


@add("j03_union", f"WITH {_TWO} SELECT * FROM a UNION ALL SELECT * FROM b WHERE node_id NOT IN (SELECT node_id FROM a)")
def j03(spark, d):
    return joins.union(*_two(spark, d))


@add("j04_intersection", f"WITH {_TWO} SELECT b.* FROM b WHERE node_id IN (SELECT node_id FROM a)")
def j04(spark, d):
    return joins.intersection(*_two(spark, d))


@add("s03_added_removed", f"WITH {_TWO} SELECT node_id, 'added' AS change FROM b WHERE node_id NOT IN (SELECT node_id FROM a) UNION ALL SELECT node_id, 'removed' FROM a WHERE node_id NOT IN (SELECT node_id FROM b)")
def s03(spark, d):
    left, right = _two(spark, d)
    return joins.added_removed(left, right, "node_id")


@add("j02_outer_join", "SELECT c_custkey AS node_id, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def j02(spark, d):
    left = t.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    return joins.outer_join(left, t.table(spark, d, "orders").select(F.col("o_custkey").alias("node_id"), "o_orderkey"))


@add("j05_edge_join", f"WITH {EDGES}, b AS (SELECT src AS from_id, dst AS node_id, type FROM edges UNION SELECT dst, src, type FROM edges) SELECT from_id, b.node_id, type, node_type FROM b JOIN nodes USING (node_id) WHERE type = 'click'")
def j05(spark, d):
    n = t.nodes(spark, d)
    return joins.connected_nodes(t.edges(n), n.select("node_id", "node_type"), "click", "both").select("from_id", "node_id", "type", "node_type")


@add(
    "j06_box_join",
    """WITH b AS (SELECT user_id AS id, min((epoch_us(ts) - 1704067200000000) / 3.6e9) AS t_lo, max((epoch_us(ts) - 1704067200000000) / 3.6e9) AS t_hi, min(value) / 100 AS r_lo, max(value) / 100 AS r_hi
               FROM events GROUP BY user_id, CAST(day(ts) AS INTEGER) % 3, event_type HAVING event_type IN ('purchase', 'signup'))
    SELECT a.id AS left_id, b.id AS right_id, count(*) AS n FROM b a JOIN b ON a.t_lo <= b.t_hi AND b.t_lo <= a.t_hi AND a.r_lo <= b.r_hi AND b.r_lo <= a.r_hi GROUP BY 1, 2""",
)
def j06(spark, d):
    n = t.nodes(spark, d).where("node_type in ('purchase', 'signup')")
    ends = n.groupBy("user_id", F.dayofmonth("ts") % 3, "node_type").agg(F.min("time").alias("t_lo"), F.max("time").alias("t_hi"), F.min("distance").alias("r_lo"), F.max("distance").alias("r_hi"))
    boxes = ends.select(F.col("user_id").alias("id"), g.box_column(t_lo="t_lo", t_hi="t_hi", r_lo="r_lo", r_hi="r_hi", theta_lo=0.0, theta_hi=6.0).alias("box"))
    return search.box_join(boxes, boxes, 240.0).groupBy("left_id", "right_id").agg(F.count("*").alias("n"))


@add("j08_parents", f"WITH {CHAIN} SELECT c.node_id, c.parent_id, p.node_type AS parent_type FROM chain c LEFT JOIN chain p ON c.parent_id = p.node_id")
def j08(spark, d):
    return joins.parents(t.chain(t.nodes(spark, d))).select("node_id", "parent_id", "parent_type")


@add("j09_referring", f"WITH {CHAIN} SELECT parent_id AS node_id, node_id AS referred_by FROM chain WHERE parent_id IS NOT NULL")
def j09(spark, d):
    c = t.chain(t.nodes(spark, d)).withColumn("delta_references", F.array_compact(F.array("parent_id")))
    return joins.referring(c).select("node_id", "referred_by")


@add(
    "j10_as_of_join",
    "SELECT p.o_orderkey AS probe, p.o_custkey AS key, s.o_totalprice AS state FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') p ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) s ON p.o_custkey = s.o_custkey AND s.o_orderdate <= p.o_orderdate",
)
def j10(spark, d):
    o = t.table(spark, d, "orders")
    states = o.where("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderdate").agg(F.max_by("o_totalprice", "o_orderkey").alias("price"))
    probes = o.where("o_orderstatus = 'P'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("probe"))
    return joins.as_of_join(probes, states, "o_custkey", "o_orderdate", "price", "probe").select("probe", F.col("o_custkey").alias("key"), "state")


@add("j11_interval_join", f"WITH {NODES}, i AS (SELECT user_id, min(t) AS s, min(t) + 3 * 86400 AS e FROM nodes GROUP BY 1) SELECT n.user_id, node_id FROM nodes n JOIN i ON n.user_id = i.user_id AND t > s AND t <= e")
def j11(spark, d):
    n = t.nodes(spark, d)
    i = n.groupBy("user_id").agg(F.min("t").alias("start"), (F.min("t") + 3 * DAY).alias("end"))
    return joins.interval_join(i, n.select("user_id", "node_id", "t"), "user_id", DAY).select("user_id", "node_id")


@add("j17_without_delta", f"WITH {CHAIN} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT parent_id FROM chain WHERE parent_id IS NOT NULL)")
def j17(spark, d):
    n = t.nodes(spark, d)
    return joins.difference(n.select("node_id"), t.edges(n).select(F.col("dst").alias("node_id")))


@add("s04_undirected", f"WITH {EDGES} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)")
def s04(spark, d):
    e = t.edges(t.nodes(spark, d)).select("src", "dst")
    return joins.undirected(e.union(e.select("dst", "src")))


@add("s05_union_distinct", "SELECT event_type AS name FROM events UNION SELECT o_orderpriority FROM orders UNION SELECT c_mktsegment FROM customer")
def s05(spark, d):
    parts = [("events", "event_type"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment")]
    out = None
    for table, column in parts:
        one = t.table(spark, d, table).select(F.col(column).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()
