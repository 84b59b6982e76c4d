"""Entries of their own for inventory rows whose code is also part of wider queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions import geometry as g
from tesserae.functions import scalars as s
from tesserae.operators import aggregates, delta, delta_ops, graph, joins, search
from tesserae.plans import builder, cost, results
from tesserae.plans.criteria import OPERATORS, Composite, Content, Fields, InvalidQuery, Query, Spatial, Temporal
from tesserae.queries.common import CHAIN, EDGES, FACTS, NODES, VECTORS, VERSIONS, Registry, r6
from tesserae.queries.deltas import DAY, NAMES, ORDER, START, _flat, _last
from tesserae.queries.filters import SQUARE, _polygon_sql
from tesserae.queries.storage import _streamed
from tesserae.sources import store
from tesserae.sources import tables as t
from tesserae.sources import text as text_source
from tesserae.streaming import feed

QUERIES = Registry()
add = QUERIES.add
KIND = ["node_id", "node_type"]
PI2 = "6.283185307179586::DOUBLE"


def _events(spark, d):
    return t.table(spark, d, "events").select(F.col("event_id").alias("node_id"), F.col("event_type").alias("node_type"), "user_id", "value")


def _run(part, df, fields=None):
    return part.build().run(df, fields).select(*KIND)


def _valid(*made) -> list[bool]:
    """Whether each of some criteria is accepted."""
    out = []
    for one in made:
        try:
            one().validate()
            out.append(True)
        except InvalidQuery:
            out.append(False)
    return out


def _flags(spark, names, valid):
    return spark.createDataFrame(list(zip(names, valid, strict=True)), "name string, valid boolean")


# sources


@add("sc02_index_scan", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE t BETWEEN {START + DAY} AND {START + 2 * DAY} AND node_type = 'click'")
def sc02(spark, d):
    return search.bucketed_range(t.nodes(spark, d), START + DAY, START + 2 * DAY).where("node_type = 'click'").select(*KIND)


@add("sc04_exists", "SELECT i AS node_id, i IN (SELECT event_id FROM events) AS found FROM (VALUES (1), (77), (-5), (999999999)) v(i)")
def sc04(spark, d):
    n = t.nodes(spark, d)
    return spark.createDataFrame([(i, store.exists(n, i)) for i in (1, 77, -5, 999999999)], "node_id int, found boolean")


@add("sc06_multi_get_missing", "SELECT event_id AS node_id, event_type AS node_type FROM events WHERE event_id IN (1, 2, 4, 8)")
def sc06(spark, d):
    return search.multi_get(t.nodes(spark, d), [8, 4, 2, 1, -1, 999999999]).select(*KIND)


@add("sc09_time_keys", f"WITH {NODES} SELECT node_id, t FROM nodes WHERE t BETWEEN {START + 3 * DAY} AND {START + 4 * DAY}")
def sc09(spark, d):
    return store.ordered(search.time_range(t.nodes(spark, d), START + 3 * DAY, START + 4 * DAY), "t").select("node_id", "t")


@add("sc10_spatial_keys", f"WITH {NODES}, c AS (SELECT node_id, CAST(floor(distance * 10) AS INTEGER) AS a, CAST(floor(angle / 10) AS INTEGER) AS b FROM nodes) SELECT node_id FROM c WHERE (a > 2 OR (a = 2 AND b >= 5)) AND (a < 4 OR (a = 4 AND b <= 20))")
def sc10(spark, d):
    n = t.nodes(spark, d).select("node_id", F.struct(F.floor(F.col("distance") * 10).cast("int").alias("a"), F.floor(F.col("angle") / 10).cast("int").alias("b")).alias("key"))
    low, high = (F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((2, 5), (4, 20)))
    return search.time_range(n, low, high, "key").select("node_id")


@add("sc12_load_document", "SELECT CAST(n_nationkey AS VARCHAR) AS node_id, n_name AS name, n_regionkey AS region FROM nation")
def sc12(spark, d):
    """One JSON document with a map of nodes, written and loaded."""
    path = f"{store.shared_dir(spark)}/document-{uuid.uuid4().hex}"
    n = t.table(spark, d, "nation")
    entry = F.struct(F.col("n_nationkey").cast("string").alias("k"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("v"))
    n.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("nodes"))).alias("value")).write.text(path)
    return store.load_database_json(spark, path, f"name string, region {n.schema['n_regionkey'].dataType.simpleString()}")


@add("sc14_restored", "SELECT event_id, event_type, user_id, value, epoch_us(ts) AS us FROM events")
def sc14(spark, d):
    """A packed dump of all fields, restored with its types."""
    e = t.table(spark, d, "events").select("event_id", "event_type", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return store.unpack_rows(store.pack_rows(e), e.schema)


@add("sc21_batch_write", f"WITH {VERSIONS}, m AS (SELECT node_id, max(version) AS v FROM versions GROUP BY 1), b AS (SELECT node_id, v + 1 AS version FROM m WHERE node_id % 4 = 0 UNION ALL SELECT node_id, v + 2 FROM m WHERE node_id % 4 = 0) SELECT node_id, version, 'B' AS status FROM b UNION ALL SELECT node_id, version, status FROM versions WHERE node_id % 4 = 0")
def sc21(spark, d):
    v = t.versions(spark, d).select("node_id", "version", "status")
    ids = v.where("node_id % 4 = 0").select("node_id").distinct()
    batch = ids.union(ids).withColumn("status", F.lit("B"))
    return store.upsert(v, batch).where("node_id % 4 = 0").select("node_id", "version", "status")


@add("sc25_backup", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def sc25(spark, d):
    out = f"{store.shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    store.backup(spark, f"{d}/orders.parquet", out)
    return spark.read.parquet(out).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@add("sc26_statistics", "SELECT count(*) AS n_rows, CAST(25 AS BIGINT) AS nations FROM orders")
def sc26(spark, d):
    made = store.statistics(t.table(spark, d, "orders")), store.statistics(t.table(spark, d, "nation"))
    return spark.createDataFrame([(made[0]["rows"], made[1]["rows"])], "n_rows long, nations long")


@add("sc30_result_batch", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE k > 10 ORDER BY node_id LIMIT 40 OFFSET 120")
def sc30(spark, d):
    return results.Result(t.nodes(spark, d).where("k > 10").select(*KIND)).batch(120, 40)


# filters


@add("f10_box_box", f"WITH {NODES} SELECT node_id, (time - 5 <= 300 AND 100 <= time + 5) AND (distance - 0.1 <= 0.6 AND 0.2 <= distance + 0.1) AND (theta + 0.2 >= 5.5 OR theta - 0.2 <= 0.7) AS meets FROM nodes")
def f10(spark, d):
    own = g.box_column(t_lo=F.col("time") - 5.0, t_hi=F.col("time") + 5.0, r_lo=F.col("distance") - 0.1, r_hi=F.col("distance") + 0.1, theta_lo=F.col("theta") - 0.2, theta_hi=F.col("theta") + 0.2)
    box = g.box_column(**{n: F.lit(x) for n, x in zip(g.BOX_FIELDS, (100.0, 300.0, 0.2, 0.6, 5.5, 0.7), strict=True)})
    return t.nodes(spark, d).select("node_id", g.box_intersects(own, box).alias("meets"))


@add("f14_point_in_polygon", f"WITH {NODES} SELECT node_id, {_polygon_sql()} AS inside FROM nodes")
def f14(spark, d):
    return t.nodes(spark, d).select("node_id", g.in_polygon("x", "y", SQUARE).alias("inside"))


@add("f19_both_results", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE time BETWEEN 50 AND 300 AND distance <= 0.4")
def f19(spark, d):
    n = t.nodes(spark, d)
    return joins.intersection(search.time_range(n, 50.0, 300.0, "time"), search.radial_band(n, 0.0, 0.4)).select(*KIND)


@add("f20_post_filter", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE node_id IN (5, 10, 15, 20, 25, 30) AND value > 20")
def f20(spark, d):
    return Query(Content("value", ">", 20)).run(search.multi_get(t.nodes(spark, d), [5, 10, 15, 20, 25, 30])).select(*KIND)


@add("f22_time_bounds_checked", "SELECT * FROM (VALUES ('both', true), ('start', true), ('none', false), ('swapped', false)) v(name, valid)")
def f22(spark, d):
    made = (lambda: Temporal(1.0, 2.0), lambda: Temporal(start_time=1.0), lambda: Temporal(), lambda: Temporal(2.0, 1.0))
    return _flags(spark, ["both", "start", "none", "swapped"], _valid(*made))


@add("f23_circle_criterion", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE power(x + 0.1, 2) + power(y - 0.2, 2) <= 0.3 * 0.3::DOUBLE")
def f23(spark, d):
    return Query(Spatial(center_x=-0.1, center_y=0.2, radius=0.3)).run(t.nodes(spark, d)).select(*KIND)


@add("f24_place_checked", "SELECT * FROM (VALUES ('box', true), ('circle', true), ('half', false), ('no radius', false)) v(name, valid)")
def f24(spark, d):
    made = (lambda: Spatial(0.0, 0.0, 1.0, 1.0), lambda: Spatial(center_x=0.0, center_y=0.0, radius=1.0), lambda: Spatial(0.0, 0.0), lambda: Spatial(center_x=0.0, center_y=0.0, radius=0.0))
    return _flags(spark, ["box", "circle", "half", "no radius"], _valid(*made))


@add("f26_operators_known", "SELECT * FROM (VALUES ('=', true), ('>', true), ('<', true), ('>=', true), ('<=', true), ('!=', true), ('LIKE', true), ('IN', true), ('CONTAINS', true), ('~', false), ('BETWEEN', false)) v(name, valid)")
def f26(spark, d):
    names = [*OPERATORS[:9], "~", "BETWEEN"]
    return _flags(spark, names, _valid(*[lambda o=o: Content("value", o, [1]) for o in names]))


@add("f28_trees_checked", "SELECT * FROM (VALUES ('and', true), ('not', true), ('not two', false), ('empty', false), ('bad leaf', false), ('xor', false)) v(name, valid)")
def f28(spark, d):
    a, bad = Content("k", ">", 1), Temporal()
    made = (lambda: Composite("AND", (a, a)), lambda: Composite("NOT", (a,)), lambda: Composite("NOT", (a, a)), lambda: Composite("OR", ()), lambda: Composite("AND", (a, Composite("OR", (bad,)))), lambda: Composite("XOR", (a, a)))
    return _flags(spark, ["and", "not", "not two", "empty", "bad leaf", "xor"], _valid(*made))


@add("f29_and_of_three", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE k > 10 AND k < 60 AND node_type = 'view'")
def f29(spark, d):
    c = Content("k", ">", 10) & Content("k", "<", 60) & Content("node_type", "=", "view")
    assert len(c.criteria) == 3  # joined to one AND
    return Query(c).run(t.nodes(spark, d)).select(*KIND)


@add("f30_or_of_three", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE k < 10 OR k > 90 OR node_type = 'error'")
def f30(spark, d):
    return _run(builder.content_query().less_than("k", 10).or_(Content("k", ">", 90)).or_(Content("node_type", "=", "error")), t.nodes(spark, d))


@add("f31_not", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE NOT (k > 30)")
def f31(spark, d):
    return _run(builder.content_query().greater_than("k", 30).not_(), t.nodes(spark, d))


@add("f32_before", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE t <= {START + 3 * DAY}")
def f32(spark, d):
    return _run(builder.temporal_query().before(START + 3 * DAY), t.nodes(spark, d))


@add("f33_after", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE t >= {START + 25 * DAY}")
def f33(spark, d):
    return _run(builder.temporal_query().after(START + 25 * DAY), t.nodes(spark, d))


@add("f34_between", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE t BETWEEN {START + 6 * DAY} AND {START + 8 * DAY}")
def f34(spark, d):
    return _run(builder.temporal_query().between(START + 6 * DAY, START + 8 * DAY), t.nodes(spark, d))


@add("f35_within_rectangle", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE x BETWEEN 0.1 AND 0.6 AND y BETWEEN -0.3 AND 0.3")
def f35(spark, d):
    return _run(builder.spatial_query().within_rectangle(0.1, -0.3, 0.6, 0.3), t.nodes(spark, d))


@add("f36_near", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE power(x - 0.3, 2) + power(y + 0.3, 2) <= 0.25 * 0.25::DOUBLE")
def f36(spark, d):
    return _run(builder.spatial_query().near(0.3, -0.3, 0.25), t.nodes(spark, d))


@add("f37_equals", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE node_type = 'signup'")
def f37(spark, d):
    return _run(builder.content_query().equals("node_type", "signup"), t.nodes(spark, d))


@add("f38_greater_than", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE value > 80")
def f38(spark, d):
    return _run(builder.content_query().greater_than("value", 80), t.nodes(spark, d))


@add("f39_less_than", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE value < 15")
def f39(spark, d):
    return _run(builder.content_query().less_than("value", 15), t.nodes(spark, d))


@add("f40_like", "SELECT event_id AS node_id, event_type AS node_type FROM events WHERE event_type LIKE 's_g%'")
def f40(spark, d):
    return _run(builder.content_query().like("node_type", "s_g%"), _events(spark, d))


@add("f41_in_list", "SELECT event_id AS node_id, event_type AS node_type FROM events WHERE event_type IN ('click', 'error')")
def f41(spark, d):
    return _run(builder.content_query().in_list("node_type", ["click", "error"]), _events(spark, d))


@add("f42_contains", "SELECT event_id AS node_id, event_type AS node_type FROM events WHERE contains(event_type, 'ic')")
def f42(spark, d):
    return _run(builder.content_query().contains("node_type", "ic"), _events(spark, d))


@add("f44_result_filter", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE k % 2 = 0 AND distance > 0.5")
def f44(spark, d):
    return results.Result(t.nodes(spark, d)).filter(F.col("k") % 2 == 0).filter(F.col("distance") > 0.5).df.select(*KIND)


@add("f45_result_map", "SELECT event_id AS node_id, upper(event_type) AS kind, 2 * value AS twice FROM events")
def f45(spark, d):
    return results.Result(_events(spark, d)).map("node_id", F.upper("node_type").alias("kind"), (2 * F.col("value")).alias("twice")).df


@add("f47_missing_property", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE node_type = 'purchase' AND value >= 0 AND value > 50")
def f47(spark, d):
    """Content without the key matches nothing."""
    return Query(Content("purchase", ">", 50)).run(t.nodes(spark, d), Fields(content="content")).select(*KIND)


@add("f48_time_range_applied", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE k = 7 AND t BETWEEN {START + DAY} AND {START + 15 * DAY}")
def f48(spark, d):
    return Query(builder.filter_by_property({"k": 7}) & Temporal(START + DAY, START + 15 * DAY)).run(t.nodes(spark, d)).select(*KIND)


@add("f50_keyword", "SELECT conv_id, turn, role FROM conversations WHERE contains(text, 'the')")
def f50(spark, d):
    return Query(Content("text", "CONTAINS", "the")).run(t.messages(spark, d)).select("conv_id", "turn", "role")


@add("f52_store_time_range", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE time BETWEEN 24 AND 72")
def f52(spark, d):
    return search.time_range(t.nodes(spark, d), 24.0, 72.0, "time").select(*KIND)


@add("f53_store_region", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE x BETWEEN -0.5 AND 0 AND y BETWEEN 0 AND 0.5")
def f53(spark, d):
    return search.in_shape(t.nodes(spark, d), {"min": (-0.5, 0.0), "max": (0.0, 0.5)}).select(*KIND)


@add("f54_window_with_neighbours", f"WITH {EDGES}, w AS (SELECT node_id FROM nodes WHERE time BETWEEN 96 AND 120 AND k > 50) SELECT node_id FROM w UNION SELECT dst FROM edges WHERE src IN (SELECT node_id FROM w)")
def f54(spark, d):
    n = t.nodes(spark, d)
    own = search.time_range(n, 96.0, 120.0, "time").where("k > 50")
    near = joins.connected_nodes(t.edges(n).join(own.select(F.col("node_id").alias("src")), "src", "left_semi"), n)
    return joins.union(own.select("node_id"), near.select("node_id").distinct())


@add("f55_region_with_predicate", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE time BETWEEN 0 AND 240 AND distance BETWEEN 0 AND 0.5 AND theta BETWEEN 0 AND 1.5 AND node_type <> 'view'")
def f55(spark, d):
    return search.in_box(t.nodes(spark, d), g.Box(0.0, 240.0, 0.0, 0.5, 0.0, 1.5)).where("node_type <> 'view'").select(*KIND)


@add("f56_range_in_branch", f"WITH {NODES} SELECT node_id, user_id % 3 AS branch FROM nodes WHERE time BETWEEN 10 AND 200 AND distance BETWEEN 0.3 AND 0.9 AND theta BETWEEN 1 AND 4 AND user_id % 3 = 1")
def f56(spark, d):
    n = t.nodes(spark, d).withColumn("branch", F.col("user_id") % 3)
    return search.in_box(n, g.Box(10.0, 200.0, 0.3, 0.9, 1.0, 4.0)).where("branch = 1").select("node_id", "branch")


# joins, sets


@add("j16_edges_inside", f"WITH {EDGES}, w AS (SELECT node_id FROM nodes WHERE time BETWEEN 100 AND 400) SELECT src, dst FROM edges SEMI JOIN (SELECT node_id AS src FROM w) USING (src) SEMI JOIN (SELECT node_id AS dst FROM w) USING (dst)")
def j16(spark, d):
    n = t.nodes(spark, d)
    return search.temporal_window(n, t.edges(n), 100.0, 400.0)[1].select("src", "dst")


@add("j18_join_costs", "SELECT * FROM (VALUES (10, 10, 50.0::DOUBLE), (1000, 20, 10000.0::DOUBLE), (0, 5, 0.0::DOUBLE)) v(l, r, cost)")
def j18(spark, d):
    return spark.createDataFrame([(a, b, cost.join_cost(a, b)) for a, b in ((10, 10), (1000, 20), (0, 5))], "l int, r int, cost double")


@add("s01_union_left_wins", f"WITH {VERSIONS} SELECT o_orderkey AS node_id, 'left' AS side FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'right' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def s01(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"))
    return joins.union(o.where("node_id % 3 = 0").withColumn("side", F.lit("left")), o.where("node_id % 2 = 0").withColumn("side", F.lit("right")))


@add("s02_intersection_of_ids", "SELECT o_orderkey AS node_id FROM orders WHERE o_orderkey % 6 = 0")
def s02(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"))
    return joins.intersection(o.where("node_id % 2 = 0"), o.where("node_id % 3 = 0"))


# aggregates


def _log(spark, d):
    return _events(spark, d).select(F.col("node_type").alias("query_type"), F.col("value").alias("ms"), F.col("user_id").cast("double").alias("size"))


_EXCLUSIVE = "(SELECT query_type, low + (high - low) * (pos - j) AS p FROM (SELECT query_type, min(v) AS low, max(v) AS high, any_value(pos) AS pos, any_value(j) AS j FROM (SELECT *, {p} * (n + 1) / 100.0::DOUBLE AS pos, greatest(1, least(n - 1, CAST(floor({p} * (n + 1) / 100.0::DOUBLE) AS BIGINT))) AS j FROM (SELECT event_type AS query_type, CAST({c} AS DOUBLE) AS v, row_number() OVER (PARTITION BY event_type ORDER BY CAST({c} AS DOUBLE)) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)) WHERE i = j OR i = j + 1 GROUP BY 1))"


@add("a21_size_estimate", f"SELECT query_type, round(p, 6) AS estimate FROM {_EXCLUSIVE.format(p=75, c='user_id')}")
def a21(spark, d):
    return aggregates.estimate(_log(spark, d), "size", 10.0).select("query_type", r6("estimate").alias("estimate"))


@add("a22_max_degree", f"WITH {EDGES} SELECT max(n) AS degree FROM (SELECT node_id, count(*) AS n FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)")
def a22(spark, d):
    return graph.degrees(t.edges(t.nodes(spark, d))).agg(F.max("degree").alias("degree"))


@add("a29_optimise_all", f"WITH {VERSIONS}, c AS (SELECT node_id, count(*) AS n FROM versions GROUP BY 1), e AS (SELECT n, least(n, 10) AS kept, CASE WHEN least(n, 10) >= 5 THEN 4 ELSE 0 END AS merged FROM c) SELECT count(*) AS nodes, CAST(sum(n) AS BIGINT) AS before, CAST(sum(n - kept) AS BIGINT) AS pruned, CAST(sum(merged) AS BIGINT) AS merged, CAST(sum(kept - merged) AS BIGINT) AS after FROM e")
def a29(spark, d):
    return delta.optimise_all(t.versions(spark, d))


@add("a30_chain_bytes", f"WITH {NODES} SELECT user_id, CAST(sum(length('{{\"' || node_type || '\":\"' || k || '\"}}')) AS BIGINT) AS bytes FROM nodes GROUP BY 1")
def a30(spark, d):
    n = t.nodes(spark, d).withColumn("content", F.create_map("node_type", F.col("k").cast("string"))).withColumn("ops", F.lit(1))
    return delta.analyse_chains(n, "user_id", "ops", "t").select("user_id", "bytes")


@add("a31_record_size", f"WITH {CHAIN} SELECT node_id, CAST(40 + CASE WHEN parent_id IS NULL THEN 0 ELSE 16 END + 2 + length('{{\"k\":' || k || '}}') AS BIGINT) AS bytes FROM chain")
def a31(spark, d):
    c = t.chain(t.nodes(spark, d))
    return c.select("node_id", delta.record_size(F.col("parent_id"), F.lit("{}"), F.array(F.to_json(F.struct("k")))).alias("bytes"))


@add("a33_benchmark_metrics", "SELECT event_type AS node_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_samp(value), 6) AS stddev FROM events GROUP BY 1")
def a33(spark, d):
    m = aggregates.describe(_events(spark, d), "value", "node_type")
    return m.select("node_type", "n", "min", "max", *[r6(c).alias(c) for c in ("mean", "median", "p95", "p99", "stddev")])


_BOX = "time AS t_lo, time + k AS t_hi, distance AS r_lo, distance + 0.5 AS r_hi, theta AS theta_lo, CASE WHEN k % 2 = 0 THEN theta / 2 ELSE theta + 0.3 END AS theta_hi"
_SPAN = f"(CASE WHEN theta_lo <= theta_hi THEN theta_hi - theta_lo ELSE {PI2} - (theta_lo - theta_hi) END)"


def _boxes(spark, d):
    hi = F.when(F.col("k") % 2 == 0, F.col("theta") / 2).otherwise(F.col("theta") + 0.3)
    return t.nodes(spark, d).select("node_id", "time", "distance", "theta", "k", g.box_column(t_lo="time", t_hi=F.col("time") + F.col("k"), r_lo="distance", r_hi=F.col("distance") + 0.5, theta_lo="theta", theta_hi=hi).alias("box"))


@add("a35_box_volume", f"WITH {NODES}, b AS (SELECT node_id, {_BOX} FROM nodes) SELECT node_id, round((t_hi - t_lo) * (r_hi * r_hi - r_lo * r_lo) * {_SPAN} / 2.0, 8) AS volume FROM b")
def a35(spark, d):
    return _boxes(spark, d).select("node_id", F.round(g.box_volume(F.col("box")), 8).alias("volume"))


@add("a36_box_margin", f"WITH {NODES}, b AS (SELECT node_id, {_BOX} FROM nodes) SELECT node_id, round(2.0 * ((t_hi - t_lo) + (r_hi - r_lo) + (r_hi + r_lo) / 2.0 * {_SPAN}), 8) AS margin FROM b")
def a36(spark, d):
    return _boxes(spark, d).select("node_id", F.round(g.box_margin(F.col("box")), 8).alias("margin"))


@add("a38_next_time", f"WITH {NODES} SELECT user_id, round(max(time) + 1, 6) AS time FROM nodes GROUP BY 1")
def a38(spark, d):
    return aggregates.mean_position(t.nodes(spark, d), "user_id").select("user_id", r6("time").alias("time"))


# nearest, pages


@add("l03_incremental_nearest", f"WITH {NODES} SELECT node_id, round(sqrt(power(x - 0.2, 2) + power(y - 0.2, 2)), 6) AS d FROM nodes WHERE sqrt(power(x - 0.2, 2) + power(y - 0.2, 2)) <= 0.15")
def l03(spark, d):
    n = t.nodes(spark, d)
    apart = F.sqrt((F.col("x") - 0.2) ** 2 + (F.col("y") - 0.2) ** 2)
    return search.incremental_nearest(n, apart, max_distance=0.15).select("node_id", r6("d").alias("d"))


@add("l05_least_box_distance", f"WITH {NODES}, p AS (SELECT node_id, greatest(0, 100 - time, time - 200) AS a, greatest(0, 0.3 - distance, distance - 0.6) AS b, CASE WHEN theta BETWEEN 1.0 AND 2.0 THEN 0.0 ELSE least(1.0 - theta - floor((1.0 - theta) / {PI2}) * {PI2}, theta - 2.0 - floor((theta - 2.0) / {PI2}) * {PI2}) END AS c FROM nodes) SELECT node_id, round(sqrt(a * a + b * b + c * c), 6) AS d FROM p")
def l05(spark, d):
    return t.nodes(spark, d).select("node_id", r6(g.box_min_distance(g.Box(100.0, 200.0, 0.3, 0.6, 1.0, 2.0), "time", "distance", "theta")).alias("d"))


@add("l09_page_numbers", "SELECT p AS page, CAST(ceil(n / 100.0) AS BIGINT) AS pages, p < ceil(n / 100.0) AS has_next, p > 1 AS has_previous FROM (SELECT count(*) AS n FROM events), (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT)), (CAST(100000 AS BIGINT))) v(p)")
def l09(spark, d):
    total = results.Result(_events(spark, d)).count()
    made = [results.Pages(total, 100, p) for p in (1, 2, 100000)]
    return spark.createDataFrame([(m.page, m.count, m.has_next, m.has_previous) for m in made], "page long, pages long, has_next boolean, has_previous boolean")


@add("l11_request_page", f"WITH {NODES}, f AS (SELECT node_id, t FROM nodes WHERE t BETWEEN {START} AND {START + 9 * DAY}) SELECT node_id, (SELECT count(*) FROM f) AS total, CAST(4 AS BIGINT) AS page FROM f ORDER BY t DESC, node_id LIMIT 25 OFFSET 75")
def l11(spark, d):
    made = results.execute_query({"temporal_criteria": {"start": START, "end": START + 9 * DAY}, "sort_by": "temporal", "sort_order": "desc", "limit": 25, "offset": 75}, t.nodes(spark, d))
    return made["rows"].select("node_id", F.lit(made["total"]).cast("long").alias("total"), F.lit(made["page"]).cast("long").alias("page"))


@add("l12_limits_checked", "SELECT * FROM (VALUES ('plain', true), ('zero limit', false), ('negative offset', false), ('offset', true)) v(name, valid)")
def l12(spark, d):
    c = Content("k", ">", 1)
    return _flags(spark, ["plain", "zero limit", "negative offset", "offset"], _valid(lambda: Query(c, 5), lambda: Query(c, 0), lambda: Query(c, 5, -1), lambda: Query(c, 5, 3)))


@add("l13_limit", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE k > 40 ORDER BY node_id LIMIT 17")
def l13(spark, d):
    q = builder.query()
    q.content().greater_than("k", 40)
    return q.limit(17).build().run(t.nodes(spark, d)).select(*KIND)


@add("l14_offset", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE k > 40 ORDER BY node_id LIMIT 17 OFFSET 30")
def l14(spark, d):
    q = builder.query()
    q.content().greater_than("k", 40)
    return q.limit(17).offset(30).build().run(t.nodes(spark, d)).select(*KIND)


@add("l15_row_cap", f"WITH {NODES} SELECT least(count(*), 512000) AS n FROM nodes WHERE k >= 0")
def l15(spark, d):
    """How many rows a query without a limit returns under the safety cap."""
    return Query(Content("k", ">=", 0)).run(t.nodes(spark, d), row_cap=cost.ROW_CAP).agg(F.count("*").alias("n"))


# deltas


def _base(spark, d):
    content = F.to_json(F.struct(F.struct("k").alias("a"), F.array("k", F.col("user_id").cast("int")).alias("tags"), F.col("node_type").alias("kind")))
    return t.nodes(spark, d).select("node_id", "k", "user_id", "node_type", content.alias("content"))


def _op(kind: str, path: str, **more):
    return F.to_json(F.struct(F.lit(kind).alias("op"), F.array(*[F.lit(p) for p in path.split(".")]).alias("path"), *[v.alias(n) for n, v in more.items()]))


def _list(*ops):
    return F.concat(F.lit("["), F.concat_ws(",", *ops), F.lit("]"))


def _after(df, *ops):
    """Content after operations, and after they were undone."""
    made = df.withColumn("ops", _list(*ops)).withColumn("there", delta_ops.apply_json(F.col("content"), F.col("ops")))
    return made.withColumn("back", delta_ops.reverse_json(F.col("there"), F.col("ops")))


def _at(column: str, path: str, kind: str = "int"):
    return F.get_json_object(column, f"$.{path}").cast(kind)


@add("v05_set_at_path", f"WITH {NODES} SELECT node_id, CAST(user_id AS INTEGER) AS made, k, CAST(k + 1 AS INTEGER) AS changed FROM nodes")
def v05(spark, d):
    a = _after(_base(spark, d), _op("set", "n.b.c", value=F.col("user_id")), _op("set", "a.k", value=F.col("k") + 1, old=F.col("k"), had=F.lit(True)))
    return a.select("node_id", _at("there", "n.b.c").alias("made"), _at("content", "a.k").alias("k"), _at("there", "a.k").alias("changed"))


@add("v06_delete_at_path", f"WITH {NODES} SELECT node_id, CAST(NULL AS INTEGER) AS k, node_type AS kind FROM nodes")
def v06(spark, d):
    return _after(_base(spark, d), _op("delete", "a.k", old=F.col("k")), _op("delete", "none.there", old=F.lit(0))).select("node_id", _at("there", "a.k").alias("k"), _at("there", "kind", "string").alias("kind"))


@add("v07_insert_clamped", f"WITH {NODES} SELECT node_id, CAST(CASE WHEN k % 5 = 0 THEN 7 ELSE k END AS INTEGER) AS a, CAST(CASE WHEN k % 5 = 0 THEN k WHEN k % 5 = 1 THEN 7 ELSE user_id END AS INTEGER) AS b, CAST(CASE WHEN k % 5 < 2 THEN user_id ELSE 7 END AS INTEGER) AS c FROM nodes")
def v07i(spark, d):
    a = _after(_base(spark, d), _op("array_insert", "tags", index=F.col("k") % 5, value=F.lit(7)))
    return a.select("node_id", *[_at("there", f"tags[{i}]").alias(n) for i, n in enumerate("abc")])


@add("v08_array_delete", f"WITH {NODES} SELECT node_id, CAST(CASE WHEN k % 4 = 0 THEN user_id ELSE k END AS INTEGER) AS a, CAST(CASE WHEN k % 4 > 1 THEN user_id END AS INTEGER) AS b FROM nodes")
def v08(spark, d):
    a = _after(_base(spark, d), _op("array_delete", "tags", index=F.col("k") % 4, value=F.lit(0)))
    return a.select("node_id", *[_at("there", f"tags[{i}]").alias(n) for i, n in enumerate("ab")])


def _text_op():
    edit = F.array(F.array(F.lit("replace"), F.lit("0"), F.lit("<"), F.substring("node_type", 1, 1)), F.array(F.lit("insert"), F.lit("2"), F.lit("+"), F.lit("")))
    raw = F.to_json(F.struct(F.lit("text").alias("op"), F.array(F.lit("kind")).alias("path"), edit.alias("edits")))
    # places are numbers
    return F.regexp_replace(raw, r'"(\d)"', "$1")


@add("v09_edits_from_the_right", "SELECT event_id AS node_id, '<' || event_type[2:2] || '+' || event_type[3:] AS kind, event_type AS back FROM events")
def v09e(spark, d):
    a = _after(_base(spark, d), _text_op())
    return a.select("node_id", _at("there", "kind", "string").alias("kind"), _at("back", "kind", "string").alias("back"))


@add("v10_composite", f"WITH {NODES} SELECT node_id, CAST(k + 5 AS INTEGER) AS k, CAST(k AS INTEGER) AS first, CAST(1 AS INTEGER) AS last FROM nodes")
def v10(spark, d):
    ops = _list(_op("set", "a.k", value=F.col("k") + 5, old=F.col("k"), had=F.lit(True)), _op("array_insert", "tags", index=F.lit(9), value=F.lit(1)))
    a = _after(_base(spark, d), F.concat(F.lit('{"op":"composite","ops":'), ops, F.lit("}")))
    return a.select("node_id", _at("there", "a.k").alias("k"), _at("there", "tags[0]").alias("first"), _at("there", "tags[2]").alias("last"))


@add("v11_undo_set", f"WITH {NODES} SELECT node_id, k, CAST(NULL AS INTEGER) AS made FROM nodes")
def v11(spark, d):
    a = _after(_base(spark, d), _op("set", "a.k", value=F.lit(-1), old=F.col("k"), had=F.lit(True)), _op("set", "a.new", value=F.lit(3), had=F.lit(False)))
    return a.select("node_id", _at("back", "a.k").alias("k"), _at("back", "a.new").alias("made"))


@add("v12_undo_delete", f"WITH {NODES} SELECT node_id, CAST(NULL AS INTEGER) AS gone, k AS back FROM nodes")
def v12(spark, d):
    a = _after(_base(spark, d), _op("delete", "a.k", old=F.col("k")))
    return a.select("node_id", _at("there", "a.k").alias("gone"), _at("back", "a.k").alias("back"))


@add("v13_undo_insert", f"WITH {NODES} SELECT node_id, CAST(9 AS INTEGER) AS there, CAST(user_id AS INTEGER) AS back FROM nodes")
def v13(spark, d):
    a = _after(_base(spark, d), _op("array_insert", "tags", index=F.lit(1), value=F.lit(9)))
    return a.select("node_id", _at("there", "tags[1]").alias("there"), _at("back", "tags[1]").alias("back"))


@add("v14_undo_array_delete", f"WITH {NODES} SELECT node_id, CAST(user_id AS INTEGER) AS there, k AS back FROM nodes")
def v14(spark, d):
    a = _after(_base(spark, d), _op("array_delete", "tags", index=F.lit(0), value=F.col("k")))
    return a.select("node_id", _at("there", "tags[0]").alias("there"), _at("back", "tags[0]").alias("back"))


@add("v15_undo_edits", "SELECT event_id AS node_id, event_type AS kind, length(event_type) + 1 AS letters FROM events")
def v15(spark, d):
    a = _after(_base(spark, d), _text_op())
    return a.select("node_id", _at("back", "kind", "string").alias("kind"), F.length(_at("there", "kind", "string")).cast("long").alias("letters"))


@add("v16_undo_composite", f"WITH {NODES} SELECT node_id, CAST(2 AS INTEGER) AS there, k AS back FROM nodes")
def v16(spark, d):
    ops = _list(_op("set", "a.k", value=F.lit(1), old=F.col("k"), had=F.lit(True)), _op("set", "a.k", value=F.lit(2), old=F.lit(1), had=F.lit(True)))
    a = _after(_base(spark, d), F.concat(F.lit('{"op":"composite","ops":'), ops, F.lit("}")))
    return a.select("node_id", _at("there", "a.k").alias("there"), _at("back", "a.k").alias("back"))


def _some_ops():
    """None to five sets, by k."""
    made = F.array(*[_op("set", n, value=F.lit(i), had=F.lit(False)) for i, n in enumerate("pqrst")])
    return F.concat(F.lit("["), F.concat_ws(",", F.slice(made, F.lit(1), F.col("k") % 6)), F.lit("]"))


@add("v17_record_applied", f"WITH {NODES} SELECT node_id, CAST(CASE WHEN k % 6 > 0 THEN 0 END AS INTEGER) AS p, CAST(CASE WHEN k % 6 > 2 THEN 2 END AS INTEGER) AS r, CAST(CASE WHEN k % 6 > 4 THEN 4 END AS INTEGER) AS t FROM nodes")
def v17(spark, d):
    a = _base(spark, d).withColumn("there", delta_ops.apply_json(F.col("content"), _some_ops()))
    return a.select("node_id", *[_at("there", n).alias(n) for n in "prt"])


@add("v18_record_undone", f"WITH {NODES} SELECT node_id, true AS same, k % 6 = 0 AS untouched FROM nodes")
def v18(spark, d):
    a = _base(spark, d).withColumn("ops", _some_ops()).withColumn("plain", delta_ops.apply_json(F.col("content"), F.lit("[]")))
    a = a.withColumn("there", delta_ops.apply_json(F.col("content"), F.col("ops")))
    return a.select("node_id", (delta_ops.reverse_json(F.col("there"), F.col("ops")) == F.col("plain")).alias("same"), (F.col("there") == F.col("plain")).alias("untouched"))


@add("v19_summary", f"WITH {NODES} SELECT node_id, CASE k % 6 WHEN 0 THEN 'No changes' WHEN 1 THEN 'set p' WHEN 2 THEN '2 changes: set p, set q' WHEN 3 THEN '3 changes: set p, set q, set r' WHEN 4 THEN '4 changes: set p, set q, set r and 1 more' ELSE '5 changes: set p, set q, set r and 2 more' END AS said FROM nodes")
def v19(spark, d):
    return _base(spark, d).select("node_id", delta_ops.summary_json(_some_ops()).alias("said"))


@add("v22_latest_content", f"WITH {NODES} SELECT user_id, {_last()} FROM nodes GROUP BY 1")
def v22(spark, d):
    n = t.nodes(spark, d)
    w = delta.running_states(n, "user_id", ORDER, NAMES).withColumn("_at", F.struct(*ORDER))
    last = w.groupBy("user_id").agg(*[F.max_by(f"state_{n}", "_at").cast("double").alias(n) for n in NAMES])
    return last


@add("v23_checkpoint", f"WITH {NODES} SELECT user_id, {START + 12 * DAY}::DOUBLE AS ts, {_last()} FROM nodes WHERE t <= {START + 12 * DAY} GROUP BY 1")
def v23(spark, d):
    c = delta.checkpoints(t.nodes(spark, d), "user_id", ORDER, START + 12 * DAY)
    return c.select("user_id", "ts", *[F.col("content").getItem(n).cast("double").alias(n) for n in NAMES])


@add("v29_deltas_of_node", f"WITH {CHAIN} SELECT node_id, parent_id, seq FROM chain WHERE user_id = 3")
def v29(spark, d):
    return t.chain(t.nodes(spark, d).where("user_id = 3")).select("node_id", "parent_id", "seq")


@add("v30_node_at_time", f"WITH {VERSIONS}, f AS (SELECT node_id, max_by(status, version) AS status, max(version) AS version FROM versions WHERE o_orderdate <= TIMESTAMP '1994-06-30 00:00:00' GROUP BY 1) SELECT DISTINCT c_custkey AS node_id, f.version, f.status FROM customer LEFT JOIN f ON c_custkey = node_id")
def v30(spark, d):
    """Nodes that had not begun then are there without a state."""
    at = store.as_of(t.versions(spark, d), F.lit("1994-06-30 00:00:00").cast("timestamp_ntz"), when="o_orderdate").select("node_id", "version", "status")
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")).join(at, "node_id", "left")


@add("v32_text_diff", "SELECT event_id AS node_id, CAST(1 AS INTEGER) AS n, 'insert' AS kind, CAST(length(event_type) AS INTEGER) AS pos, '#' || event_id AS new FROM events")
def v32(spark, d):
    e = _events(spark, d)
    edits = delta_ops.diff_text(F.col("node_type"), F.concat("node_type", F.lit("#"), F.col("node_id").cast("string")))
    return e.select("node_id", edits.alias("e")).select("node_id", F.json_array_length("e").alias("n"), F.get_json_object("e", "$[0][0]").alias("kind"), F.get_json_object("e", "$[0][1]").cast("int").alias("pos"), F.get_json_object("e", "$[0][2]").alias("new"))


@add("v33_detected", f"WITH {NODES} SELECT node_id, CASE WHEN k % 2 = 0 THEN 'set a.k,delete b,set c' ELSE 'delete b,set c' END AS said FROM nodes")
def v33(spark, d):
    n = t.nodes(spark, d)
    old = F.to_json(F.struct(F.struct("k").alias("a"), F.col("k").alias("b")))
    new = F.to_json(F.struct(F.struct((F.col("k") + F.when(F.col("k") % 2 == 0, 1).otherwise(0)).alias("k")).alias("a"), F.lit(1).alias("c")))
    ops = F.from_json(delta_ops.detect_json(old, new), "array<struct<op:string,path:array<string>>>")
    return n.select("node_id", F.concat_ws(",", F.transform(ops, lambda o: F.concat(o["op"], F.lit(" "), F.concat_ws(".", o["path"])))).alias("said"))


@add("v34_array_diff", f"WITH {NODES} SELECT node_id, 'array_delete 1,array_insert 2' AS said FROM nodes")
def v34(spark, d):
    n = t.nodes(spark, d)
    old, new = (F.to_json(F.struct(F.array(*[F.col("k") + i for i in at]).alias("l"))) for at in ((0, 1, 2), (0, 2, 3)))
    ops = F.from_json(delta_ops.detect_json(old, new), "array<struct<op:string,index:int>>")
    return n.select("node_id", F.concat_ws(",", F.transform(ops, lambda o: F.concat(o["op"], F.lit(" "), o["index"].cast("string")))).alias("said"))


@add("v35_long_text_diff", "SELECT c_custkey, CASE WHEN c_custkey % 12 + 1 > 5 THEN 'text' ELSE 'set' END AS op FROM customer")
def v35(spark, d):
    """Long texts of like lengths get edits, others are set anew."""
    body = F.repeat("c_name", (F.col("c_custkey") % 12 + 1).cast("int"))
    old, new = (F.to_json(F.struct(b.alias("body"))) for b in (body, F.concat(body, F.lit(" end"))))
    return t.table(spark, d, "customer").select("c_custkey", F.get_json_object(delta_ops.detect_json(old, new), "$[0].op").alias("op"))


@add("v36_optimised_ops", f"WITH {NODES} SELECT node_id, CAST(2 AS INTEGER) AS n, CAST(k + 1 AS INTEGER) AS value, k AS old FROM nodes")
def v36(spark, d):
    ops = _list(_op("set", "a", value=F.lit(0), old=F.col("k"), had=F.lit(True)), _op("set", "a", value=F.col("k") + 1, old=F.lit(0), had=F.lit(True)), _op("set", "b", value=F.lit(1), had=F.lit(False)))
    made = t.nodes(spark, d).select("node_id", delta_ops.optimise_json(ops).alias("o"))
    return made.select("node_id", F.json_array_length("o").alias("n"), F.get_json_object("o", "$[0].value").cast("int").alias("value"), F.get_json_object("o", "$[0].old").cast("int").alias("old"))


@add("v41_merged_deltas", f"WITH {CHAIN} SELECT user_id, {_last('seq BETWEEN 2 AND 6')} FROM chain WHERE seq BETWEEN 2 AND 6 GROUP BY 1")
def v41(spark, d):
    return _flat(delta.fold_states(t.chain(t.nodes(spark, d)), "user_id", ORDER, until=F.col("seq").between(2, 6)))


@add("v43_packed_deltas", "SELECT event_id AS node_id, event_type AS kind, CAST(value AS DOUBLE) AS value FROM events")
def v43(spark, d):
    n = t.nodes(spark, d).select("node_id", "content")
    back = store.unpack_rows(store.pack_rows(n), n.schema)
    return back.select("node_id", F.explode("content").alias("kind", "value")).withColumn("value", F.col("value").cast("double"))


@add("v44_pruned_chain", f"WITH {NODES} SELECT user_id, count(*) FILTER (t > {START + 10 * DAY}) AS kept, CAST(bool_or(t <= {START + 10 * DAY}) AS INTEGER) AS checkpoints FROM nodes GROUP BY 1")
def v44(spark, d):
    base, rest = delta.prune(t.nodes(spark, d), "user_id", ORDER, START + 10 * DAY)
    a = rest.groupBy("user_id").agg(F.count("*").alias("kept"))
    b = base.groupBy("user_id").agg(F.count("*").cast("int").alias("checkpoints"))
    return a.join(b, "user_id", "full").select("user_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("checkpoints", F.lit(0)).alias("checkpoints"))


@add("v46_merged_data", f"WITH {NODES} SELECT node_id, CAST(k AS VARCHAR) AS old, 'x' AS new, CASE WHEN k % 2 = 0 THEN '0' ELSE CAST(user_id AS VARCHAR) END AS both FROM nodes")
def v46(spark, d):
    old = F.create_map(F.lit("old"), F.col("k").cast("string"), F.lit("both"), F.col("user_id").cast("string"))
    new = F.create_map(F.lit("new"), F.lit("x"))
    merged = s.merge_maps(old, F.when(F.col("k") % 2 == 0, F.map_concat(new, F.create_map(F.lit("both"), F.lit("0")))).otherwise(new))
    return t.nodes(spark, d).select("node_id", *[merged[c].alias(c) for c in ("old", "new", "both")])


@add("v47_references", f"WITH {CHAIN} SELECT node_id, CAST(CASE WHEN parent_id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS added, CAST(CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS removed FROM chain")
def v47(spark, d):
    """References with the node itself added once, and taken out again."""
    refs = F.array_compact(F.array("parent_id"))
    more = F.array_union(F.array_union(refs, F.array("node_id")), F.array("node_id"))
    return t.chain(t.nodes(spark, d)).select("node_id", F.size(more).alias("added"), F.size(F.array_except(more, F.array("node_id"))).alias("removed"))


@add("v48_two_versions", f"WITH {VERSIONS}, a AS (SELECT node_id, status, priority FROM versions WHERE version = 1), b AS (SELECT node_id, status, priority FROM versions WHERE version = 3) SELECT node_id, a.status <> b.status AS status_changed, a.priority <> b.priority AS priority_changed FROM a JOIN b USING (node_id)")
def v48(spark, d):
    v = t.versions(spark, d)
    a, b = (delta.reconstruct(v, k, ["status", "priority"]).select("node_id", F.struct("status", "priority").alias(n)) for k, n in ((1, "a"), (3, "b")))
    return a.join(b, "node_id").select("node_id", (F.col("a.status") != F.col("b.status")).alias("status_changed"), (F.col("a.priority") != F.col("b.priority")).alias("priority_changed"))


@add("v50_branch_states", f"WITH {NODES} SELECT k % 4 AS branch, user_id, {_last()} FROM nodes GROUP BY 1, 2")
def v50(spark, d):
    n = t.nodes(spark, d).withColumn("branched", F.struct((F.col("k") % 4).alias("branch"), "user_id"))
    return _flat(delta.fold_states(n, "branched", ORDER), "branched").select("branched.branch", "branched.user_id", *NAMES)


# graph


@add("g02_typed_edges", f"WITH {EDGES} SELECT src, dst, type, strength FROM edges UNION ALL SELECT node_id, node_id + 1, 'NEXT', 0.5 FROM nodes WHERE k = 3")
def g02(spark, d):
    n = t.nodes(spark, d)
    new = n.where("k = 3").select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"), F.lit("NEXT").alias("type"), F.lit(0.5).alias("strength"))
    return graph.add_edges(t.edges(n), new)


@add("g04_default_type", f"WITH {EDGES} SELECT src, dst, type FROM edges UNION ALL SELECT node_id, node_id + 2, 'RELATED_TO' FROM nodes WHERE k = 5")
def g04(spark, d):
    n = t.nodes(spark, d)
    new = n.where("k = 5").select(F.col("node_id").alias("src"), (F.col("node_id") + 2).alias("dst"), F.lit(1.0).alias("strength"))
    return graph.add_edges(t.edges(n), new).select("src", "dst", "type")


@add("g06_neighbourhood", f"WITH {EDGES} SELECT dst AS from_id, src AS node_id FROM edges WHERE type = 'click'")
def g06(spark, d):
    n = t.nodes(spark, d)
    return joins.connected_nodes(t.edges(n), n.select("node_id"), "click", "incoming").select("from_id", "node_id")


# scalars


@add("h01_merged_maps", f"WITH {NODES} SELECT node_id, CASE WHEN k < 50 THEN 'new' ELSE 'old' END AS a, 'kept' AS b FROM nodes")
def h01(spark, d):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept"))
    new = F.when(F.col("k") < 50, F.create_map(F.lit("a"), F.lit("new")))
    m = s.merge_maps(old, new)
    return t.nodes(spark, d).select("node_id", m["a"].alias("a"), m["b"].alias("b"))


@add("h05_precedes", "SELECT event_id AS node_id, ts < TIMESTAMP '2024-01-15 00:00:00' AS before FROM events")
def h05(spark, d):
    return t.nodes(spark, d).select("node_id", s.precedes(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("before"))


@add("h06_equal_at_day", "SELECT event_id AS node_id, date_trunc('day', ts) = TIMESTAMP '2024-01-10 00:00:00' AS same FROM events")
def h06(spark, d):
    return t.nodes(spark, d).select("node_id", s.equal_at(F.col("ts"), F.lit("2024-01-10 17:30:00").cast("timestamp_ntz"), "day", "minute").alias("same"))


_ARC = f"least(abs(theta - 1.5), {PI2} - abs(theta - 1.5))"


@add("h07_arc_distance", f"WITH {NODES} SELECT node_id, round(sqrt(power(time - 10, 2) + power(distance - 0.4, 2) + power(least(distance, 0.4) * {_ARC}, 2)), 5) AS d FROM nodes")
def h07(spark, d):
    return t.nodes(spark, d).select("node_id", F.round(g.arc_distance("time", "distance", "theta", 10.0, 0.4, 1.5), 5).alias("d"))


@add("h08_typed_distance", f"WITH {NODES} SELECT node_id, round(sqrt(power(time - 10, 2) + power(distance - 0.4, 2) + power((distance + 0.4) / 2.0 * least(abs(theta - 1.5), 2 * 3.14159::DOUBLE - abs(theta - 1.5)), 2)), 5) AS d FROM nodes")
def h08(spark, d):
    return t.nodes(spark, d).select("node_id", F.round(g.typed_distance("time", "distance", "theta", 10.0, 0.4, 1.5), 5).alias("d"))


@add("h11_from_cartesian", f"WITH {NODES} SELECT node_id, round(sqrt(x * x + y * y), 6) AS r, round(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + {PI2} ELSE atan2(y, x) END, 6) AS theta FROM nodes WHERE distance > 0")
def h11(spark, d):
    r, theta = g.from_cartesian("x", "y")
    return t.nodes(spark, d).where("distance > 0").select("node_id", r6(r).alias("r"), r6(theta).alias("theta"))


@add("h12_metrics", f"WITH {VECTORS} SELECT vec_id, round(sqrt(list_sum(list_transform(dims[1:3], lambda x: x * x))), 6) AS l2, round(list_sum(list_transform(dims[1:3], lambda x: abs(x))), 6) AS l1, round(list_max(list_transform(dims[1:3], lambda x: abs(x))), 6) AS linf FROM vectors")
def h12(spark, d):
    zero = F.array(*[F.lit(0.0)] * 3)
    return t.vectors(spark, d).select("vec_id", *[r6(g.metric_distance(F.col("dims"), zero, m)).alias(n) for m, n in (("euclidean", "l2"), ("manhattan", "l1"), ("chebyshev", "linf"))])


@add("h14_merged_boxes", f"WITH {NODES} SELECT node_id, round(least(time, 100.0), 6) AS t_lo, round(greatest(time + 1, 200.0), 6) AS t_hi, round(least(theta, 0.5), 6) AS theta_lo, round(greatest(theta + 0.1, 0.7), 6) AS theta_hi FROM nodes WHERE theta < 3")
def h14(spark, d):
    """Two boxes within half a turn: the smallest around both."""
    n = t.nodes(spark, d).where("theta < 3")
    own = g.box_column(t_lo="time", t_hi=F.col("time") + 1.0, r_lo="distance", r_hi="distance", theta_lo="theta", theta_hi=F.col("theta") + 0.1)
    other = g.box_column(**{c: F.lit(x) for c, x in zip(g.BOX_FIELDS, (100.0, 200.0, 0.2, 0.3, 0.5, 0.7), strict=True)})
    m = n.select("node_id", g.box_merge(own, other).alias("m"))
    return m.select("node_id", *[r6(f"m.{c}").alias(c) for c in ("t_lo", "t_hi", "theta_lo", "theta_hi")])


@add("h19_recency", f"WITH {NODES} SELECT user_id, round(max(time) / count(*), 6) AS recency FROM nodes GROUP BY 1")
def h19(spark, d):
    n = t.nodes(spark, d).groupBy("user_id").agg(F.max("time").alias("last"), F.count("*").alias("n"))
    return n.select("user_id", r6(s.recency_score(F.col("last"), F.col("n"))).alias("recency"))


@add("h21_verified", f"WITH {FACTS} SELECT fact_id, round(least(1.0::DOUBLE, confidence + 0.1), 6) AS more, round(0.25::DOUBLE, 6) AS stated FROM facts")
def h21(spark, d):
    return t.facts(spark, d).select("fact_id", r6(s.verified(F.col("confidence"))).alias("more"), r6(s.verified(F.col("confidence"), F.lit(0.25))).alias("stated"))


@add("h23_tokens", "SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS INTEGER) AS n FROM conversations WHERE text IS NOT NULL")
def h23(spark, d):
    return t.messages(spark, d).where("text is not null").select("conv_id", "turn", F.size(s.tokens(F.col("text"))).alias("n"))


@add("h24_speaker", """SELECT conv_id, turn, CASE WHEN contains(text, '"') OR contains(text, '''') THEN 'character' ELSE 'narrator' END AS speaker FROM conversations""")
def h24(spark, d):
    return t.messages(spark, d).select("conv_id", "turn", s.speaker(F.col("text")).alias("speaker"))


@add("h26_places", "SELECT n_nationkey, CAST(contains(n_name, 'IN') AS INTEGER) + CAST(contains(n_name, 'AN') AS INTEGER) AS n FROM nation")
def h26(spark, d):
    return t.table(spark, d, "nation").select("n_nationkey", F.size(s.mentions(F.col("n_name"), ["IN", "AN"])).alias("n"))


@add("h27_whole_words", "SELECT conv_id, turn, CAST(regexp_matches(text, '(?i)\\bthe\\b') AS INTEGER) AS n FROM conversations")
def h27(spark, d):
    return t.messages(spark, d).select("conv_id", "turn", F.size(s.mentions(F.col("text"), ["THE"], whole_word=True)).alias("n"))


@add("h30_truncated", "SELECT c_custkey, CASE WHEN length(c_name || c_name) > 20 THEN (c_name || c_name)[1:17] || '...' ELSE c_name || c_name END AS short FROM customer")
def h30(spark, d):
    return t.table(spark, d, "customer").select("c_custkey", s.truncated(F.concat("c_name", "c_name"), 20).alias("short"))


@add("h32_delta_position", f"""WITH {NODES}, u AS (SELECT *, CAST(('0x' || md5('7-' || node_id)[1:6]) AS BIGINT) / 16777216.0::DOUBLE * 2 - 1 AS a, CAST(('0x' || md5('8-' || node_id)[1:6]) AS BIGINT) / 16777216.0::DOUBLE * 2 - 1 AS b FROM nodes)
    SELECT node_id, round(time + 1, 6) AS time, round(greatest(0.1, distance + a * 0.2 * (k / 100.0)), 6) AS distance, round((angle + b * 5 * (k / 100.0)) - 360 * floor((angle + b * 5 * (k / 100.0)) / 360), 6) AS angle FROM u""")
def h32(spark, d):
    n = t.nodes(spark, d)
    made = s.delta_position(F.col("time") + 1.0, F.col("distance"), F.col("angle"), F.col("k") / 100.0, F.col("node_id"), seed=7)
    return n.select("node_id", *[r6(c).alias(name) for c, name in zip(made, ("time", "distance", "angle"), strict=True)])


@add("h36_uuid_form", "SELECT event_id AS node_id, event_id % 2 = 0 AS valid FROM events")
def h36(spark, d):
    text = F.when(F.col("node_id") % 2 == 0, F.concat(F.lpad(F.hex("node_id"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))).otherwise(F.col("node_id").cast("string"))
    return _events(spark, d).select("node_id", s.is_uuid(text).alias("valid"))


@add("h37_query_json", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE k > 20 AND t <= {START + 8 * DAY} ORDER BY node_id LIMIT 50")
def h37(spark, d):
    """A query to JSON and back gives the same rows."""
    q = Query(Content("k", ">", 20) & Temporal(end_time=START + 8 * DAY), 50)
    back = Query.from_json(q.to_json())
    assert back.key() == q.key()
    return back.run(t.nodes(spark, d)).select(*KIND)


@add("h40_branch_local", f"WITH {NODES}, l AS (SELECT node_id, x - 0.3 * cos(1.0) AS a, y - 0.3 * sin(1.0) AS b FROM nodes) SELECT node_id, round(sqrt(a * a + b * b), 6) AS r, round(a, 6) AS x, round(b, 6) AS y FROM l")
def h40(spark, d):
    r, theta = g.to_local("distance", "theta", F.lit(0.3), F.lit(1.0))
    x, y = g.to_cartesian(r, theta)
    return t.nodes(spark, d).select("node_id", r6(r).alias("r"), r6(x).alias("x"), r6(y).alias("y"))


@add("h41_branch_global", f"WITH {NODES} SELECT node_id, round(x, 6) AS x, round(y, 6) AS y FROM nodes")
def h41(spark, d):
    """Local coordinates turned back."""
    n = t.nodes(spark, d)
    r, theta = g.to_local("distance", "theta", F.lit(0.3), F.lit(1.0))
    n = n.select("node_id", r.alias("r"), theta.alias("a"))
    x, y = g.to_cartesian(*g.to_global("r", "a", F.lit(0.3), F.lit(1.0)))
    return n.select("node_id", r6(x).alias("x"), r6(y).alias("y"))


@add("h42_chord_distance", f"WITH {NODES} SELECT node_id, round(sqrt(2 * power(time - 10, 2) + power(distance - 0.4, 2) + 3 * distance * 0.4 * (1 - cos(theta - 1.5))), 5) AS d FROM nodes")
def h42(spark, d):
    return t.nodes(spark, d).select("node_id", F.round(g.chord_distance("time", "distance", "theta", 10.0, 0.4, 1.5, 2.0, 1.0, 3.0), 5).alias("d"))


# planner, requests


@add("o06_selectivities", "SELECT * FROM (VALUES ('spatial', 0.25::DOUBLE), ('unknown place', 0.1::DOUBLE), ('temporal', 0.5::DOUBLE), ('open time', 0.2::DOUBLE), ('both', 0.1875::DOUBLE), ('two filters', 0.49::DOUBLE)) v(name, share)")
def o06(spark, d):
    year = cost.YEAR_SECONDS
    rows = [("spatial", cost.spatial_selectivity((0, 0, 1, 1), (0, 0, 2, 2))), ("unknown place", cost.spatial_selectivity(None, (0, 0, 2, 2))), ("temporal", cost.temporal_selectivity(0.0, year / 2)), ("open time", cost.temporal_selectivity(None, 1.0)), ("both", cost.combined_selectivity(0.25, 0.5)), ("two filters", round(cost.filter_selectivity(2), 6))]
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "name string, share double")


@add("o19_bucket_advice", "SELECT * FROM (VALUES (10, 1800.0::DOUBLE, 'uneven'), (2, 3600.0::DOUBLE, 'even'), (3, 1800.0::DOUBLE, 'full')) v(k, seconds, reason)")
def o19(spark, d):
    made = [(10, cost.bucket_advice(3600.0, 1000, 100.0)), (2, cost.bucket_advice(3600.0, 200, 100.0)), (3, cost.bucket_advice(3600.0, 1500, 600.0))]
    return spark.createDataFrame([(k, a.bucket_seconds, a.reason) for k, a in made], "k int, seconds double, reason string")


@add("u08_statistics", f"WITH {NODES} SELECT count(*) AS nodes, count(DISTINCT node_type) AS kinds, count(DISTINCT user_id) AS users, min(t) AS first, max(t) AS last FROM nodes")
def u08(spark, d):
    return results.server_statistics(t.nodes(spark, d))


@add("u09_spatial_request", f"WITH {NODES} SELECT node_id FROM nodes WHERE x BETWEEN 0 AND 0.4 AND y BETWEEN 0 AND 0.4 ORDER BY node_id LIMIT 60")
def u09(spark, d):
    return results.spatial_query(t.nodes(spark, d), region=((0.0, 0.0), (0.4, 0.4)), limit=60)["rows"].select("node_id")


@add("u10_temporal_request", f"WITH {NODES} SELECT node_id FROM nodes WHERE t >= {START + 5 * DAY} ORDER BY node_id LIMIT 80")
def u10(spark, d):
    return results.temporal_query(t.nodes(spark, d), START + 5 * DAY, limit=80)["rows"].select("node_id")


@add("u11_combined_request", f"WITH {NODES} SELECT node_id FROM nodes WHERE t BETWEEN {START} AND {START + 5 * DAY} AND power(x, 2) + power(y, 2) <= 0.5 * 0.5::DOUBLE ORDER BY node_id LIMIT 100")
def u11(spark, d):
    return results.combined_query(t.nodes(spark, d), {"point": (0.0, 0.0), "distance": 0.5}, {"start": START, "end": START + 5 * DAY})["rows"].select("node_id")


# more sources, streams, ids


@add("sc16_message_blocks", "SELECT c_custkey, i AS index, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, c_name || ' ' || i AS content FROM customer, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) v(i)")
def sc16(spark, d):
    parts = [F.concat(F.lit(f"### {'Assistant' if i % 2 else 'User'}\n\n"), "c_name", F.lit(f" {i}\n\n")) for i in range(3)]
    m = t.table(spark, d, "customer").select("c_custkey", F.concat(*parts).alias("messages"))
    return text_source.parse_messages(m).select("c_custkey", F.col("index").cast("long").alias("index"), "role", "content")


@add("sc17_conversation_files", "SELECT CAST(0 AS BIGINT) AS index, 'user' AS role, n_name AS content, 'About ' || n_name AS title FROM nation")
def sc17(spark, d):
    """A Markdown file for each nation, written and loaded whole."""
    path = f"{store.shared_dir(spark)}/markdown-{uuid.uuid4().hex}"
    n = t.table(spark, d, "nation")
    value = F.concat(F.lit("# About "), "n_name", F.lit("\n\n## Messages\n\n### User\n\n"), "n_name", F.lit("\n"))
    n.select(F.concat("n_nationkey", F.lit("")).alias("part"), value.alias("value")).write.partitionBy("part").text(path)
    return text_source.load_conversations(spark, f"{path}/*").select(F.col("index").cast("long").alias("index"), "role", "content", "title")


@add("sc20_upsert_one", f"WITH {VERSIONS} SELECT node_id, CAST(max(version) + CASE WHEN node_id = (SELECT min(node_id) FROM versions) THEN 1 ELSE 0 END AS BIGINT) AS version FROM versions GROUP BY node_id")
def sc20o(spark, d):
    v = t.versions(spark, d).select("node_id", "version", "status")
    one = v.agg(F.min("node_id").alias("node_id")).withColumn("status", F.lit("one"))
    return store.latest(store.upsert(v, one)).select("node_id", "version")


@add("g11_related_both_ways", "SELECT DISTINCT * FROM (SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer UNION ALL SELECT c_custkey + 1, c_custkey FROM customer)")
def g11(spark, d):
    from tesserae.operators import knowledge

    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return knowledge.related_facts(c)


@add("h13_enlarged_boxes", f"WITH {NODES} SELECT node_id, round(least(10.0, time), 6) AS t_lo, round(greatest(20.0, time), 6) AS t_hi, round(least(0.2, distance), 6) AS r_lo, round(greatest(0.4, distance), 6) AS r_hi FROM nodes")
def h13(spark, d):
    box = g.box_column(**{c: F.lit(x) for c, x in zip(g.BOX_FIELDS, (10.0, 20.0, 0.2, 0.4, 0.5, 1.0), strict=True)})
    m = t.nodes(spark, d).select("node_id", g.box_enlarge(box, "time", "distance", "theta").alias("m"))
    return m.select("node_id", *[r6(f"m.{c}").alias(c) for c in ("t_lo", "t_hi", "r_lo", "r_hi")])


@add("h29_key_events", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'first' WHEN c_custkey % 4 = 1 THEN 'second' ELSE c_name END AS event FROM customer")
def h29(spark, d):
    paras = F.array(F.lit("first"), F.lit("second"), F.col("c_name"))
    c = t.table(spark, d, "customer")
    made = F.when(F.col("c_custkey") % 4 == 0, text_source.key_event(paras, 0)).when(F.col("c_custkey") % 4 == 1, text_source.key_event(paras, 1)).otherwise(text_source.key_event(paras, 9))
    return c.select("c_custkey", made.alias("event"))


@add("h35_ordered_ids", "SELECT event_id AS node_id, lower(lpad(hex(epoch_us(ts) // 1000), 12, '0') || lpad(hex(3), 4, '0') || lpad(hex(user_id % 65536), 4, '0')) AS id FROM events")
def h35(spark, d):
    return t.nodes(spark, d).select("node_id", s.ordered_id(F.col("ts"), 3, F.col("user_id") % 65536).alias("id"))


@add("h39_query_keys", "SELECT * FROM (VALUES ('same', true), ('other value', false), ('other limit', false)) v(name, equal)")
def h39(spark, d):
    q = Query(Content("k", ">", 20), 50)
    made = {"same": Query(Content("k", ">", 20), 50), "other value": Query(Content("k", ">", 21), 50), "other limit": Query(Content("k", ">", 20), 51)}
    return spark.createDataFrame([(n, x.key() == q.key()) for n, x in made.items()], "name string, equal boolean")


@add("o12_costs", "SELECT * FROM (VALUES ('full scan', 1000.0::DOUBLE), ('filter', 5.0::DOUBLE), ('little filter', 1.0::DOUBLE), ('memory', 500.0::DOUBLE)) v(name, cost)")
def o12(spark, d):
    rows = [("full scan", cost.full_scan_cost(1000)), ("filter", cost.filter_cost(1000, 0.5)), ("little filter", cost.filter_cost(1000, 0.01)), ("memory", cost.memory_cost(1000))]
    return spark.createDataFrame([(a, round(float(b), 6)) for a, b in rows], "name string, cost double")


@add("o22_bulk_loaded", "SELECT event_id, user_id % 4 AS t_bucket FROM events")
def o22(spark, d):
    out = f"{store.shared_dir(spark)}/bulk-{uuid.uuid4().hex}"
    e = t.table(spark, d, "events").select("event_id", (F.col("user_id") % 4).cast("long").alias("t_bucket"))
    store.bulk_load(e, out)
    return spark.read.schema("event_id long, t_bucket long").parquet(out)


@add("r07_sliding_stream", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '3 hours', ts), time_bucket(INTERVAL '3 hours', ts) - INTERVAL '3 hours']) AS start FROM events) GROUP BY 1, 2")
def r07(spark, d):
    out = _streamed(spark, d, "events", lambda x: feed.sliding(x, "ts", "6 hours", "3 hours", "60 days", "event_type"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@add("r02_only_updates", f"WITH {VERSIONS} SELECT node_id, version, 'node_updated' AS event FROM versions WHERE version > 1")
def r02(spark, d):
    return feed.change_feed(t.versions(spark, d), ["node_updated"]).select("node_id", "version", "event")


@add("u07_node_requests", f"WITH {VERSIONS}, m AS (SELECT node_id, max(version) AS version FROM versions GROUP BY 1) SELECT node_id, version + CASE WHEN node_id % 10 = 1 THEN 1 ELSE 0 END AS version FROM m WHERE node_id % 10 <> 2 UNION ALL SELECT -1, CAST(1 AS BIGINT)")
def u07(spark, d):
    """One node created, some updated, some deleted; then all are read."""
    v = t.versions(spark, d).select("node_id", "version", "status")
    ids = v.select("node_id").distinct()
    made = store.upsert(v, ids.limit(1).select(F.lit(-1).cast(v.schema["node_id"].dataType).alias("node_id"), F.lit("new").alias("status")))
    made = store.upsert(made, ids.where("node_id % 10 = 1").withColumn("status", F.lit("changed")))
    made = store.tombstones(made, ids.where("node_id % 10 = 2"))
    return store.latest(made).select("node_id", "version")
