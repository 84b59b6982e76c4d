"""Slices, ranges, boxes, shapes, criteria, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import geometry as g
from tesserae.functions import scalars as s
from tesserae.operators import search
from tesserae.plans import builder
from tesserae.plans.criteria import Composite, Content, Fields, Query, Spatial, Temporal
from tesserae.plans.results import execute_query
from tesserae.queries.common import NODES, VECTORS, Registry, r6
from tesserae.sources import tables as t

QUERIES = Registry()
add = QUERIES.add
ID_TIME = ["node_id", "user_id", "node_type"]
DAY = 86400.0
START = 1704067200.0
SQUARE = [(-0.6, -0.5), (0.7, -0.4), (0.5, 0.8), (-0.3, 0.6)]
PATH = [(-0.8, -0.8), (0.0, 0.1), (0.9, 0.2)]


def _polygon_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(SQUARE, [*SQUARE[1:], SQUARE[0]], strict=True):
        at = f"((y - ({y1})::DOUBLE) * (({x2})::DOUBLE - ({x1})::DOUBLE) / (({y2})::DOUBLE - ({y1})::DOUBLE) + ({x1})::DOUBLE)"
        parts.append(f"CASE WHEN y > {min(y1, y2)} AND y <= {max(y1, y2)} AND x <= {max(x1, x2)} AND x <= {at} THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


def _segment_sql(a, b) -> str:
    dx, dy = b[0] - a[0], b[1] - a[1]
    at = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - ({a[0]})::DOUBLE) * ({dx})::DOUBLE + (y - ({a[1]})::DOUBLE) * ({dy})::DOUBLE) / ({dx * dx + dy * dy})::DOUBLE))"
    return f"sqrt(power(x - (({a[0]})::DOUBLE + {at} * ({dx})::DOUBLE), 2) + power(y - (({a[1]})::DOUBLE + {at} * ({dy})::DOUBLE), 2))"


@add("f01_temporal_slice", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE time BETWEEN 100.0::DOUBLE - 2.5 AND 100.0::DOUBLE + 2.5")
def f01(spark, d):
    return search.temporal_slice(t.nodes(spark, d), 100.0, 2.5).select(*ID_TIME)


@add("f02_radial_band", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE distance BETWEEN 0.25 AND 0.75")
def f02(spark, d):
    return search.radial_band(t.nodes(spark, d), 0.25, 0.75).select(*ID_TIME)


@add("f03_angular_sector", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE angle BETWEEN 30 AND 120")
def f03(spark, d):
    return search.angular_sector(t.nodes(spark, d), 30.0, 120.0).select(*ID_TIME)


@add("f03_angular_sector_wrapped", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE angle >= 350 OR angle <= 10")
def f03w(spark, d):
    return search.angular_sector(t.nodes(spark, d), 350.0, 10.0, wrap=True).select(*ID_TIME)


@add(
    "f04_temporal_window_edges",
    f"""WITH {NODES}, c AS (SELECT node_id AS src, lag(node_id) OVER (PARTITION BY user_id ORDER BY ts, node_id) AS dst, node_type AS type FROM nodes),
    w AS (SELECT node_id FROM nodes WHERE time BETWEEN 48 AND 240)
    SELECT src, dst, type FROM c WHERE dst IS NOT NULL AND src IN (SELECT node_id FROM w) AND dst IN (SELECT node_id FROM w)""",
)
def f04(spark, d):
    n = t.nodes(spark, d)
    return search.temporal_window(n, t.edges(n), 48.0, 240.0)[1].select("src", "dst", "type")


@add("f05_time_range", "SELECT event_id AS node_id, event_type AS node_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def f05(spark, d):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-12 12:00:00"))
    return search.time_range(t.nodes(spark, d), lo, hi, "ts").select("node_id", "node_type")


@add("f06_bucketed_range", f"WITH {NODES} SELECT node_id, CAST(floor(t / 3600) AS BIGINT) AS t_bucket FROM nodes WHERE t BETWEEN {START + 3 * DAY} AND {START + 9.5 * DAY}")
def f06(spark, d):
    return search.bucketed_range(t.nodes(spark, d), START + 3 * DAY, START + 9.5 * DAY).select("node_id", "t_bucket")


@add("f07_box_n_d", f"WITH {VECTORS} SELECT vec_id, label FROM vectors WHERE dims[1] BETWEEN -0.1 AND 0.2 AND dims[2] BETWEEN -0.2 AND 0.1 AND dims[3] BETWEEN -0.3 AND 0.3")
def f07(spark, d):
    return t.vectors(spark, d).where(g.in_box(F.col("dims"), [-0.1, -0.2, -0.3], [0.2, 0.1, 0.3])).select("vec_id", "label")


@add("f08_cylinder_box", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE time BETWEEN 24 AND 480 AND distance BETWEEN 0.1 AND 0.9 AND theta BETWEEN 0.5 AND 2.5")
def f08(spark, d):
    return search.in_box(t.nodes(spark, d), g.Box(24.0, 480.0, 0.1, 0.9, 0.5, 2.5)).select(*ID_TIME)


@add("f09_cylinder_box_wrapped", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE time BETWEEN 24 AND 480 AND distance BETWEEN 0.1 AND 0.9 AND (theta >= 6.0 OR theta <= 0.4)")
def f09(spark, d):
    return search.in_box(t.nodes(spark, d), g.Box(24.0, 480.0, 0.1, 0.9, 6.0, 0.4)).select(*ID_TIME)


@add("f11_exact_position", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE abs(distance - 0.0655) <= 1e-10 AND abs(angle - 296) <= 1e-10")
def f11(spark, d):
    n = t.nodes(spark, d)
    return n.where((F.abs(F.col("distance") - 0.0655) <= 1e-10) & (F.abs(F.col("angle") - 296.0) <= 1e-10)).select(*ID_TIME)


@add("f12_circle", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE power(x - 0.2, 2) + power(y - 0.1, 2) <= 0.35 * 0.35::DOUBLE")
def f12(spark, d):
    return search.in_shape(t.nodes(spark, d), {"center": (0.2, 0.1), "radius": 0.35}).select(*ID_TIME)


@add("f13_polygon", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE {_polygon_sql()}")
def f13(spark, d):
    return search.in_shape(t.nodes(spark, d), {"polygon": SQUARE}).select(*ID_TIME)


@add("f15_path", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE least({', '.join(_segment_sql(a, b) for a, b in zip(PATH, PATH[1:], strict=False))}) <= 0.15")
def f15(spark, d):
    return search.near_path(t.nodes(spark, d), PATH, 0.15).select(*ID_TIME)


@add("f16_segment_distance", f"WITH {NODES} SELECT node_id, round({_segment_sql(*PATH[:2])}, 6) AS d FROM nodes")
def f16(spark, d):
    return t.nodes(spark, d).select("node_id", r6(g.segment_distance("x", "y", *PATH[:2])).alias("d"))


@add("f17_rectangle", f"WITH {NODES} SELECT node_id, user_id, node_type FROM nodes WHERE x BETWEEN -0.4 AND 0.4 AND y BETWEEN -0.2 AND 0.9")
def f17(spark, d):
    return search.in_shape(t.nodes(spark, d), {"min": (-0.4, -0.2), "max": (0.4, 0.9)}).select(*ID_TIME)


@add("f18_combined_window_radius", f"WITH {NODES} SELECT node_id, round(distance, 6) AS distance, node_type FROM nodes WHERE time BETWEEN 50 AND 400 AND power(x, 2) + power(y, 2) <= 0.6 * 0.6::DOUBLE ORDER BY time, node_id LIMIT 200")
def f18(spark, d):
    q = builder.query()
    q.temporal().between(50.0, 400.0)
    q.spatial().near(0.0, 0.0, 0.6)
    built = q.limit(200).build()
    return built.run(t.nodes(spark, d), Fields(time="time"), order_by="time").select("node_id", r6("distance").alias("distance"), "node_type")


@add("f21_before_after", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE t >= {START + 20 * DAY}")
def f21(spark, d):
    return builder.temporal_query().after(START + 20 * DAY).build().run(t.nodes(spark, d)).select("node_id", "node_type")


@add("f25_content_operators", "SELECT event_id AS node_id, event_type AS node_type, value FROM events WHERE event_type LIKE '%i%' AND value > 50 AND value != 75 AND event_type IN ('click', 'view', 'signup') AND NOT contains(event_type, 'sign')")
def f25(spark, d):
    c = Content("node_type", "LIKE", "%i%") & Content("value", ">", 50) & Content("value", "!=", 75) & Content("node_type", "IN", ["click", "view", "signup"]) & ~Content("node_type", "CONTAINS", "sign")
    n = t.table(spark, d, "events").select(F.col("event_id").alias("node_id"), F.col("event_type").alias("node_type"), "value")
    return Query(c).run(n)


@add("f27_boolean_tree", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE (t <= {START + 4 * DAY} OR (x BETWEEN 0 AND 0.5 AND y BETWEEN 0 AND 0.5)) AND NOT (node_type = 'error')")
def f27(spark, d):
    c = Composite("AND", (Composite("OR", (Temporal(end_time=START + 4 * DAY), Spatial(0.0, 0.0, 0.5, 0.5))), Composite("NOT", (Content("node_type", "=", "error"),))))
    return Query.from_json(Query(c).to_json()).run(t.nodes(spark, d)).select("node_id", "node_type")


@add("f37_content_map", "SELECT event_id AS node_id, value FROM events WHERE event_type = 'purchase' AND value >= 90")
def f37(spark, d):
    n = t.nodes(spark, d)
    return Query(Content("purchase", ">=", 90)).run(n, Fields(content="content")).select("node_id", F.col("content")["purchase"].cast("double").alias("value"))


@add("f43_compound_builder", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE t >= {START + 5 * DAY} AND t <= {START + 25 * DAY} AND x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.5 AND 0.5 AND node_type IN ('view', 'purchase')")
def f43(spark, d):
    q = builder.query()
    q.temporal().after(START + 5 * DAY).before(START + 25 * DAY)
    q.spatial().within_rectangle(-0.5, -0.5, 0.5, 0.5)
    q.content().in_list("node_type", ["view", "purchase"])
    return q.build().run(t.nodes(spark, d)).select("node_id", "node_type")


@add("f46_property_equality", "SELECT event_id AS node_id, user_id FROM events WHERE event_type = 'click' AND user_id = 7")
def f46(spark, d):
    return Query(builder.filter_by_property({"node_type": "click", "user_id": 7})).run(t.nodes(spark, d)).select("node_id", "user_id")


@add("f51_request_operators", "SELECT event_id AS node_id, event_type AS node_type FROM events WHERE starts_with(event_type, 'p') OR suffix(event_type, 'k') OR (value >= 20 AND value < 21)")
def f51(spark, d):
    n = t.table(spark, d, "events").select(F.col("event_id").alias("node_id"), F.col("event_type").alias("node_type"), "value")
    c = Content("node_type", "starts_with", "p") | Content("node_type", "ends_with", "k") | (Content("value", "gte", 20) & Content("value", "lt", 21))
    return Query(c).run(n).select("node_id", "node_type")


@add("u06_request_page", f"WITH {NODES} SELECT node_id, node_type FROM nodes WHERE x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.5 AND 0.5 AND t BETWEEN {START} AND {START + 15 * DAY} ORDER BY t DESC, node_id LIMIT 50 OFFSET 100")
def u06(spark, d):
    request = {"spatial_criteria": {"region": ((-0.5, -0.5), (0.5, 0.5))}, "temporal_criteria": {"start": START, "end": START + 15 * DAY}, "limit": 50, "offset": 100, "sort_by": "temporal", "sort_order": "desc"}
    return execute_query(request, t.nodes(spark, d))["rows"].select("node_id", "node_type")


_PREV = NODES + ", p AS (SELECT *, lag(time) OVER w AS t2, lag(distance) OVER w AS r2, lag(angle) OVER w AS a2, lag(theta) OVER w AS th2, lag(ts) OVER w AS ts2 FROM nodes WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts, node_id))"


def _pairs(spark, d):
    """Nodes beside the one before them in a group of users, so that angles differ."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.col("user_id") % 10).orderBy("ts", "node_id")
    n = t.nodes(spark, d)
    return n.select("*", *[F.lag(c).over(w).alias(a) for c, a in (("time", "t2"), ("distance", "r2"), ("angle", "a2"), ("theta", "th2"), ("ts", "ts2"))]).where("t2 is not null")


_ARC = "least(abs(theta - th2), {turn} - abs(theta - th2))"


@add(
    "h02_distances",
    f"""WITH {_PREV} SELECT node_id,
    round(sqrt(greatest(0.0::DOUBLE, distance * distance + r2 * r2 - 2.0 * distance * r2 * cos(radians(angle - a2))) + (time - t2) * (time - t2)), 6) AS polar,
    round(sqrt(power(time - t2, 2) + power(distance - r2, 2) + power(least(distance, r2) * {_ARC.format(turn="2 * pi()")}, 2)), 6) AS arc,
    round(sqrt(power(time - t2, 2) + power(distance - r2, 2) + power((distance + r2) / 2.0 * {_ARC.format(turn="(2 * 3.14159)::DOUBLE")}, 2)), 6) AS typed,
    round(sqrt(greatest(0.0::DOUBLE, power(time - t2, 2) + power(distance - r2, 2) + distance * r2 * (1.0 - cos(theta - th2)))), 6) AS chord
    FROM p WHERE t2 IS NOT NULL""",
)
def h02(spark, d):
    a, b = ("time", "distance", "theta"), ("t2", "r2", "th2")
    return _pairs(spark, d).select("node_id", r6(g.polar_distance("time", "distance", "angle", "t2", "r2", "a2")).alias("polar"), r6(g.arc_distance(*a, *b)).alias("arc"), r6(g.typed_distance(*a, *b)).alias("typed"), r6(g.chord_distance(*a, *b)).alias("chord"))


@add("h04_temporal", f"WITH {_PREV} SELECT node_id, abs(epoch_us(ts) - epoch_us(ts2)) / 1e6 AS apart, ts2 < ts AS precedes, date_trunc('hour', ts) = date_trunc('hour', ts2) AS same_hour FROM p WHERE t2 IS NOT NULL")
def h04(spark, d):
    return _pairs(spark, d).select("node_id", s.seconds_apart(F.col("ts"), F.col("ts2")).alias("apart"), s.precedes(F.col("ts2"), F.col("ts")).alias("precedes"), s.equal_at(F.col("ts"), F.col("ts2"), "hour", "second").alias("same_hour"))


_ZERO = "list_transform(range(1, 65), lambda i: CASE WHEN i <= 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)"


@add(
    "h03_vector_metrics",
    f"""WITH {VECTORS} SELECT vec_id, round(list_distance(dims, {_ZERO}), 6) AS padded,
    round(sqrt(power(dims[1] - 0.1, 2) + power(dims[2] - 0.1, 2) + power(dims[3] - 0.1, 2)), 6) AS l2,
    round(abs(dims[1] - 0.1) + abs(dims[2] - 0.1) + abs(dims[3] - 0.1), 6) AS l1,
    round(greatest(abs(dims[1] - 0.1), abs(dims[2] - 0.1), abs(dims[3] - 0.1)), 6) AS linf FROM vectors""",
)
def h03(spark, d):
    p = F.array(*[F.lit(0.1)] * 3)
    return t.vectors(spark, d).select("vec_id", r6(g.padded_distance(F.col("dims"), p)).alias("padded"), *[r6(g.metric_distance(F.col("dims"), p, m)).alias(a) for m, a in (("euclidean", "l2"), ("manhattan", "l1"), ("chebyshev", "linf"))])


@add(
    "h10_coordinates",
    f"""WITH {NODES}, l AS (SELECT node_id, x, y, x - 0.3 * cos(0.5::DOUBLE) AS lx, y - 0.3 * sin(0.5::DOUBLE) AS ly FROM nodes)
    SELECT node_id, round(x, 6) AS x, round(y, 6) AS y, round(sqrt(x * x + y * y), 6) AS r, round(sqrt(lx * lx + ly * ly), 6) AS local_r,
           round(CASE WHEN atan2(ly, lx) < 0 THEN atan2(ly, lx) + 2 * pi() ELSE atan2(ly, lx) END, 6) AS local_theta, round(sqrt(x * x + y * y), 6) AS global_r FROM l""",
)
def h10(spark, d):
    n = t.nodes(spark, d)
    x, y = g.to_cartesian("distance", "theta")
    lr, lt = g.to_local("distance", "theta", 0.3, 0.5)
    n = n.select("node_id", r6(x).alias("x"), r6(y).alias("y"), r6(g.from_cartesian("x", "y")[0]).alias("r"), lr.alias("lr"), lt.alias("lt"))
    return n.select("node_id", "x", "y", "r", r6("lr").alias("local_r"), r6("lt").alias("local_theta"), r6(g.to_global("lr", "lt", 0.3, 0.5)[0]).alias("global_r"))


@add("h09_hybrid", f"WITH {_PREV} SELECT node_id, round(sqrt(power(abs(distance - r2), 2) + power(abs(epoch_us(ts) - epoch_us(ts2)) / 8.64e10, 2)), 6) AS both, round(abs(distance - r2), 6) AS space FROM p WHERE t2 IS NOT NULL")
def h09(spark, d):
    space, days = F.abs(F.col("distance") - F.col("r2")), s.seconds_apart(F.col("ts"), F.col("ts2")) / 86400.0
    return _pairs(spark, d).select("node_id", r6(g.hybrid_distance(space, days)).alias("both"), r6(g.hybrid_distance(space, F.lit(None).cast("double"))).alias("space"))


@add(
    "h13_boxes",
    f"""WITH {_PREV} SELECT node_id, round((greatest(time, t2) - least(time, t2)) * (power(greatest(distance, r2), 2) - power(least(distance, r2), 2)) * (greatest(theta, th2) - least(theta, th2)) / 2.0, 6) AS volume,
    round(greatest(0.0::DOUBLE, 10.0 - time, time - 300.0), 6) AS apart_t FROM p WHERE t2 IS NOT NULL""",
)
def h13(spark, d):
    lo, hi = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    box = g.box_column(t_lo=lo("time", "t2"), t_hi=hi("time", "t2"), r_lo=lo("distance", "r2"), r_hi=hi("distance", "r2"), theta_lo=lo("theta", "th2"), theta_hi=hi("theta", "th2"))
    whole = g.Box(10.0, 300.0, -1e9, 1e9, 0.0, 7.0)
    return _pairs(spark, d).select("node_id", r6(g.box_volume(box)).alias("volume"), r6(g.box_min_distance(whole, "time", "distance", "theta")).alias("apart_t"))


@add("h15_time_bucket", f"WITH {NODES} SELECT node_id, CAST(floor(t / 900) AS BIGINT) AS bucket FROM nodes")
def h15(spark, d):
    return t.nodes(spark, d).select("node_id", s.bucket(F.col("t"), 900.0).alias("bucket"))


@add("h17_window_score", f"WITH {NODES} SELECT node_id, round(0.7 * (1.0 - least(greatest(0.0::DOUBLE, {START + 10 * DAY} - t, t - {START + 12 * DAY}) / 2592000.0, 1.0)) + 0.3 * k / 100.0, 6) AS score FROM nodes")
def h17(spark, d):
    return t.nodes(spark, d).select("node_id", r6(s.window_score(F.col("t"), START + 10 * DAY, START + 12 * DAY, F.col("k") / 100.0)).alias("score"))


@add(
    "h18_frequency_score",
    """WITH c AS (SELECT user_id, CAST(day(ts) AS BIGINT) AS d, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) AS i, 31 - d AS apart FROM c)
    SELECT user_id, round(1.0 - 1.0 / (sum(n * greatest(0.0::DOUBLE, 1.0 - apart / 5.0::DOUBLE) / i::DOUBLE) / sum(1.0 / i::DOUBLE) / 2.0 + 1.0), 6) AS score FROM r GROUP BY 1""",
)
def h18(spark, d):
    c = t.nodes(spark, d).groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(F.count("*").alias("n"))
    c = c.groupBy("user_id").agg(F.reverse(F.sort_array(F.collect_list(F.struct("d", "n")))).alias("w"))
    counts, apart = F.transform("w", lambda x: x["n"].cast("double")), F.transform("w", lambda x: (31 - x["d"]).cast("double"))
    return c.select("user_id", r6(s.frequency_score(counts, apart)).alias("score"))


@add("h20_confidence", "SELECT c_custkey AS fact_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (c_acctbal + 1000.0) / 11000.0)) + 0.1)), 6) AS confidence FROM customer")
def h20(spark, d):
    return t.facts(spark, d).select("fact_id", r6(s.verified(F.col("confidence"))).alias("confidence"))


@add(
    "h22_text_functions",
    """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS summary,
    CASE WHEN length(text) > 20 THEN substr(text, 1, 17) || '...' ELSE text END AS short,
    CASE WHEN contains(text, '"') OR contains(text, chr(39)) THEN 'character' ELSE 'narrator' END AS speaker FROM documents""",
)
def h22(spark, d):
    x = F.col("text")
    return t.table(spark, d, "documents").select("doc_id", s.summary(x).alias("summary"), s.truncated(x).alias("short"), s.speaker(x).alias("speaker"))


@add(
    "h25_mentions",
    r"""SELECT doc_id, CASE WHEN contains(text, 'License') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'Apache') THEN 1 ELSE 0 END AS names,
    CASE WHEN regexp_matches(text, '(?i)\bthe\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\bder\b') THEN 1 ELSE 0 END AS themes FROM documents""",
)
def h25(spark, d):
    x = F.col("text")
    return t.table(spark, d, "documents").select("doc_id", F.size(s.mentions(x, ["License", "Apache"])).alias("names"), F.size(s.mentions(x, ["the", "der"], whole_word=True)).alias("themes"))


@add("h31_spiral", "SELECT conv_id, turn, round(0.2::DOUBLE + 0.05 * turn, 6) AS distance, CAST((turn * 30) % 360 AS DOUBLE) AS angle FROM conversations")
def h31(spark, d):
    r, a = s.spiral(F.col("turn"))
    return t.messages(spark, d).select("conv_id", "turn", r6(r).alias("distance"), a.alias("angle"))


@add(
    "h33_ids",
    "SELECT event_id AS node_id, lower(lpad(hex(epoch_us(ts) // 1000), 12, '0') || lpad(hex(7), 4, '0') || lpad(hex(event_id % 65536), 4, '0')) AS ordered, regexp_matches(event_type, '^[0-9a-f]{8}-') AS valid FROM events",
)
def h33(spark, d):
    return t.nodes(spark, d).select("node_id", s.ordered_id(F.col("ts"), 7, F.col("node_id") % 65536).alias("ordered"), s.is_uuid(F.col("node_type")).alias("valid"))
