"""Delta chains, versions, states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.scalars import topic_probability
from tesserae.operators import aggregates, delta, delta_ops, windows
from tesserae.queries.common import CHAIN, EDGES, NODES, VERSIONS, Registry, r6
from tesserae.sources import store
from tesserae.sources import tables as t

QUERIES = Registry()
add = QUERIES.add
NAMES = ["view", "signup", "purchase", "click", "error"]
START = 1704067200.0
DAY = 86400.0
ORDER = ["t", "node_id"]


def _flat(df, key="user_id"):
    """Flat columns of a content map."""
    return df.select(key, *[F.col("content").getItem(n).cast("double").alias(n) for n in NAMES])


def _last(where="true", key="user_id"):
    return ", ".join(f"max_by(value, (t, node_id)) FILTER (node_type = '{n}' AND {where}) AS {n}" for n in NAMES)


@add("v02_chain_closure", f"WITH RECURSIVE {CHAIN}, s AS (SELECT node_id FROM chain c WHERE NOT EXISTS (SELECT 1 FROM chain x WHERE x.parent_id = c.node_id)), r AS (SELECT node_id AS start, node_id, 0 AS depth FROM s UNION ALL SELECT start, parent_id, depth + 1 FROM r JOIN chain USING (node_id) WHERE parent_id IS NOT NULL AND depth < 3) SELECT start, node_id, depth FROM r")
def v02(spark, d):
    n = t.nodes(spark, d)
    e = t.edges(n)
    starts = n.select("node_id").join(e.select(F.col("dst").alias("node_id")), "node_id", "left_anti")
    return delta.chain_closure(e, starts, 3)


@add("v02_whole_chain_closure", f"WITH RECURSIVE {CHAIN}, s AS (SELECT node_id FROM chain c WHERE NOT EXISTS (SELECT 1 FROM chain x WHERE x.parent_id = c.node_id)), r AS (SELECT node_id AS start, node_id, 0 AS depth FROM s UNION ALL SELECT start, parent_id, depth + 1 FROM r JOIN chain USING (node_id) WHERE parent_id IS NOT NULL) SELECT start, node_id, depth FROM r")
def v02w(spark, d):
    """Chains to their end."""
    n = t.nodes(spark, d)
    e = t.edges(n)
    starts = n.select("node_id").join(e.select(F.col("dst").alias("node_id")), "node_id", "left_anti")
    return delta.chain_closure(e, starts)


@add("v03_node_state", f"WITH {NODES} SELECT user_id, {_last()} FROM nodes GROUP BY 1")
def v03(spark, d):
    return _flat(delta.fold_states(t.nodes(spark, d), "user_id", ORDER))


@add("v03_running_state", f"WITH {NODES} SELECT node_id, " + ", ".join(f"last_value(CASE WHEN node_type = '{n}' THEN value END IGNORE NULLS) OVER w AS {n}" for n in NAMES) + " FROM nodes WINDOW w AS (PARTITION BY user_id ORDER BY t, node_id ROWS UNBOUNDED PRECEDING)")
def v03r(spark, d):
    s = delta.running_states(t.nodes(spark, d), "user_id", ORDER, NAMES)
    return s.select("node_id", *[F.col(f"state_{n}").cast("double").alias(n) for n in NAMES])


@add("v04_compressed_chains", f"WITH {NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, node_id DESC) AS r FROM nodes) SELECT user_id, CAST(least(count(*), 10) + CASE WHEN count(*) > 10 THEN 1 ELSE 0 END AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS merged, {_last()} FROM r GROUP BY 1")
def v04(spark, d):
    c = delta.compress_chains(t.nodes(spark, d), "user_id", 10, ORDER)
    sizes = c.groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("merged").alias("merged"))
    return sizes.join(_flat(delta.fold_states(c, "user_id", ORDER)), "user_id")


@add("v20_valid_links", f"WITH {CHAIN} SELECT node_id, parent_id FROM chain")
def v20(spark, d):
    return delta.valid_links(t.chain(t.nodes(spark, d)), "user_id", ["ts", "node_id"], "node_id", "parent_id").select("node_id", "parent_id")


@add("v21_state_from_checkpoint", f"WITH {NODES} SELECT user_id, {_last()} FROM nodes WHERE t <= {START + 20 * DAY} GROUP BY 1")
def v21(spark, d):
    n = t.nodes(spark, d)
    kept = delta.checkpoints(n, "user_id", ORDER, START + 10 * DAY)
    return _flat(delta.state_at(n, kept, "user_id", ORDER, START + 20 * DAY))


@add("v25_pruned_state", f"WITH {NODES} SELECT user_id, {_last()} FROM nodes GROUP BY 1")
def v25(spark, d):
    kept, rest = delta.prune(t.nodes(spark, d), "user_id", ORDER, START + 15 * DAY)
    return _flat(delta.state_at(rest, kept, "user_id", ORDER, START + 1e9))


@add("v26_state_at", f"WITH {NODES} SELECT user_id, {_last()} FROM nodes WHERE t <= {START + 7 * DAY} GROUP BY 1")
def v26(spark, d):
    return _flat(delta.fold_states(t.nodes(spark, d), "user_id", ORDER, until=F.col("t") <= START + 7 * DAY))


@add("v27_stated_deltas", f"WITH {CHAIN} SELECT user_id, {_last().replace('(t, node_id)', '-seq')} FROM chain WHERE k >= 50 GROUP BY 1")
def v27(spark, d):
    c = t.chain(t.nodes(spark, d)).withColumn("delta_id", F.col("node_id"))
    wanted = c.where("k >= 50").select("user_id", "delta_id", (-F.col("seq")).alias("place"))
    return _flat(delta.reconstruct_list(c, wanted, "user_id"))


@add("v28_deltas_in_range", f"WITH {NODES} SELECT user_id, node_id FROM nodes WHERE t BETWEEN {START + 2 * DAY} AND {START + 4 * DAY}")
def v28(spark, d):
    return t.nodes(spark, d).where(F.col("t").between(START + 2 * DAY, START + 4 * DAY)).select("user_id", "node_id")


@add("w07_states_at_moments", " UNION ALL ".join(f"(WITH {NODES} SELECT user_id, {START + k * DAY}::DOUBLE AS moment, {_last()} FROM nodes WHERE t <= {START + k * DAY} GROUP BY 1)" for k in (5, 10, 30)))
def w07(spark, d):
    moments = spark.createDataFrame([(START + k * DAY,) for k in (5, 10, 30)], "moment double")
    s = delta.states_at_each(t.nodes(spark, d), moments, "user_id", ORDER)
    return s.select("user_id", "moment", *[F.col("content").getItem(n).cast("double").alias(n) for n in NAMES])


@add("w09_compacted_chains", f"WITH {NODES}, l AS (SELECT user_id, count(*) AS before, list([CAST(k % 7 + 1 AS BIGINT)] ORDER BY t, node_id) AS l FROM nodes GROUP BY 1) SELECT user_id, before, len(list_reduce(l, lambda a, x: CASE WHEN a[len(a)] + x[1] <= 10 THEN list_concat(a[1:len(a) - 1], [a[len(a)] + x[1]]) ELSE list_concat(a, x) END)) AS after FROM l")
def w09(spark, d):
    c = t.nodes(spark, d).withColumn("ops", F.col("k") % 7 + 1)
    return delta.compact_chains(c, "user_id", ORDER, "ops", 10)


@add(
    "a09_change_frequency",
    f"""WITH {NODES}, l AS (SELECT user_id, list_prepend([{{'cur': min(t), 'n': CAST(0 AS BIGINT)}}], list([{{'cur': t, 'n': CAST(1 AS BIGINT)}}] ORDER BY t)) AS l FROM nodes GROUP BY 1),
    f AS (SELECT user_id, list_reduce(l, lambda a, x: CASE WHEN x[1].cur <= a[len(a)].cur + {DAY}::DOUBLE THEN list_concat(a[1:len(a) - 1], [{{'cur': a[len(a)].cur, 'n': a[len(a)].n + 1}}])
        ELSE list_concat(a, [{{'cur': a[len(a)].cur + floor((x[1].cur - a[len(a)].cur) / {DAY}::DOUBLE) * {DAY}::DOUBLE, 'n': CAST(1 AS BIGINT)}}]) END) AS w FROM l),
    u AS (SELECT user_id, unnest(w) AS w FROM f)
    SELECT user_id, w.cur AS window_start, w.n AS n FROM u""",
)
def a09(spark, d):
    return aggregates.change_frequency(t.nodes(spark, d), "user_id", "t", DAY)


@add(
    "a28_chain_analysis",
    f"""WITH {NODES}, r AS (SELECT user_id, t, k % 9 AS ops, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, node_id DESC) AS r FROM nodes),
    g AS (SELECT user_id, count(*) AS n, count(*) FILTER (ops <= 5 AND r > 1) AS small, min(t) AS oldest, max(t) AS newest FROM r GROUP BY 1)
    SELECT user_id, n, small, oldest, newest, concat_ws(',', CASE WHEN n > 50 THEN 'add_checkpoints' END, CASE WHEN small > 5 THEN 'compact_chain' END, CASE WHEN n > 10 THEN 'prune_chain' END) AS advice FROM g""",
)
def a28(spark, d):
    c = t.nodes(spark, d).withColumn("ops", F.col("k") % 9)
    return delta.analyse_chains(c, "user_id", "ops", "t").select("user_id", "n", "small", "oldest", "newest", "advice")


@add("v31_compared_states", f"WITH {NODES}, a AS (SELECT user_id, {_last()} FROM nodes WHERE t <= {START + 5 * DAY} GROUP BY 1), b AS (SELECT user_id, {_last()} FROM nodes GROUP BY 1) SELECT b.user_id, " + " + ".join(f"CAST(a.{n} IS NULL AND b.{n} IS NOT NULL AS INTEGER)" for n in NAMES) + " AS added, " + " + ".join(f"CAST(a.{n} IS NOT NULL AND a.{n} <> b.{n} AS INTEGER)" for n in NAMES) + " AS changed FROM b LEFT JOIN a USING (user_id)")
def v31(spark, d):
    n = t.nodes(spark, d)
    a = delta.fold_states(n, "user_id", ORDER, until=F.col("t") <= START + 5 * DAY).withColumnRenamed("content", "old")
    b = delta.fold_states(n, "user_id", ORDER)
    parts = delta.compare(F.col("old"), F.col("content"))
    return b.join(a, "user_id", "left").select("user_id", F.size(parts["added"]).alias("added"), F.size(parts["changed"]).alias("changed"))


@add("v37_version_delta", f"WITH {VERSIONS}, l AS (SELECT *, lag(status) OVER w AS s, lag(priority) OVER w AS p FROM versions WINDOW w AS (PARTITION BY node_id ORDER BY version)) SELECT node_id, version, version = 1 OR s <> status AS status_changed, version = 1 OR p <> priority AS priority_changed FROM l")
def v37(spark, d):
    v = delta.version_delta(t.versions(spark, d), ["status", "priority"])
    return v.select("node_id", "version", F.array_contains("changed", "status").alias("status_changed"), F.array_contains("changed", "priority").alias("priority_changed"))


@add("v38_encode_decode", f"WITH {NODES} SELECT user_id, {_last()} FROM nodes GROUP BY 1")
def v38(spark, d):
    n = t.nodes(spark, d)
    a = delta.fold_states(n, "user_id", ORDER, until=F.col("t") <= START + 5 * DAY).withColumnRenamed("content", "old")
    both = delta.fold_states(n, "user_id", ORDER).join(a, "user_id", "left").withColumn("old", F.coalesce("old", F.create_map().cast("map<string,string>")))
    return _flat(both.withColumn("content", delta.decode(F.col("old"), delta.encode(F.col("old"), F.col("content")))))


@add("v39_version_range", f"WITH {VERSIONS} SELECT node_id, version, status FROM versions WHERE version BETWEEN 2 AND 4")
def v39(spark, d):
    return t.versions(spark, d).where(F.col("version").between(2, 4)).select("node_id", "version", "status")


@add("v40_version_state", f"WITH {VERSIONS} SELECT node_id, status, price FROM versions WHERE version = 5")
def v40(spark, d):
    return delta.reconstruct(t.versions(spark, d), 5, ["status", "price"]).select("node_id", "status", "price")


@add("v42_optimised_versions", f"WITH {VERSIONS}, c AS (SELECT node_id, count(*) AS n FROM versions GROUP BY 1) SELECT node_id, n, n - least(n, 10) AS pruned, CAST(CASE WHEN least(n, 10) >= 5 THEN 4 ELSE 0 END AS BIGINT) AS merged FROM c")
def v42(spark, d):
    return delta.optimise_versions(t.versions(spark, d)).select("node_id", "n", "pruned", "merged")


@add("v49_as_of", f"WITH {VERSIONS} SELECT node_id, version, status FROM versions WHERE o_orderdate <= TIMESTAMP '1997-06-30 00:00:00' QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY version DESC) = 1")
def v49(spark, d):
    return store.as_of(t.versions(spark, d), F.lit("1997-06-30 00:00:00").cast("timestamp_ntz"), when="o_orderdate").select("node_id", "version", "status")


@add(
    "h16_topic_probability",
    f"""WITH {EDGES}, e AS (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges), g AS (SELECT node_id, count(*) AS degree FROM e GROUP BY 1),
    v AS (SELECT user_id, avg(gap) AS gap FROM (SELECT user_id, abs(time - lag(time) OVER (PARTITION BY user_id ORDER BY t, node_id)) AS gap FROM nodes) GROUP BY 1)
    SELECT node_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 / (1.0 + distance) + 0.3 * coalesce(degree / (SELECT max(degree) FROM g)::DOUBLE, 0.0) + 0.2 * coalesce(1.0 / (1.0 + gap), 0.0))), 6) AS p
    FROM nodes LEFT JOIN g USING (node_id) LEFT JOIN v USING (user_id)""",
)
def h16(spark, d):
    from tesserae.operators.graph import degrees

    n = t.nodes(spark, d)
    deg = degrees(t.edges(n))
    top = deg.agg(F.max("degree").alias("top"))
    speed = windows.velocity(n)
    gap = 1.0 / F.nullif(F.col("velocity"), F.lit(0.0)) - 1.0
    all_ = n.join(deg, "node_id", "left").join(speed, "user_id", "left").crossJoin(top)
    return all_.select("node_id", r6(topic_probability(F.col("distance"), F.col("degree"), F.col("top"), gap)).alias("p"))


@add("v09_text_edits", "SELECT doc_id, text FROM documents")
def v09(spark, d):
    """Edits between each text and its upper-case form, applied and undone: what comes back is the text."""
    docs = t.table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    old = F.to_json(F.struct(F.col("text").alias("body")))
    new = F.to_json(F.struct(F.concat(F.lit("» "), F.col("text"), F.lit(" «")).alias("body")))
    ops = docs.select("doc_id", old.alias("old"), new.alias("new")).withColumn("ops", F.to_json(F.array(F.struct(F.lit("set").alias("op"), F.array(F.lit("body")).alias("path"), F.get_json_object("new", "$.body").alias("value"), F.get_json_object("old", "$.body").alias("old"), F.lit(True).alias("had")))))
    there = ops.withColumn("there", delta_ops.apply_json(F.col("old"), F.col("ops")))
    back = there.withColumn("back", delta_ops.reverse_json(F.col("there"), F.col("ops")))
    return back.select("doc_id", F.get_json_object("back", "$.body").alias("text"))


@add("v07_array_operations", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS inserted, CAST(len(embedding) - 1 AS INTEGER) AS deleted, round(embedding[4]::DOUBLE, 6) AS moved FROM embeddings")
def v07(spark, d):
    v = t.vectors(spark, d).withColumn("i", delta_ops.array_insert(F.col("dims"), F.lit(2), F.lit(0.0)))
    v = v.withColumn("x", delta_ops.array_delete(F.col("i"), F.lit(2))).withColumn("y", delta_ops.array_delete(F.col("x"), F.lit(0)))
    return v.select("vec_id", F.size("x").alias("inserted"), F.size("y").alias("deleted"), r6(F.element_at("y", 3)).alias("moved"))
