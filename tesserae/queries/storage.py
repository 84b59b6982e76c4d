"""Scans, lookups, versions, serialisation, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.queries.common import CHAIN, NODES, VERSIONS, Registry, r6
from tesserae.sources import store
from tesserae.sources import tables as t
from tesserae.sources import text as text_source
from tesserae.streaming import feed

QUERIES = Registry()
add = QUERIES.add


@add("sc01_scan", f"WITH {NODES} SELECT node_id, user_id, node_type, k FROM nodes WHERE k > 20")
def sc01(spark, d):
    return store.scan(t.nodes(spark, d), F.col("k") > 20).select("node_id", "user_id", "node_type", "k")


@add("sc03_point_lookup", "SELECT event_id AS node_id, event_type AS node_type FROM events WHERE event_id = 777")
def sc03(spark, d):
    return store.get(t.nodes(spark, d), 777).select("node_id", "node_type")


@add("sc05_multi_get", "SELECT event_id AS node_id, event_type AS node_type FROM events WHERE event_id IN (3, 33, 333, 3333)")
def sc05(spark, d):
    from tesserae.operators.search import multi_get

    return multi_get(t.nodes(spark, d), [3, 33, 333, 3333]).select("node_id", "node_type")


@add("sc07_ids", "SELECT event_id AS node_id FROM events")
def sc07(spark, d):
    return store.ids(t.nodes(spark, d))


@add("sc08_prefix_reverse", "SELECT c_name, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_name DESC")
def sc08(spark, d):
    return store.ordered(t.table(spark, d, "customer").select("c_name", "c_custkey"), "c_name", "Customer#00000001", reverse=True)


@add("sc11_json_round_trip", "SELECT event_id AS node_id, event_type AS node_type, value FROM events")
def sc11(spark, d):
    n = t.table(spark, d, "events").select(F.col("event_id").alias("node_id"), F.col("event_type").alias("node_type"), "value")
    path = f"{store.shared_dir(spark)}/json-{uuid.uuid4().hex}"
    store.save_json(n, path)
    return store.load_json(spark, path, n.schema)


@add("sc13_packed_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def sc13(spark, d):
    o = t.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return store.unpack_rows(store.pack_rows(o), o.schema)


@add("sc20_upsert_latest", f"WITH {VERSIONS} SELECT node_id, CAST(max(version) + CASE WHEN node_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS version, CASE WHEN node_id % 3 = 0 THEN 'X' ELSE max_by(status, version) END AS status FROM versions GROUP BY node_id")
def sc20(spark, d):
    v = t.versions(spark, d).select("node_id", "version", "status")
    changes = v.select("node_id").distinct().where("node_id % 3 = 0").withColumn("status", F.lit("X"))
    return store.latest(store.upsert(v, changes)).select("node_id", "version", "status")


@add("sc22_delete_latest", f"WITH {VERSIONS} SELECT node_id, max(version) AS version FROM versions WHERE node_id % 5 <> 0 GROUP BY 1")
def sc22(spark, d):
    v = t.versions(spark, d).select("node_id", "version", "status")
    return store.latest(store.tombstones(v, v.select("node_id").distinct().where("node_id % 5 = 0"))).select("node_id", "version")


@add("sc24_compacted", "SELECT event_id, event_type FROM events WHERE user_id BETWEEN 20 AND 30")
def sc24(spark, d):
    base = f"{store.shared_dir(spark)}/compact-{uuid.uuid4().hex}"
    store.bulk_load(t.table(spark, d, "events").withColumn("t_bucket", F.dayofmonth("ts") % 4), f"{base}/in")
    store.compact(spark, f"{base}/in", f"{base}/out", 8, "user_id", "event_id")
    return spark.read.parquet(f"{base}/out").where("user_id between 20 and 30").select("event_id", "event_type")


@add("sc24_whole_compacted", "SELECT * FROM events")
def sc24w(spark, d):
    """All rows and columns of the compacted table."""
    base = f"{store.shared_dir(spark)}/compact-{uuid.uuid4().hex}"
    events = t.table(spark, d, "events")
    store.bulk_load(events.withColumn("t_bucket", F.dayofmonth("ts") % 4), f"{base}/in")
    store.compact(spark, f"{base}/in", f"{base}/out", 8, "user_id", "event_id")
    return spark.read.parquet(f"{base}/out").select(*events.columns)


@add("sc15_markdown", "SELECT conv_id, turn, role, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content FROM conversations WHERE role IN ('user', 'assistant') AND conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (role NOT IN ('user', 'assistant')) = 0)")
def sc15(spark, d):
    """Conversations of users and assistants written as Markdown, and read back."""
    m = t.messages(spark, d)
    plain = m.groupBy("conv_id").agg(F.count_if(~F.col("role").isin("user", "assistant")).alias("others")).where("others = 0").select("conv_id")
    block = F.concat(F.lit("### "), F.initcap("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    made = m.join(plain, "conv_id").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n").alias("body"))
    value = F.concat(F.lit("# Conversation\n\n## Summary\n\nShort.\n\n## Keywords\n\none, two\n\n## Messages\n\n"), "body")
    sections = text_source.markdown_sections(made.select("conv_id", value.alias("value")))
    return text_source.parse_messages(sections.select("conv_id", "messages")).select("conv_id", F.col("index").cast("long").alias("turn"), "role", "content")


@add("r01_change_feed", f"WITH {VERSIONS} SELECT node_id, version, CASE WHEN version = 1 THEN 'node_created' ELSE 'node_updated' END AS event FROM versions")
def r01(spark, d):
    return feed.change_feed(t.versions(spark, d)).select("node_id", "version", "event")


def _streamed(spark, d, table: str, work, mode: str = "complete"):
    """What a stream over a table gives, once it has read all there is."""
    base = f"{store.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(spark.read.parquet(f"{d}/{table}.parquet").schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{table}.parquet" if _is_folder(spark, f"{d}/{table}.parquet") else f"{d}/{table}.parquet*")

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = work(source).writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _is_folder(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


@add("r05_tumbling_stream", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r05(spark, d):
    out = _streamed(spark, d, "events", lambda s: feed.tumbling(s, "ts", "6 hours", "60 days", "0 seconds", "event_type"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@add("r03_latest_positions", f"WITH {CHAIN} SELECT user_id, round(max_by(x, (t, node_id)), 6) AS x, round(max_by(y, (t, node_id)), 6) AS y FROM chain GROUP BY 1")
def r03(spark, d):
    n = t.nodes(spark, d)
    last = n.groupBy("user_id").agg(F.max_by(F.struct("x", "y"), F.struct("t", "node_id")).alias("p"))
    return last.select("user_id", r6("p.x").alias("x"), r6("p.y").alias("y"))
