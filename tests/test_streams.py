"""Streams over files give what a batch gives."""

import uuid

from pyspark.sql import functions as F

from tesserae.operators.delta import fold_states
from tesserae.sources import tables as t
from tesserae.streaming import feed


def run(stream, base, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name := f"q{uuid.uuid4().hex}").option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return name


def test_state_streams(spark, sf, tmp_path):
    feed.use_rocksdb(spark)
    n = t.nodes(spark, sf).select("node_id", "user_id", "t", "x", "y", "content")
    path = str(tmp_path / "in")
    n.repartition(3).write.parquet(path)
    source = feed.read_versions(spark, path, n.schema, 1)
    name = run(feed.track(source, "user_id"), tmp_path, "update")
    last = spark.table(name).groupBy("key").agg(F.max("t").alias("t"))
    want = n.groupBy(F.col("user_id").alias("key")).agg(F.max("t").alias("t"))
    assert last.exceptAll(want).count() == 0 and want.exceptAll(last).count() == 0
    name = run(feed.fold_stream(source, "user_id"), tmp_path, "update")
    rows = spark.table(name).collect()
    final = {(r["key"], r["name"]): r["value"] for r in rows}
    state = {(r["user_id"], k): v for r in fold_states(n, "user_id", ["t", "node_id"]).collect() for k, v in r["content"].items()}
    assert final == state


def test_windows_and_feed(spark, sf, tmp_path):
    events = t.table(spark, sf, "events")
    path = str(tmp_path / "events")
    events.write.parquet(path)
    source = feed.read_versions(spark, path, events.schema)
    total = events.count()
    assert spark.table(run(feed.tumbling(source, "ts", "1 day", "60 days"), tmp_path, "complete")).agg(F.sum("n")).first()[0] == total
    assert spark.table(run(feed.sliding(source, "ts", "2 days", "1 day", "60 days"), tmp_path, "complete")).agg(F.sum("n")).first()[0] == 2 * total
    assert spark.table(run(feed.sessions(source, "ts", "1 hour", "user_id", "60 days"), tmp_path, "complete")).agg(F.sum("n")).first()[0] == total
    seen = []
    versions = spark.createDataFrame([(1, 1), (1, 2)], "node_id int, version int")
    versions.write.parquet(str(tmp_path / "v"))
    out = feed.change_feed(feed.read_versions(spark, str(tmp_path / "v"), versions.schema), ["node_created"])
    feed.deliver(out, lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "c")).awaitTermination()
    assert [r["event"] for r in seen] == ["node_created"]
