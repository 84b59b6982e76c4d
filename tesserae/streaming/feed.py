"""Streams: change feeds, tracking, windows, folded states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def read_versions(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_type(version: Column, deleted: Column) -> Column:
    return F.when(deleted, "node_deleted").when(version == 1, "node_created").otherwise("node_updated")


def change_feed(versions: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Versions as events (created, updated, deleted), only some kinds if asked for."""
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in versions.columns else F.lit(False)
    out = versions.withColumn("event", event_type(F.col("version"), deleted))
    return out if kinds is None else out.where(F.col("event").isin(kinds))


def deliver(feed: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Batches to a function; with its checkpoint each batch is delivered again only under its own number."""
    writer = feed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tumbling(df: DataFrame, when: str, interval: str, late: str = "1 hour", start: str = "0 seconds", *keys: str) -> DataFrame:
    """Counts by windows of fixed origin; rows later than the watermark are left out."""
    return df.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late).groupBy(F.window(when, interval, interval, start).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(df: DataFrame, when: str, length: str, step: str, late: str = "1 hour", *keys: str) -> DataFrame:
    return df.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late).groupBy(F.window(when, length, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, when: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    return df.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late).groupBy(F.session_window(when, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class LatestPosition(StatefulProcessor):
    """Keeps the last position of each key; older rows that come late change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double, x double, y double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.last.get() if self.last.exists() else None
        for frame in rows:
            row = frame.sort_values("t").iloc[-1]
            if best is None or row["t"] >= best[0]:
                best = (float(row["t"]), float(row["x"]), float(row["y"]))
        if best is not None:
            self.last.update(best)
            yield pd.DataFrame({"key": [key[0]], "t": [best[0]], "x": [best[1]], "y": [best[2]]})

    def close(self) -> None:
        pass


def track(df: DataFrame, key: str) -> DataFrame:
    """The last known position of each key, given out whenever it gets rows; needs the RocksDB state store."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "t", "x", "y").groupBy(key).transformWithStateInPandas(LatestPosition(), f"key {kind}, t double, x double, y double", "Update", "None")


class FoldedState(StatefulProcessor):
    """Merges the contents of a key's deltas as they come, the later winning by (t, id)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "name string", "value string, t double, id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for name, value, t, id_ in zip(frame["name"], frame["value"], frame["t"], frame["node_id"], strict=True):
                old = self.values.getValue((name,)) if self.values.containsKey((name,)) else None
                if old is None or (t, id_) >= (old[1], old[2]):
                    self.values.updateValue((name,), (value, float(t), int(id_)))
        state = {k[0]: v[0] for k, v in self.values.iterator()}
        yield pd.DataFrame({"key": [key[0]] * len(state), "name": list(state), "value": list(state.values())})

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, key: str) -> DataFrame:
    """``(key, name, value)`` of the merged content after each batch; a batch recomputation stays the source of truth."""
    spread = df.select(key, "t", "node_id", F.explode("content").alias("name", "value"))
    kind = df.schema[key].dataType.simpleString()
    return spread.groupBy(key).transformWithStateInPandas(FoldedState(), f"key {kind}, name string, value string", "Update", "None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
