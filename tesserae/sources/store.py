"""Reading and writing node tables: upserts, tombstones, exports, transactions, upkeep."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder in local mode, as all runs on one machine there; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def get(df: DataFrame, node_id, column: str = "node_id") -> DataFrame:
    return df.where(F.col(column) == node_id)


def exists(df: DataFrame, node_id, column: str = "node_id") -> bool:
    return not get(df, node_id, column).limit(1).isEmpty()


def ids(df: DataFrame, column: str = "node_id") -> DataFrame:
    return df.select(column)


def ordered(df: DataFrame, column: str, prefix: str | None = None, reverse: bool = False) -> DataFrame:
    """Rows by key, those with a prefix if one is given."""
    out = df if prefix is None else df.where(F.col(column).cast("string").startswith(prefix))
    return out.orderBy(F.col(column).desc() if reverse else F.col(column).asc())


def stream_rows(df: DataFrame, size: int = 100) -> Iterator[list]:
    """Rows in batches; partitions come to the driver one at a time."""
    batch = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def upsert(versions: DataFrame, changes: DataFrame, key: str = "node_id", version: str = "version") -> DataFrame:
    """``versions`` with new ones appended; a change is one more than the latest of its key."""
    last = versions.groupBy(key).agg(F.max(version).alias("_last"))
    w = Window.partitionBy(key).orderBy(*[c for c in changes.columns if c != "deleted"])
    numbered = changes.join(last, key, "left").withColumn(version, (F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).cast(versions.schema[version].dataType)).drop("_last")
    return versions.unionByName(numbered, allowMissingColumns=True)


def tombstones(versions: DataFrame, ids_: DataFrame, key: str = "node_id") -> DataFrame:
    """Versions that mark rows as deleted."""
    return upsert(versions, ids_.select(key).withColumn("deleted", F.lit(True)), key)


def latest(versions: DataFrame, key: str = "node_id", version: str = "version") -> DataFrame:
    """The last version of each key, deleted ones left out; sums before the shuffle, no sort of whole histories."""
    rest = [c for c in versions.columns if c != key]
    out = versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_v")).select(key, "_v.*")
    return out.where(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted") if "deleted" in versions.columns else out


def as_of(versions: DataFrame, moment, key: str = "node_id", when: str = "ts", version: str = "version") -> DataFrame:
    """The whole table as it was at a moment."""
    return latest(versions.where(F.col(when) <= moment), key, version)


class Conflict(RuntimeError):
    """Another writer changed what a transaction had read."""


class Transaction:
    """Reads from one snapshot, collects changes, and appends them if no key it changes has moved since.

    Files have no lock: of writers whose commits overlap in time both may pass, so commits to one table take turns.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "node_id", version: str = "version"):
        self.spark, self.path, self.key, self.version = spark, path, key, version
        self.snapshot, self.changes = written(spark.read.parquet(path), "snapshot"), []

    def read(self) -> DataFrame:
        return latest(self.snapshot, self.key, self.version)

    def put(self, rows: DataFrame) -> None:
        self.changes.append(rows)

    def delete(self, ids_: DataFrame) -> None:
        self.changes.append(ids_.select(self.key).withColumn("deleted", F.lit(True)))

    def conflicts(self) -> DataFrame:
        now, then = (df.groupBy(self.key).agg(F.max(self.version).alias(n)) for df, n in ((self.spark.read.parquet(self.path), "now"), (self.snapshot, "then")))
        touched = None
        for rows in self.changes:
            touched = rows.select(self.key) if touched is None else touched.union(rows.select(self.key))
        moved = now.join(then, self.key, "left").where(~F.col("now").eqNullSafe(F.col("then")))
        return moved.join(touched.distinct(), self.key, "left_semi")

    def commit(self) -> None:
        if not self.changes:
            return
        if not self.conflicts().isEmpty():
            raise Conflict("rows were changed by another writer")
        made = self.snapshot
        for rows in self.changes:
            made = upsert(made, rows, self.key, self.version)
        added = made.join(self.snapshot.select(self.key, self.version), [self.key, self.version], "left_anti")
        written(added, "commit").write.mode("append").parquet(self.path)
        self.changes = []

    def rollback(self) -> None:
        self.changes = []


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def load_database_json(spark: SparkSession, path: str, node_schema: str) -> DataFrame:
    """A single JSON document whose ``nodes`` maps ids to nodes, as rows."""
    doc = spark.read.option("multiLine", True).schema(f"nodes map<string,struct<{node_schema}>>").json(path)
    return doc.select(F.explode("nodes").alias("node_id", "node")).select("node_id", "node.*")


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json_rows(df: DataFrame, schema) -> DataFrame:
    return df.select(F.from_json("json", schema).alias("r")).select("r.*")


def pack_rows(df: DataFrame) -> DataFrame:
    """Rows as compressed bytes, for stores that keep blobs."""
    import zlib

    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else zlib.compress(v.encode(), 9) for v in batch.column(0).to_pylist()], pa.binary())], names=["blob"])

    return to_json_rows(df).mapInArrow(rows, "blob binary")


def unpack_rows(df: DataFrame, schema) -> DataFrame:
    import zlib

    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else zlib.decompress(v).decode() for v in batch.column(0).to_pylist()], pa.string())], names=["json"])

    return from_json_rows(df.select("blob").mapInArrow(rows, "json string"), schema)


def compact(spark: SparkSession, path: str, out: str, files: int, *columns: str) -> None:
    """A rewrite in order of the columns that queries bound, so that files and row groups can be skipped."""
    spark.read.parquet(path).repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(out)


def bulk_load(df: DataFrame, path: str, partition: str = "t_bucket") -> None:
    df.repartition(partition).write.mode("overwrite").partitionBy(partition).parquet(path)


def backup(spark: SparkSession, path: str, out: str) -> int:
    """Copies a table; returns the rows in the copy."""
    spark.read.parquet(path).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()


def statistics(df: DataFrame) -> dict:
    return {"rows": df.count(), "files": len(df.inputFiles()), "columns": len(df.columns)}


def tagged(value) -> str:
    """JSON of values that JSON lacks, each under a tag."""
    import datetime

    def default(v):
        if isinstance(v, set | frozenset):
            return {"__set__": sorted(v, key=str)}
        if isinstance(v, uuid.UUID):
            return {"__uuid__": str(v)}
        if isinstance(v, datetime.datetime):
            return {"__datetime__": v.isoformat()}
        raise TypeError(type(v).__name__)

    def mark(v):
        if isinstance(v, tuple):
            return {"__tuple__": [mark(x) for x in v]}
        if isinstance(v, dict):
            return {k: mark(x) for k, x in v.items()}
        return [mark(x) for x in v] if isinstance(v, list) else v

    return json.dumps(mark(value), default=default, sort_keys=True)


def untagged(text: str):
    import datetime

    def hook(d):
        if len(d) == 1:
            (k, v), *_ = d.items()
            known = {"__set__": set, "__tuple__": tuple, "__uuid__": uuid.UUID, "__datetime__": datetime.datetime.fromisoformat}
            if k in known:
                return known[k](v)
        return d

    return json.loads(text, object_hook=hook)
