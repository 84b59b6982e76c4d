"""Staging, word splitting and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CONTROL_SPACES = "\t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder in local mode, as all runs on one machine there; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Shuffle files go as soon as the table made of them is written, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ON_THE_WAY: ContextVar[list[DataFrame] | None] = ContextVar("on_the_way", default=None)


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def trim(spark: SparkSession) -> bool:
    """Hands back to the system what the driver's JVM has freed; whether that JVM can.

    Each plan is compiled, and the compilers' memory stays with malloc once they free it: hundreds of MB after some
    hundred small plans. No object of the heap is touched.
    """
    jvm = spark._jvm

    def array(kind, *items):
        made = spark.sparkContext._gateway.new_array(kind, len(items))
        for k, item in enumerate(items):
            made[k] = item
        return made

    named = jvm.java.lang.Class.forName
    kinds = array(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    invoke = named("javax.management.MBeanServer").getMethod("invoke", kinds)  # the server's own class is not open to Py4J
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    call = array(jvm.java.lang.Object, bean, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JJavaError:  # JVMs before 17.0.9, or not on Linux, have no such command
        return False
    return True


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(path)
    trim(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if (others := _ON_THE_WAY.get()) is not None:
        others.append(out)
    return out


def only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, staged; the tables that were staged on the way to it are removed."""
    others: list[DataFrame] = []
    outer = _ON_THE_WAY.set(others)
    try:
        made = staged(make(), name)
    finally:
        _ON_THE_WAY.reset(outer)
    forget(*(t for t in others if t is not made))
    if (around := _ON_THE_WAY.get()) is not None:
        around.append(made)
    return made


def forget(*tables: DataFrame) -> None:
    """Removes the files of staged tables; only once all that was made of them is written itself."""
    for table in tables:
        if path := getattr(table, "staged_path", None):
            jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session.sessionState().newHadoopConf()).delete(place, True)


def _reads_files(docs: DataFrame) -> bool:
    """Whether ``docs`` is a Parquet table, or columns and rows picked from one."""
    if "_metadata" in docs.columns:
        return False
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column that tells its rows apart: a hash of the file's path, and the place in the file.

    It is the same in every scan, however files are split and whichever executors read them. What is not read straight
    from Parquet files is written first. The first result is the one to read on, as the second call may write again.
    """
    key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if _reads_files(docs):
        with contextlib.suppress(AnalysisException):  # other file formats have no row_index
            return docs.select("*", key.alias(name))
    return staged(docs, "rows").select("*", key.alias(name))


def free_name(docs: DataFrame, base: str) -> str:
    """A column name that ``docs`` has not."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (base + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken)


def word_count(text: Column) -> Column:
    """Number of words; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of words; null text: empty."""
    text = F.coalesce(text, F.lit(""))
    held = None
    for char in CONTROL_SPACES:  # most texts have none, and looking is cheaper than replacing
        one = text.contains(char)
        held = one if held is None else held | one
    flat = F.when(held, F.translate(text, CONTROL_SPACES, " " * len(CONTROL_SPACES))).otherwise(text)
    return F.array_remove(F.split(flat, " ", -1), "")


def utf8(text: str | Column) -> Column:
    """Text as bytes: Python gets the UTF-8 form without decoding it; null: empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("binary"), F.lit(b""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` names it inside lambdas."""
    return F.transform(F.array(value), use).getItem(0)
