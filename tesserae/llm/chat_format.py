"""Tool calls of conversations, linked, ordered, validated and serialised, in DataFrame operations only.

Calls and results are joined by conversation and call id. Calls are put in an order in which each follows the calls it
builds on: where all of those stand earlier in the conversation, positions are such an order; only other conversations go
through rounds that take out the calls whose needs are met. Arguments are checked against the schema of the tool by name,
and calls are written as canonical JSON: keys sorted, no white space, one form for each value.

Defined results: a call without a result is ``open``; a result without a call is an ``orphan`` and comes after the calls;
of several results the first by position counts and their number is given. A repeated call id in a conversation keeps its
first row. Calls in a cycle come last, with ``cyclic`` set. Arguments that are null or no JSON object give the error
``arguments``; an unknown tool gives ``tool``. Null ids never link: such calls stay open and such results orphans, each
different row by itself. Empty tables give empty results; extra columns are ignored. In ``conversation_calls`` turns
without a conversation or a number have null ids too. Turns of one conversation, and the rows of its output, are ordered
in one task; rounds go by the depth of the calls that build on later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import staged

#: Types of a schema and how the type of a parsed value begins.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def schema_table(spark: SparkSession, schemas: dict[str, dict[str, str]], required: dict[str, list[str]] | None = None) -> DataFrame:
    """``(tool, types, required)`` from field types by tool; all fields are required unless said otherwise."""
    rows = [(name, fields, sorted(fields) if required is None or name not in required else required[name]) for name, fields in sorted(schemas.items())]
    return spark.createDataFrame(rows, "tool string, types map<string,string>, required array<string>")


def _type_fits(value: Column, wanted: Column) -> Column:
    found = F.schema_of_variant(value)
    fits = F.lit(False)
    for name, starts in TYPES.items():
        for start in starts:
            fits = fits | ((wanted == name) & found.startswith(start))
    return fits


def errors(arguments: Column, types: Column, required: Column) -> Column:
    """What is wrong with parsed ``arguments``: sorted entries, none if they fit."""
    found = F.try_variant_get(arguments, "$", "map<string,variant>")
    keys = F.map_keys(found)
    missing = F.transform(F.filter(required, lambda f: ~F.array_contains(keys, f)), lambda f: F.concat(F.lit("missing:"), f))
    wrong = F.transform(F.filter(F.map_keys(types), lambda f: F.array_contains(keys, f) & ~_type_fits(F.element_at(found, f), F.element_at(types, f))), lambda f: F.concat(F.lit("type:"), f))
    unknown = F.transform(F.filter(keys, lambda f: ~F.array_contains(F.map_keys(types), f)), lambda f: F.concat(F.lit("unknown:"), f))
    return F.when(types.isNull(), F.array(F.lit("tool"))).when(found.isNull(), F.array(F.lit("arguments"))).otherwise(F.array_sort(F.concat(missing, wrong, unknown)))


def _out_of_order(calls: DataFrame) -> DataFrame:
    """``(conv, call_id, level, cyclic)`` in conversations where a call builds on one that does not stand before it."""
    needs = calls.select("conv", "call_id", "pos", F.explode("after").alias("need"))
    at = calls.select(F.col("conv").alias("c"), F.col("call_id").alias("need_id"), F.col("pos").alias("need_pos"))
    edges = staged(needs.join(at, (F.col("conv") == F.col("c")) & (F.col("need") == F.col("need_id"))).select("conv", "call_id", "need", "pos", "need_pos").distinct(), "needs")
    mixed = edges.where("need_pos >= pos").select("conv").distinct()
    left = staged(calls.join(mixed, "conv", "left_semi").select("conv", "call_id"), "left")
    edges = staged(edges.join(mixed, "conv", "left_semi").select("conv", "call_id", "need"), "needs")
    done, level, remaining = None, 0, left.count()
    while remaining:
        free = staged(left.join(edges, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit(level).alias("level"), F.lit(False).alias("cyclic")), "free")
        if not (taken := free.count()):
            break
        done = free if done is None else done.union(free)
        left = staged(left.join(free, ["conv", "call_id"], "left_anti"), "left")
        edges = staged(edges.join(free.select("conv", F.col("call_id").alias("need")), ["conv", "need"], "left_anti").select("conv", "call_id", "need"), "needs")
        remaining, level = remaining - taken, level + 1
    cyclic = left.select("conv", "call_id", F.lit(level).alias("level"), F.lit(True).alias("cyclic"))
    return cyclic if done is None else done.union(cyclic)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call and each orphan result: ``(conv, seq, call_id, tool, status, n_results, cyclic, errors, json)``.

    ``calls``: conv, call_id, pos, tool, arguments (JSON text), after (ids of calls it builds on).
    ``results``: conv, call_id, pos, content.
    """
    first = calls.groupBy("conv", "call_id", F.when(F.col("conv").isNull() | F.col("call_id").isNull(), F.struct("pos", "tool", "arguments")).alias("_own")).agg(F.min_by(F.struct("tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after")), F.struct("pos", "tool", "arguments")).alias("c"), F.min("pos").alias("pos"))
    first = staged(first.select("conv", "call_id", "pos", "c.tool", "c.arguments", "c.after"), "calls")
    lone = F.when(F.col("conv").isNull() | F.col("call_id").isNull(), F.struct("pos", "content"))  # kept apart, but for equal rows
    answered = results.groupBy("conv", "call_id", lone.alias("_own")).agg(F.min_by("content", F.struct("pos", "content")).alias("content"), F.count("*").alias("n_results"), F.min("pos").alias("result_pos")).drop("_own").withColumnsRenamed({"conv": "r_conv", "call_id": "r_call"})
    linked = first.join(answered.hint("shuffle_hash"), (F.col("conv") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "full")
    is_call = F.col("pos").isNotNull() | F.col("tool").isNotNull() | F.col("call_id").isNotNull()
    linked = linked.withColumn("status", F.when(~is_call, "orphan").when(F.col("n_results").isNull(), "open").otherwise("linked"))
    linked = linked.withColumns({"conv": F.coalesce("conv", "r_conv"), "call_id": F.coalesce("call_id", "r_call"), "pos": F.coalesce("pos", "result_pos")})
    moved = _out_of_order(first).withColumnsRenamed({"conv": "m_conv", "call_id": "m_call"})
    linked = linked.join(staged(moved, "moved"), (F.col("conv") == F.col("m_conv")) & (F.col("call_id") == F.col("m_call")), "left")
    checked = linked.join(schemas.select(F.col("tool").alias("s_tool"), "types", "required"), F.col("tool") == F.col("s_tool"), "left")
    parsed = F.try_parse_json("arguments")
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("tool").alias("name"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    json = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(parsed), F.lit("null")), F.lit(","), F.substr(rest, F.lit(2)))
    order = Window.partitionBy("conv").orderBy((F.col("status") == "orphan"), F.coalesce("cyclic", F.lit(False)), F.coalesce("level", F.lit(0)), "pos", "call_id", "json")
    made = checked.withColumn("json", json).withColumn("errors", F.when(F.col("status") == "orphan", F.array().cast("array<string>")).otherwise(errors(parsed, F.col("types"), F.col("required"))))
    return made.select("conv", F.row_number().over(order).alias("seq"), "call_id", "tool", "status", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "errors", "json")


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn asks, building on the one before; the assistant's turns after it answer."""
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    asked = F.when(F.col("role") == "user", name)
    seen = turns.select("conv_id", "turn", "role", "text", asked.alias("asked")).withColumn("last_asked", F.last("asked", ignorenulls=True).over(upto))
    before = F.lag("last_asked").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    seen = seen.withColumn("before", before)
    calls = seen.where("role = 'user'").select(F.col("conv_id").alias("conv"), F.col("asked").alias("call_id"), F.col("turn").alias("pos"), F.lit("answer").alias("tool"), F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("question"))).alias("arguments"), F.filter(F.array("before"), lambda x: x.isNotNull()).alias("after"))
    results = seen.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), F.coalesce("last_asked", F.concat(F.lit("none-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))).alias("call_id"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    return calls, results
