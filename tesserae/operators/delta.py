"""Delta chains on flat content: folding, as-of states, checkpoints, compaction, comparison.

Content is a map of strings. States are folds in time order, later values winning. Per key the last value is a maximum
over a struct, which sums up before the shuffle, so long or hot histories are never sorted in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import merge_maps

MAP = "map<string,string>"


def fold_states(deltas: DataFrame, key: str, order: list[str], content: str = "content", until: Column | None = None) -> DataFrame:
    """``(key, content)``: the merge of all deltas up to ``until``; pairs are aggregated one by one."""
    rows = deltas if until is None else deltas.where(until)
    pairs = rows.select(key, *order, F.explode(content).alias("_name", "_value"))
    last = pairs.groupBy(key, "_name").agg(F.max_by("_value", F.struct(*order)).alias("_value"))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_value")))).alias("content"))


def running_states(deltas: DataFrame, key: str, order: list[str], names: list[str], content: str = "content") -> DataFrame:
    """The state after every delta, for stated names: one sorted pass carries the last value of each."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select("*", *[F.last(F.col(content).getItem(n), ignorenulls=True).over(w).alias(f"state_{n}") for n in names])


def chain_closure(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(start, node_id, depth)``: all that is reachable by references, each node at its least depth; cycles end.

    With ``max_depth`` only what lies so near; else to the end, in as many rounds as the depth has binary digits.
    """
    from tesserae.sources.store import written

    seen = starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("depth"))
    frontier = seen
    links = edges.select(F.col(src).alias("node_id"), F.col(dst).alias("next")).distinct()
    if max_depth is None:
        return _whole_closure(seen, links)
    for depth in range(1, max_depth + 1):
        step = frontier.join(links, "node_id").select("start", F.col("next").alias("node_id")).distinct()
        frontier = written(step.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def _whole_closure(seen: DataFrame, links: DataFrame) -> DataFrame:
    """Pointer doubling: ``seen`` holds what is nearer than ``step``, ``jumps`` what is ``step`` references away."""
    from tesserae.sources.store import written

    jumps, step, n = links, 1, seen.count()
    while True:
        farther = seen.join(jumps, "node_id").select("start", F.col("next").alias("node_id"), (F.col("depth") + step).alias("depth"))
        seen = written(seen.union(farther).groupBy("start", "node_id").agg(F.min("depth").alias("depth")), "closure")
        before, n = n, seen.count()
        if n == before:
            return seen
        jumps = written(jumps.join(_onward(jumps), "next").select("node_id", F.col("after").alias("next")).distinct(), "jumps")
        step *= 2


def _onward(jumps: DataFrame) -> DataFrame:
    """``(next, after)``: the same jumps, to be joined where others end."""
    return jumps.select(F.col("node_id").alias("next"), F.col("next").alias("after"))


def apply_delta(original: DataFrame, delta: DataFrame) -> DataFrame:
    """New nodes that change others: position is inherited where the delta has none."""
    base = original.select(F.col("node_id").alias("parent_id"), F.col("distance").alias("_r"), F.col("angle").alias("_a"))
    return delta.join(base, "parent_id").select("node_id", "parent_id", "time", F.coalesce("distance", "_r").alias("distance"), F.coalesce("angle", "_a").alias("angle"), "content")


def compress_chains(chain: DataFrame, key: str, keep: int, order: list[str]) -> DataFrame:
    """All but the last ``keep`` deltas of a key become one that holds their merge; states stay what they were."""
    from tesserae.sources.store import written

    # histories are read and sorted once; all that follows reads what was written
    ranked = written(chain.select(key, *order, "content", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])).alias("_r")), "ranked")
    old = ranked.where(F.col("_r") > keep)
    merged = fold_states(old, key, order).join(old.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(c) for c in order], F.count("*").alias("merged")), key)
    return ranked.where(F.col("_r") <= keep).select(key, *order, "content", F.lit(1).cast("long").alias("merged")).unionByName(merged.select(key, *order, "content", "merged"))


def valid_links(chain: DataFrame, key: str, order: list[str], id_: str, previous: str) -> DataFrame:
    """Rows whose link names the row before them."""
    before = F.lag(id_).over(Window.partitionBy(key).orderBy(*order))
    return chain.withColumn("_b", before).where(F.col("_b").eqNullSafe(F.col(previous))).drop("_b")


def checkpoints(deltas: DataFrame, key: str, order: list[str], at: float, when: str = "t") -> DataFrame:
    """States at a time, to be kept as a table ``(key, ts, content)``."""
    return fold_states(deltas, key, order, until=F.col(when) <= at).select(key, F.lit(float(at)).alias("ts"), "content")


def state_at(deltas: DataFrame, checkpoints_: DataFrame, key: str, order: list[str], at: float, when: str = "t") -> DataFrame:
    """States at a time from the last checkpoint not after it and the deltas since."""
    base = checkpoints_.where(F.col("ts") <= at).groupBy(key).agg(F.max_by(F.struct("ts", "content"), "ts").alias("c"))
    since = deltas.where(F.col(when) <= at).join(base.select(key, F.col("c.ts").alias("_from")), key, "left").where(F.col("_from").isNull() | (F.col(when) > F.col("_from")))
    later = fold_states(since, key, order).withColumnRenamed("content", "_later")
    both = base.select(key, F.col("c.content").alias("_base")).join(later, key, "full")
    return both.select(key, merge_maps(F.col("_base"), F.col("_later")).alias("content"))


def prune(deltas: DataFrame, key: str, order: list[str], older_than: float, when: str = "t") -> tuple[DataFrame, DataFrame]:
    """(checkpoints at the cut, deltas after it): together they give the same states from the cut on."""
    return checkpoints(deltas, key, order, older_than, when), deltas.where(F.col(when) > older_than)


def states_at_each(deltas: DataFrame, moments: DataFrame, key: str, order: list[str], when: str = "t") -> DataFrame:
    """``(key, moment, content)`` at several moments in one pass: a delta belongs to the first moment not before it."""
    points = sorted(r[0] for r in moments.collect())  # stated by the caller
    first = F.element_at(F.filter(F.array(*[F.lit(float(p)) for p in points]), lambda p: p >= F.col(when)), 1)
    pairs = deltas.where(F.col(when) <= points[-1]).withColumn("moment", first).select(key, "moment", *order, F.explode("content").alias("_name", "_value"))
    last = pairs.groupBy(key, "_name", "moment").agg(F.max_by("_value", F.struct(*order)).alias("_value"))
    spread = last.groupBy(key, "_name").agg(F.map_from_entries(F.collect_list(F.struct("moment", "_value"))).alias("by"))
    w = F.explode(F.array(*[F.lit(float(p)) for p in points]))
    filled = spread.select(key, "_name", "by", w.alias("moment"))
    upto = Window.partitionBy(key, "_name").orderBy("moment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = filled.withColumn("_value", F.last(F.col("by").getItem(F.col("moment")), ignorenulls=True).over(upto)).where("_value is not null")
    return filled.groupBy(key, "moment").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_value")))).alias("content"))


def compare(a: Column, b: Column) -> dict[str, Column]:
    """Names that two contents differ in: added, removed, changed; null and empty differ from each other."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return {
        "added": F.sort_array(F.array_except(F.map_keys(b), F.map_keys(a))),
        "removed": F.sort_array(F.array_except(F.map_keys(a), F.map_keys(b))),
        "changed": F.sort_array(F.filter(shared, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))),
    }


def encode(old: Column, new: Column) -> Column:
    """A delta of contents: what is set and what is removed."""
    parts = compare(old, new)
    names = F.concat(parts["added"], parts["changed"])
    return F.struct(F.map_filter(new, lambda k, v: F.array_contains(names, k)).alias("set"), parts["removed"].alias("removed"))


def decode(old: Column, delta: Column) -> Column:
    return merge_maps(F.map_filter(old, lambda k, v: ~F.array_contains(delta["removed"], k)), delta["set"])


def compaction(sizes: Column, most: int) -> Column:
    """Sizes of deltas in order; neighbours are merged as long as they hold ``most`` operations together."""
    start = F.array().cast("array<bigint>")

    def step(acc: Column, n: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when(F.size(acc) == 0, F.array(n)).when(last + n <= most, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(last + n))).otherwise(F.concat(acc, F.array(n)))

    return F.aggregate(sizes, start, step)


def compact_chains(chain: DataFrame, key: str, order: list[str], ops: str, most: int) -> DataFrame:
    """``(key, before, after)``: lengths of chains before and after compaction."""
    sized = chain.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, ops))), lambda s: s[ops].cast("bigint")).alias("sizes"))
    return sized.select(key, F.size("sizes").cast("long").alias("before"), F.size(compaction(F.col("sizes"), most)).cast("long").alias("after"))


def analyse_chains(chain: DataFrame, key: str, ops: str, when: str, small: int = 5) -> DataFrame:
    """Length, bytes, small deltas (but the last), ends, and what to do about it."""
    w = Window.partitionBy(key)
    ranked = chain.withColumn("_last", F.row_number().over(w.orderBy(F.desc(when), F.desc("node_id"))) == 1)
    out = ranked.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json("content"))).alias("bytes"), F.count_if((F.col(ops) <= small) & ~F.col("_last")).alias("small"), F.min(when).alias("oldest"), F.max(when).alias("newest"))
    advice = F.array_compact(F.array(F.when(F.col("n") > 50, F.lit("add_checkpoints")), F.when(F.col("small") > 5, F.lit("compact_chain")), F.when(F.col("n") > 10, F.lit("prune_chain"))))
    return out.withColumn("advice", F.concat_ws(",", advice))


def optimise_versions(versions: DataFrame, keep: int = 10, merge: int = 5) -> DataFrame:
    """By node: versions, how many would be pruned, and how many of the oldest kept are merged into one."""
    n = versions.groupBy("node_id").agg(F.count("*").alias("n"))
    kept = F.least(F.col("n"), F.lit(keep))
    merged = F.when(kept >= merge, merge - 1).otherwise(0)
    return n.select("node_id", "n", (F.col("n") - kept).alias("pruned"), merged.cast("long").alias("merged"), (kept - merged).cast("long").alias("left"))


def optimise_all(versions: DataFrame, keep: int = 10, merge: int = 5) -> DataFrame:
    """One row over all nodes: nodes, versions before, pruned, merged, versions after."""
    each = optimise_versions(versions, keep, merge)
    return each.agg(F.count("*").alias("nodes"), F.sum("n").alias("before"), F.sum("pruned").alias("pruned"), F.sum("merged").alias("merged"), F.sum("left").alias("after"))


#: Bytes of the fields that every delta record has (node id, time, delta id), and of its link.
RECORD_BYTES, LINK_BYTES = 40, 16


def record_size(previous: Column, metadata: Column, ops: Column) -> Column:
    """Estimated bytes of a delta record: fixed fields, its link if it has one, and its JSON texts."""
    link = F.when(previous.isNotNull(), LINK_BYTES).otherwise(0)
    return (RECORD_BYTES + link + F.length(metadata) + F.aggregate(F.transform(ops, F.length), F.lit(0), lambda n, k: n + k)).cast("long")


def version_delta(versions: DataFrame, columns: list[str]) -> DataFrame:
    """Each version with its changed columns against the one before."""
    w = Window.partitionBy("node_id").orderBy("version")
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(c)) for c in columns]))
    return versions.withColumn("changed", F.when(F.col("version") == 1, F.array(*[F.lit(c) for c in columns])).otherwise(changed))


def reconstruct(versions: DataFrame, target: int, columns: list[str]) -> DataFrame:
    """Nodes at a version; those without it are absent."""
    upto = versions.where(F.col("version") <= target).groupBy("node_id").agg(F.max("version").alias("version"), *[F.max_by(c, "version").alias(c) for c in columns])
    return upto.where(F.col("version") == target)


def reconstruct_list(deltas: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Contents from stated deltas ``(key, delta_id, place)``, in that order."""
    return fold_states(deltas.join(wanted, [key, "delta_id"]), key, ["place"])
