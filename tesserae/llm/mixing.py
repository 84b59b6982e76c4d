"""Mixing sources to target weights by capped water-filling.

Sources share the words to be taken by weight. A source whose share passes ``max_epochs`` times its size is clamped
there and its excess is shared out again by weight, until none is above. With sources ordered by cap over weight, the
clamped ones come first, so the level is found by running sums over the table of sources. A target of f sizes takes
every document floor(f) times, and the fraction once more for documents in the order of a seeded hash: hash buckets are
summed, the cut is put where the words taken stay within the target, and the bucket that then comes nearest to it is
added. Reruns agree.

Null text has size 0; null sources form one source, last in order. Repeated rows are taken alike. A source of size 0
has target 0. An empty table gives an empty result. Extra columns are carried along, but for those of the names in
``OWN``, which are replaced. The table of sources, a row for each, is ordered in one task; documents never are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import staged, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3.0
SEED = 17
#: Hash buckets that a source is cut into, in all.
BUCKETS = 4096
#: Names of columns that are added or used meanwhile.
OWN = ("mix_size", "mix_source_size", "mix_target", "mix_times", "mix_taken", "mix_bucket", "mix_source", "mix_whole", "mix_cut", "mix_extra", "mix_copy")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_times (how often the document is taken) and mix_taken (its words)."""
    docs = docs.drop(*[c for c in OWN if c not in (id_col, text_col, source_col)])
    size = word_count(F.col(text_col))
    bucketed = docs.withColumn("mix_size", size).withColumn("mix_bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("mix_size")), F.lit(BUCKETS)).cast("int"))
    summed = staged(bucketed.groupBy(F.col(source_col).alias("mix_source"), "mix_bucket").agg(F.sum("mix_size").alias("part")), "mix")
    found = bucketed.join(cuts(targets(summed, weights, max_epochs), summed), F.col(source_col).eqNullSafe(F.col("mix_source"))).drop("mix_source")
    times = F.col("mix_whole") + F.when((F.col("mix_bucket") < F.col("mix_cut")) | F.coalesce(F.col("mix_bucket") == F.col("mix_extra"), F.lit(False)), 1).otherwise(0)
    return found.withColumn("mix_times", times).withColumn("mix_taken", F.col("mix_size") * F.col("mix_times")).drop("mix_bucket", "mix_cut", "mix_whole", "mix_extra")


def targets(summed: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``(mix_source, mix_source_size, mix_target)``: a row for each source."""
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last()))
    sources = summed.groupBy("mix_source").agg(F.sum("part").alias("mix_source_size")).withColumn("place", place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("mix_source_size") * F.lit(float(max_epochs)))
    upto = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total, all_weight = F.sum("mix_source_size").over(every).cast("double"), F.sum("weight").over(every)
    # with all before it clamped, a source is clamped too if the level then reaches its cap
    level = (total - F.sum("cap").over(upto) + F.col("cap")) / (all_weight - F.sum("weight").over(upto) + F.col("weight"))
    sources = sources.withColumn("total", total).withColumn("all_weight", all_weight).withColumn("clamped", level >= F.col("cap") / F.col("weight"))
    held = F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.col("all_weight") - F.sum(F.when(F.col("clamped"), F.col("weight")).otherwise(0.0)).over(every)
    share = F.least(F.col("cap"), F.col("weight") * (F.col("total") - held) / F.nullif(free, F.lit(0.0)))
    return sources.select("mix_source", "mix_source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(share).alias("mix_target"))


def cuts(sources: DataFrame, summed: DataFrame) -> DataFrame:
    """``sources`` with mix_whole, the full repetitions, and the buckets taken once more: those below mix_cut, and mix_extra.

    The cut is the last at which the words stay within the target; the extra bucket is the one that then comes nearest.
    """
    whole = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(0).cast("int")
    sources = staged(sources.withColumn("mix_whole", whole).withColumn("rest", F.col("mix_target") - whole * F.col("mix_source_size")), "sources")
    upto = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = summed.withColumn("upto", F.sum("part").over(upto)).withColumnRenamed("mix_source", "b_source")
    within = staged(here.join(sources.select("mix_source", "rest"), F.col("b_source").eqNullSafe(F.col("mix_source"))).drop("b_source"), "buckets")
    below = (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))
    cut = within.groupBy(F.col("mix_source").alias("c_source")).agg(F.max(F.when(below, F.col("mix_bucket") + 1).otherwise(0)).alias("mix_cut"), F.max(F.when(below, F.col("upto")).otherwise(0)).alias("got"))
    after = within.join(cut, F.col("mix_source").eqNullSafe(F.col("c_source"))).where("mix_bucket >= mix_cut").withColumn("miss", F.abs(F.col("part") - (F.col("rest") - F.col("got"))))
    extra = after.where("miss < rest - got").groupBy(F.col("mix_source").alias("e_source")).agg(F.min_by("mix_bucket", F.struct("miss", "mix_bucket")).alias("mix_extra"))
    found = sources.join(cut, F.col("mix_source").eqNullSafe(F.col("c_source"))).join(extra, F.col("mix_source").eqNullSafe(F.col("e_source")), "left")
    return staged(found.select("mix_source", "mix_source_size", "mix_target", "mix_whole", "mix_cut", "mix_extra"), "cuts")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as it is taken, without the columns that ``mix`` added."""
    times = F.explode(F.sequence(F.lit(1), F.col("mix_times")))
    return mixed.where("mix_times > 0").withColumn("mix_copy", times).drop("mix_copy", "mix_size", "mix_source_size", "mix_target", "mix_times", "mix_taken")
