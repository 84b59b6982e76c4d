"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014),
and the pairs under a key that no link joins yet."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import forget, staged

#: Rows of a key that are gathered into one block.
BLOCK = 512
BITS = 64


def connected_components(links: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id in ``links``; the component is its smallest id.

    Each step gives a node at most one row for each of its links, whatever the size of the group; minima are
    combined before the shuffle. The steps end when a round changes nothing. Links with a null end are no links.
    """
    ends = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = staged(ends.select("u").union(ends.select("v")).distinct(), "nodes")
    edges = staged(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        last, edges = edges, staged(_small_star(_large_star(edges)), "links")
        forget(last)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now["n"], now["x"]) == seen:
            break
        seen = (now["n"], now["x"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(edges, "u", "left").select(F.col("u").alias("id"), F.coalesce("v", "u").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one around that node."""
    both = edges.union(edges.select("v", "u"))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def centres(large: DataFrame) -> DataFrame:
    """``(key, centre)`` of ``(key, id, fp)``: of each key the fingerprint closest to the bits that most have."""
    counts = large.groupBy("key").agg(F.count("*").alias("all"), *[F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)])
    most = reduce(lambda x, b: x.bitwiseOR(F.shiftleft((F.col(f"b{b}") * 2 > F.col("all")).cast("long"), b)), range(BITS), F.lit(0).cast("long"))
    apart = large.join(staged(counts.select("key", most.alias("most")), "most"), "key").select("key", F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("most"))).alias("d"), "id").alias("at"))
    return apart.groupBy("key").agg(F.min("at").alias("at")).select("key", F.col("at.id").alias("centre"))


def unsettled(members: DataFrame) -> DataFrame:
    """Rows of ``(key, id, own, ...)`` under keys with more than one ``own``, with the number ``n`` of rows under the key."""
    several = members.groupBy("key").agg(F.count("*").alias("n"), F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("key", "n")
    return members.hint("merge").join(several, "key")


def pairs_apart(members: DataFrame, alike: Callable[[Column, Column], Column], block: int = BLOCK) -> DataFrame:
    """``(u, v)``, u > v: all pairs of ids of one key whose ``own`` differ and that are ``alike``, of ``unsettled`` rows.

    ``alike`` is given both rows as structs. Blocks of rows are joined, not rows, so that a large key is many tasks and
    its pairs of all are never rows of a table; they are looked at, though, which grows with its square.
    """
    dealt = members.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)).cast("int"))
    blocks = staged(dealt.groupBy("key", "block").agg(F.collect_list(F.struct(*[c for c in members.columns if c != "n"])).alias("rows")), "blocks")
    # dealt by number, as few bytes are much work here
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = blocks.select("key", F.col("block").alias("from"), F.explode(F.sequence(F.lit(0), "block")).alias("block"), F.col("rows").alias("a"))
    a, b = (t.repartition(parts, "key", "block") for t in (a, blocks.withColumnRenamed("rows", "b")))
    both = a.hint("merge").join(b, ["key", "block"])

    def found(x: Column) -> Column:
        # a filter for each test, so that the second is made of few
        others = F.filter("b", lambda y: (x["own"] != y["own"]) & ((x["id"] > y["id"]) | (F.col("from") != F.col("block"))))
        return F.transform(F.filter(others, lambda y: alike(x, y)), lambda y: F.struct(F.greatest(x["id"], y["id"]).alias("u"), F.least(x["id"], y["id"]).alias("v")))

    return both.select(F.inline(F.flatten(F.transform("a", found)))).distinct()
