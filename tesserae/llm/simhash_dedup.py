"""SimHash near-duplicates with a generalised pigeonhole filter.

Fingerprints within ``max_distance`` bits are linked. Bits that vary together are grouped into partitions, and a
dynamic program shares out thresholds t_i (-1: not probed) with sum(t_i + 1) = max_distance + 1 so that the estimated
probes and candidates are fewest. Two linked fingerprints then agree within t_i bits on some partition, so they meet
under a probe key. Keys with few fingerprints are verified pair by pair. Under a key with many, no pairs are emitted:
those fingerprints are re-keyed by the points half the distance away, where all that meet are linked by construction,
so the work stays linear in the group.

Ties and repeats: equal fingerprints collapse before probing. Null or empty text has fingerprint zero and is linked
like any other. A null id takes no part in minima. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tesserae.llm.common import staged, utf8
from tesserae.llm.components import connected_components

BITS = 64
SEED = 42
#: Largest number of fingerprints under one key that are compared in pairs; larger keys go the linear way.
PAIRWISE = 64
#: Fingerprints looked at for correlations and estimates; they steer cost only, never the result.
SAMPLE = 2048


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Unsigned fingerprint of words: a bit is set where over half of the shingles' hashes have it."""
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digests = b"".join(map(xxh64_digest, grams, repeat(SEED)))
    n = len(digests) // 8
    bytes_ = np.frombuffer(digests, np.uint8).reshape(n, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        counts += np.unpackbits(bytes_[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, fp)`` of every row; fp holds the 64 bits as a signed long."""

    def rows(batches):
        for batch in batches:
            made = [fingerprint(text.lower().split(), shingle) for text in batch.column(1).to_pylist()]
            signed = np.array(made, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(rows, f"id {kind}, fp long")


def partition_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` even groups of bits; a group grows by the bit that varies most with those it has."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    spread = bits.std(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        alike = np.abs(np.nan_to_num(((bits - bits.mean(0)).T @ (bits - bits.mean(0)) / max(1, len(bits))) / np.outer(spread, spread)))
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [free.pop(0)]
        while len(group) < width:
            best = max(free, key=lambda b: (alike[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def estimate(sample: np.ndarray, total: int, bits: list[int], radius: int) -> tuple[float, float]:
    """(probe rows, candidate pairs) of a partition probed within ``radius`` bits; none for -1."""
    if radius < 0:
        return 0.0, 0.0
    probes = total * sum(comb(len(bits), r) for r in range(radius + 1))
    n = len(sample)
    met = 0
    for at in range(0, n, 256):
        apart = np.bitwise_count((sample[at : at + 256, None] ^ sample[None, :]) & _mask(bits))
        met += int((apart <= radius).sum())
    met = (met - n) / 2
    by_chance = sum(comb(len(bits), r) for r in range(radius + 1)) / 2.0 ** len(bits)
    rate = max(met / max(1, n * (n - 1) / 2), by_chance)
    return float(probes), rate * total * (total - 1) / 2


def allocate(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds: fewest estimated probes and candidates, over all numbers of partitions."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, distance + 2):
        groups = partition_bits(sample, parts)
        # least[s]: cost and choice with sum of (t_i + 1) equal to s over the partitions so far
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            grown: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in least.items():
                for t in range(-1, distance - used + 1):
                    more = cost + sum(estimate(sample, total, bits, t))
                    key = used + t + 1
                    if key not in grown or more < grown[key][0]:
                        grown[key] = (more, [*chosen, t])
            least = grown
        cost, chosen = least[distance + 1]
        if best is None or cost < best[0]:
            best = (cost, [(b, t) for b, t in zip(groups, chosen, strict=True) if t >= 0])
    assert best is not None
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _flips(bits: list[int], radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in chosen)) for r in range(radius + 1) for chosen in combinations(bits, r)]


def probe_keys(sample: np.ndarray, total: int, distance: int) -> list[tuple[int, int, int]]:
    """(partition, mask, flip) of each key of a fingerprint: its bits under the mask, with those of the flip turned."""
    chosen = allocate(sample, total, distance)
    return [(k, _signed(int(_mask(bits))), flip) for k, (bits, t) in enumerate(chosen) for flip in _flips(bits, t)]


def _ball(fp: Column, radius: int) -> Column:
    """Rows (z, near): every point within ``radius`` bits."""
    flips = _flips(list(range(BITS)), radius)
    return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: fp.bitwiseXOR(x))


def links(distinct: DataFrame, distance: int, pairwise: int = PAIRWISE, sample_size: int = SAMPLE, within: tuple[str, ...] = ()) -> DataFrame:
    """Links ``(within..., u, v)`` among distinct fingerprints ``fp`` with the components of all pairs within ``distance`` bits.

    Fingerprints are compared only where the columns ``within`` are the same.
    """
    sample = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_size).collect()], np.int64).view(np.uint64)
    keys = probe_keys(sample, distinct.count(), distance)
    probe = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(x)).alias("key")) for k, m, x in keys])
    probes = distinct.select(*within, "fp", F.explode(probe).alias("p")).select(*within, "p.part", "p.key", "fp")
    by = [*within, "part", "key"]
    shared = staged(probes.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = staged(probes.join(shared, by), "met")
    small = met.where(F.col("n") <= pairwise)
    pairs = small.select(*by, F.col("fp").alias("u")).join(small.select(*by, F.col("fp").alias("v")), by)
    pairs = pairs.where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select(*within, "u", "v")
    large = met.where(F.col("n") > pairwise).select(*within, "fp").distinct()
    near, far = distance // 2, distance - distance // 2
    # what lies within near bits of a point is linked to it all round; what lies at far bits, to anything near
    balls = large.select(*within, "fp", F.explode(_ball(F.col("fp"), far)).alias("z")).withColumn("close", F.bit_count(F.col("fp").bitwiseXOR(F.col("z"))) <= near)
    centre = balls.groupBy(*within, "z").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("v"), F.count("*").alias("n")).where("n > 1 and v is not null").select(*within, "z", "v")
    stars = balls.join(centre, [*within, "z"]).where("fp <> v").select(*within, F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(id, fp, component_id)`` for every row: the smallest id among all documents reachable over links."""
    marked = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    groups = connected_components(links(distinct.select("fp"), distance), "u", "v").withColumnRenamed("id", "fp")
    named = distinct.join(groups, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(lowest, "component").select("fp", "component_id"), "fp").select("id", "fp", "component_id")
