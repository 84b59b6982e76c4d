"""Exact top-k by integer inner product: a Voronoi join of queries and data.

Queries and data are both grouped by their nearest pivot; a group of queries and one of data are cells of the same
diagram. Summaries tell of each group its size and radius, and of query groups the lowest k-th best score that their
queries reach on a bounded sample of the data, which no true k-th best is below. From pivots and radii follows how much
any pair of a query group and a data cell can score; only pairs that can reach the query group's bound are kept. In
these, a vector is sent to a query group only if p.x + r|x| reaches the bound too, with the group's pivot p and radius r;
and queries are sent only where vectors of such cells lie. There are far fewer groups of queries than cells of data, as a
vector goes to every group that it can reach. Small cells lie together in blocks, cells of many rows are cut into several, and large query
groups into parts, so that what is solved in one task is of bounded size. The best of all are merged.
Ties go to the smaller id.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Shorter vectors
count as filled up with zeros. A query is never compared with rows of its own id. Repeated rows each count, also as
queries: each gets its own k. Fewer than k candidates give fewer rows; no queries or an empty table give an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import staged

SCALE = 256
#: Vectors in the sample that bounds scores.
SAMPLE = 2048
#: Rows that a cell, and queries that a group has on average; pivots of cells and of groups at most.
CELL_ROWS, ASKING, PIVOTS, GROUPS = 256, 256, 1024, 256
#: Queries and data rows solved in one task at most.
GROUP_ROWS, BLOCK_ROWS = 2048, 20_000
#: Numbers of a batch's table of rows by pivots, and rows given out at once: they set how many rows are taken.
TABLE, SENT = 1 << 21, 1 << 15


def _usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(vectors: list[np.ndarray], width: int = 0) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    width = max([width, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; in floating point where that is exact too."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * max(1, width) < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, queries: list[tuple], ids: np.ndarray, k: int) -> list[tuple]:
    """(query, id, score) of each query's k best; queries are (number, id), ``ids`` ascend, so that ties go to the smaller."""
    out = []
    for (number, query), row in zip(queries, scores, strict=True):
        own = ids != query
        row, left = row[own], ids[own]
        if len(row) > k:
            high = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
            row, left = row[high], left[high]
        for j in np.argsort(-row, kind="stable")[:k]:
            out.append((number, query, int(left[j]), int(row[j])))
    return out


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivot closest to each row, the first of equals, and a distance that the true one is not above."""
    p = np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1]))).astype(float)
    x = x.astype(float)
    apart = (x**2).sum(axis=1)[:, None] - 2 * x @ p.T + (p**2).sum(axis=1)[None]
    cell = apart.argmin(axis=1)
    return cell, np.sqrt(((x - p[cell]) ** 2).sum(axis=1)) * (1 + 1e-9)


def reaching(groups: np.ndarray, radius: np.ndarray, low: np.ndarray, cells: np.ndarray, cell_radius: np.ndarray) -> np.ndarray:
    """Whether any query of a group can score its bound with any row of a cell; a negative radius means none there.

    For q = p + u and x = c + v with |u| <= r and |v| <= s, q.x is at most p.c + r|c| + s|p| + rs.
    """
    p, c = groups.astype(float), cells.astype(float)
    size_p, size_c = (np.sqrt((x**2).sum(axis=1)) for x in (p, c))
    most = p @ c.T + radius[:, None] * size_c[None] + cell_radius[None] * size_p[:, None] + radius[:, None] * cell_radius[None]
    return (radius[:, None] >= 0) & (cell_radius[None] >= 0) & (most + np.abs(most) * 1e-9 + 1 >= low[:, None])


def laid_out(rows: list[int], most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block, number of blocks) of each cell by its rows, and the blocks in all: small cells share one."""
    first, blocks, at, filled = [], [], 0, 0
    for n in rows:
        if n > most or filled + n > most:
            at, filled = at + (filled > 0), 0
        first.append(at)
        blocks.append(max(1, -(-n // most)))
        if blocks[-1] > 1:
            at += blocks[-1]
        else:
            filled += n
    return np.array(first, np.int64), np.array(blocks, np.int64), at + 1


def top_k(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, sample_size: int = SAMPLE, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, asking_rows: int = ASKING) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows whose id is divisible by ``every``, against all others."""
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    data = staged(table.where(F.col(id_col).isNotNull() & _usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"), F.monotonically_increasing_id().alias("number")), "vectors")
    spark, total = data.sparkSession, data.count()
    sample = data.orderBy(F.xxhash64("id"), "id").limit(sample_size).collect()
    known = matrix([np.array(r["x"], np.int64) for r in sample])
    known_ids = np.array([r["id"] for r in sample], np.int64)
    asked = data.where(F.col("id") % every == 0).count()
    pivots = known[: max(1, min(len(known), PIVOTS, -(-total // cell_rows)))]
    heads = known[: max(1, min(len(known), GROUPS, -(-asked // asking_rows)))]
    seen = spark.sparkContext.broadcast((known, known_ids, pivots, heads))  # sample_size rows at most

    def place(frames):
        """Cells of all rows; of queries also their group, and what they score on the sample at least."""
        known, known_ids, pivots, heads = seen.value
        step = max(1, TABLE // max(1, len(known)))
        for whole in frames:
            for at in range(0, len(whole), step):
                frame = whole.iloc[at : at + step]
                x = matrix([np.asarray(v, np.int64) for v in frame["x"]], known.shape[1])
                (cell, s), (group, r) = nearest_pivots(x, pivots), nearest_pivots(x, heads)
                asks, ids = (frame["id"] % every == 0).to_numpy(), frame["id"].to_numpy()
                scores = np.where(ids[asks][:, None] == known_ids[None], np.iinfo(np.int64).min, products(x[asks], known))
                low = np.full(len(x), np.iinfo(np.int64).min)
                if asks.any() and scores.shape[1] > k:
                    low[asks] = np.partition(scores, -k, axis=1)[:, -k]
                yield pd.DataFrame({"cell": cell, "grp": np.where(asks, group, -1), "number": frame["number"], "id": ids, "x": frame["x"], "s": s, "r": r, "low": low})

    placed = staged(data.mapInPandas(place, "cell int, grp int, number long, id long, x array<long>, s double, r double, low long"), "placed")
    cell_radius, rows = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
    for c in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("s").alias("s")).collect():  # a row for each pivot
        cell_radius[c["cell"]], rows[c["cell"]] = c["s"], c["n"]
    radius, low, parts = np.full(len(heads), -1.0), np.zeros(len(heads)), np.ones(len(heads), np.int64)
    for c in placed.where("grp >= 0").groupBy("grp").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.min("low").alias("low")).collect():
        radius[c["grp"]], low[c["grp"]], parts[c["grp"]] = c["r"], c["low"], -(-c["n"] // group_rows)
    first, blocks, count = laid_out(rows.tolist(), block_rows)
    pairs = reaching(heads, radius, low, pivots, cell_radius) if len(known) else np.zeros((len(heads), len(pivots)), bool)
    lies = np.zeros((len(heads), count), bool)
    for cell in range(len(pivots)):
        lies[:, first[cell] : first[cell] + blocks[cell]] |= pairs[:, [cell]]
    limits = spark.sparkContext.broadcast((radius, low, first, blocks, parts, pairs, lies))  # groups by cells and by blocks
    key = "grp int, part int, block int"

    def split(numbers: np.ndarray, into: np.ndarray) -> np.ndarray:
        """A part for each row, by a hash of its number."""
        mixed = (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return (mixed % into.astype(np.uint64)).astype(np.int64)

    def send(frames):
        """Rows to every part of the query groups that they can reach."""
        *_, heads = seen.value
        radius, low, first, blocks, parts, pairs, _ = limits.value
        step = max(1, SENT // max(1, int(parts.sum())))
        for whole in frames:
            for at in range(0, len(whole), step):
                frame = whole.iloc[at : at + step]
                x, cell = matrix([np.asarray(v, np.int64) for v in frame["x"]], heads.shape[1]), frame["cell"].to_numpy()
                p = np.pad(heads, ((0, 0), (0, x.shape[1] - heads.shape[1])))
                most = products(x, p) + np.sqrt((x.astype(float) ** 2).sum(axis=1))[:, None] * radius[None]
                # the slack covers rounding; it can only send more
                here, groups = np.nonzero(pairs.T[cell] & (most + np.abs(most) * 1e-9 + 1 >= low[None]))
                again = parts[groups]
                part = np.arange(again.sum()) - np.repeat(again.cumsum() - again, again)
                here, groups = np.repeat(here, again), np.repeat(groups, again)
                block = (first[cell] + split(frame["number"].to_numpy(), blocks[cell]))[here]
                yield pd.DataFrame({"grp": groups, "part": part, "block": block, "id": frame["id"].to_numpy()[here], "x": frame["x"].to_numpy()[here]})

    def ask(frames):
        """Queries to every block with a cell that their group can reach."""
        *_, parts, _, lies = limits.value
        step = max(1, SENT // lies.shape[1])
        for whole in frames:
            for at in range(0, len(whole), step):
                frame = whole.iloc[at : at + step]
                group = frame["grp"].to_numpy()
                here, block = np.nonzero(lies[group])
                part = split(frame["number"].to_numpy(), parts[group])
                yield pd.DataFrame({"grp": group[here], "part": part[here], "block": block, "number": frame["number"].to_numpy()[here], "id": frame["id"].to_numpy()[here], "x": frame["x"].to_numpy()[here]})

    sent = placed.select("cell", "number", "id", "x").mapInPandas(send, f"{key}, id long, x array<long>")
    asking = placed.where("grp >= 0").select("grp", "number", "id", "x").mapInPandas(ask, f"{key}, number long, id long, x array<long>")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_values("id", kind="stable")
            ids, x = right["id"].to_numpy(), matrix([np.asarray(v, np.int64) for v in right["x"]])
            for at in range(0, len(left), 256):
                some = left.iloc[at : at + 256]
                out += best(products(matrix([np.asarray(v, np.int64) for v in some["x"]]), x), list(zip(some["number"].tolist(), some["id"].tolist(), strict=True)), ids, k)
        return pd.DataFrame(out, columns=["number", "query_id", "vec_id", "score"]).astype("int64")

    by = ["grp", "part", "block"]
    found = asking.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(solve, "number long, query_id long, vec_id long, score long")
    order = Window.partitionBy("number", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
