"""Removing passages that repeat, found level by level.

A passage is a window of ``length`` words whose sequence also starts elsewhere, in the same document or another.

1. The first level looks at short windows of a quarter of that length. In each long window the one with the smallest
   hash stands for it (equal long windows choose alike, so none is lost): about one row in fifteen words. Only what
   repeats is extended.
2. The next windows are twice as long and still inside the long ones they stand for; again only what repeats is kept.
3. At full length, long windows side by side that have the same stand-in form a run. Runs that are equal as a whole
   repeat as a whole; only where runs of one stand-in differ are their single windows compared, each kind of run once.
   Hashes have 128 bits here.

Documents without candidates drop out at each level. Null text has no words. Repeated rows count as separate documents,
so all of their windows repeat. Documents shorter than ``length`` keep all words. Ids may be null or repeat; extra
columns are ignored; an empty table gives an empty result. ``docs`` is read several times; its rows are told apart by
file and place in it, so how scans are split does not matter.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tesserae.llm.common import keyed, staged, utf8

LENGTH = 35
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Powers:
    """Powers of a base and of its inverse, modulo 2^64; grown as texts need."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxh64_digest, words)), ">u8").astype(np.uint64)


def window_hashes(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every window of ``length`` words."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    if which:
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    up, down = _POWERS[which].upto(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    mixed = (sums[length:] - sums[:-length]) * down[: n - length + 1]
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def levels(length: int) -> list[int]:
    """Window lengths from a quarter of ``length``, doubling."""
    first = max(1, -(-length // 4))
    return [*(x for x in (first, 2 * first) if x < length), length]


def anchors(hashes: np.ndarray, length: int) -> np.ndarray:
    """For every window of ``length`` words, where the short window starts that stands for it."""
    short = window_hashes(hashes, levels(length)[0])
    span = length - levels(length)[0] + 1
    if len(hashes) < length:
        return np.empty(0, np.int64)
    return sliding_window_view(short, span).argmin(axis=1) + np.arange(len(hashes) - length + 1)


#: What tells rows apart.
_UID = "_uid struct<file:long,row:long>"


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text")), "_uid")


def _spread(uid: pa.Array, rows: list[int], columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """A batch of arrays put end to end, each with the uid of the row it is of."""
    flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
    sizes = [len(x) for x in columns[0]]
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in flat]
    return pa.RecordBatch.from_arrays([uid.take(pa.array(np.repeat(np.array(rows, np.int64), sizes))), *arrays], names=["_uid", *names])


def span_hashes(hashes: np.ndarray, first: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of ``size`` words from ``first``, for each."""
    if which:
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    up, down = _POWERS[which].upto(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)])
    mixed = (sums[first + size] - sums[first]) * down[first] + size.astype(np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def candidate_runs(hashes: np.ndarray, length: int, ats: np.ndarray) -> list[np.ndarray]:
    """(first window, last window, hash at the middle level, 128-bit hash) of the runs whose short windows start at ``ats``."""
    sizes = levels(length)
    middle = sizes[1] if len(sizes) > 2 else sizes[0]
    stands = anchors(hashes, length)
    # the middle window goes on from the short one where it fits, or else ends with it
    behind = stands - np.arange(len(stands)) > length - middle
    code = 2 * stands + behind
    starts = np.flatnonzero(np.concatenate([np.ones(1, bool), code[1:] != code[:-1]]))
    ends = np.concatenate([starts[1:], [len(code)]]) - 1
    live = np.isin(stands[starts], ats)
    starts, ends = starts[live], ends[live]
    at = stands[starts] - np.where(behind[starts], middle - sizes[0], 0)
    key = window_hashes(hashes, middle)[at]
    return [starts, ends, key, *(span_hashes(hashes, starts, ends - starts + length, k) for k in (0, 1))]


def repeated_windows(numbered: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(_uid, ranges)``: first and last starts of repeated windows, by the rows of ``numbered(_uid, _text)``."""
    short = levels(length)[0]

    def first(batches):
        for batch in batches:
            rows, columns = [], [[], []]
            for row, text in enumerate(batch.column(1).to_pylist()):
                hashes = word_hashes(text.split())
                at = np.unique(anchors(hashes, length))
                if len(at):
                    rows.append(row)
                    columns[0].append(at)
                    columns[1].append(window_hashes(hashes, short)[at])
            yield _spread(batch.column(0), rows, columns, ["at", "h"])

    live = staged(numbered.select("_uid", "_text").mapInArrow(first, f"{_UID}, at long, h long"), "windows")
    # written, so that the join has two plain exchanges and a hash that very many windows share can be split
    again = staged(live.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    wanted = live.join(again, "h", "left_semi").groupBy("_uid").agg(F.collect_list("at").alias("ats"))

    def full(batches):
        for batch in batches:
            rows, columns = [], [[], [], [], [], []]
            for row, (text, ats) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True)):
                rows.append(row)
                for column, values in zip(columns, candidate_runs(word_hashes(text.split()), length, np.array(ats, np.int64)), strict=True):
                    column.append(values)
            yield _spread(batch.column(0), rows, columns, ["i", "j", "key", "a", "b"])

    runs = numbered.join(wanted, "_uid").select("_uid", "_text", "ats").mapInArrow(full, f"{_UID}, i long, j long, key long, a long, b long")
    runs = staged(runs, "runs")
    kinds = staged(runs.groupBy("key", "a", "b").agg(F.count("*").alias("n"), F.min(F.struct("_uid", "i", "j")).alias("one")), "kinds")
    whole = runs.join(kinds.where("n > 1").select("a", "b"), ["a", "b"], "left_semi").select("_uid", "i", "j")
    mixed = kinds.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    shown = kinds.join(mixed, "key", "left_semi")
    # one run of each kind lends its windows; a window repeats if two kinds have it, or if its own run has it twice
    singles = staged(_windows(numbered, shown, length), "singles")
    twice = singles.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    single = singles.where("single").join(twice, ["a", "b"], "left_semi").select("_uid", F.col("start").alias("i"), F.col("start").alias("j"))
    return whole.union(single).groupBy("_uid").agg(F.collect_list(F.struct("i", "j")).alias("ranges"))


def _windows(numbered: DataFrame, shown: DataFrame, length: int) -> DataFrame:
    """``(_uid, start, a, b, single)``: the windows of the runs shown; single: no other run equals this one."""
    wanted = shown.select("one._uid", F.struct("one.i", "one.j", (F.col("n") == 1).alias("single")).alias("r")).groupBy("_uid").agg(F.collect_list("r").alias("rs"))

    def rows(batches):
        for batch in batches:
            here, columns = [], [[], [], [], []]
            for row, (text, rs) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True)):
                hashes = word_hashes(text.split())
                start = np.concatenate([np.arange(r["i"], r["j"] + 1) for r in rs])
                single = np.concatenate([np.full(r["j"] - r["i"] + 1, int(r["single"])) for r in rs])
                here.append(row)
                for column, values in zip(columns, (start, window_hashes(hashes, length)[start], window_hashes(hashes, length, 1)[start], single), strict=True):
                    column.append(values)
            yield _spread(batch.column(0), here, columns, ["start", "a", "b", "single"])

    found = numbered.join(wanted, "_uid").select("_uid", "_text", "rs").mapInArrow(rows, f"{_UID}, start long, a long, b long, single long")
    return found.withColumn("single", F.col("single") == 1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` and, if asked for, ``kept``: the words left, joined by one space."""
    numbered = _numbered(docs, id_col, text_col)
    found = repeated_windows(numbered, length)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def rows(batches):
        for batch in batches:
            total, gone, digest, left = [], [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                total.append(n)
                if ranges:
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, [r["i"] for r in ranges], 1)
                    np.add.at(steps, [r["j"] + length for r in ranges], -1)
                    keep = steps.cumsum()[:n] == 0
                    words = list(compress(words, keep.tolist()))
                gone.append(n - len(words))
                kept = b" ".join(words)
                digest.append(sha256(kept).hexdigest())
                if with_text:
                    left.append(kept.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(left, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = numbered.join(staged(found, "ranges"), "_uid", "left")
    return joined.select("_id", "_text", "ranges").mapInArrow(rows, schema)
