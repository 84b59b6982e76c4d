"""What the findings of round two asked for."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.llm import components, line_dedup, lm_scoring, near_copies
from tesserae.llm.common import CLEANUP, only, shared_dir, staged


def alike_pairs(n, size, changed):
    """``n`` pairs of texts; those of a pair differ in ``changed`` words, others share none."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(n):
        a = [f"word{x}" for x in rng.integers(0, 10**6, size)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join([f"own{k}", *a[changed:]]))]
    return rows


def test_near_copies_miss_no_pair_under_a_large_key(spark, monkeypatch):
    """All texts have one fingerprint, so that each pair is to be found among all under its keys."""

    def same_prints(rows, prints):
        return rows.select("uid", "doc", F.unhex(F.md5("text")).alias("sig"), F.xxhash64("text").alias("node"), F.array_repeat(F.lit(5).cast("long"), prints).alias("prints"))

    monkeypatch.setattr(near_copies, "_described", same_prints)
    docs = staged(spark.createDataFrame(alike_pairs(25, 80, 1), "doc_id long, text string").repartition(3), "docs")
    groups = {r["id"]: r["component"] for r in near_copies.near_copies(docs, prints=1).collect()}
    assert groups == {k: k // 2 * 2 for k in range(50)}


def test_near_copies_in_rounds_of_fingerprints(spark, monkeypatch):
    """However many fingerprints are probed at once, the groups are the same, and nothing else stays on disk."""
    docs = staged(spark.createDataFrame(alike_pairs(20, 80, 1), "doc_id long, text string").repartition(3), "docs")
    want = {r["id"]: r["component"] for r in near_copies.near_copies(docs, prints=4).collect()}
    monkeypatch.setattr(near_copies, "PROBES", 1)
    before = set(os.listdir(shared_dir(spark)))
    assert {r["id"]: r["component"] for r in near_copies.near_copies(docs, prints=4).collect()} == want
    assert [n.split("-")[0] for n in set(os.listdir(shared_dir(spark))) - before] == ["copies"]


def test_only_keeps_one_table(spark):
    before, was = set(os.listdir(shared_dir(spark))), spark.conf.get(CLEANUP)
    kept = only(lambda: only(lambda: staged(spark.range(5), "inner"), "middle").where("id > 2"), "outer")
    assert kept.count() == 2 and [n.split("-")[0] for n in set(os.listdir(shared_dir(spark))) - before] == ["outer"]
    assert spark.conf.get(CLEANUP) == was


def test_pairs_apart(spark):
    """All pairs of a key that lie near and are in different groups, however rows fall into blocks."""
    rng = np.random.default_rng(3)
    rows = [(int(k), int(i), int(rng.integers(0, 32)), int(rng.integers(0, 4)) if k else 7) for i, k in enumerate(rng.integers(0, 3, 90))]
    want = {(b[1], a[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] != b[3] and (a[2] ^ b[2]).bit_count() <= 2}
    frame = spark.createDataFrame(rows, "key long, id long, fp long, own long")
    near = lambda x, y: F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= 2
    for block in (4, 512):
        assert {tuple(r) for r in components.pairs_apart(components.unsettled(frame), near, block).collect()} == want


def test_scores_are_passed_on_in_parts():
    """Rare words of a few texts at a time are held, however many texts come at once; their counts are whole."""
    texts = [f"rare{k} rare{k} known other{k}".encode() for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts, pa.binary())], names=["id", "text"])
    made = list(lm_scoring.scored(batch, lm_scoring.Network(), {b"known": 0}, lm_scoring.Words({b"known": 0}), 1000))
    assert max(part.num_rows for part in made) < 100
    rows = pa.Table.from_batches(made).to_pylist()
    assert [r["id"] for r in rows] == list(range(300)) and all(r["n_words"] == 4 for r in rows)
    assert all(r["rare"] == [{"word": b"rare%d" % k, "k": 2}, {"word": b"other%d" % k, "k": 1}] for k, r in enumerate(rows))


def test_scores_of_documents(spark):
    """The query's own way through ``scored``: a row for each document, rare words by their share."""
    docs = staged(spark.createDataFrame([(1, "a b c"), (2, None), (3, "a rare b"), (3, "a rare b")], "doc_id long, text string"), "docs")
    rows = sorted((r["id"], r["n_words"], round(r["mean"] * max(1, r["n_words"]) - r["log_likelihood"], 9)) for r in lm_scoring.score(docs, rounds=1).collect())
    assert rows == [(1, 3, 0.0), (2, 0, 0.0), (3, 3, 0.0), (3, 3, 0.0)]


def test_lines_miss_no_pair_under_a_large_key(spark, monkeypatch):
    """All lines have one key and one fingerprint, so that each pair is to be found among all under the key."""
    monkeypatch.setattr(line_dedup, "_keys", lambda tokens: F.array(F.xxhash64(F.lit(1))))
    monkeypatch.setattr(line_dedup, "fingerprints", lambda lines: lines.select("uid", F.lit(5).cast("long").alias("fp")))
    docs = staged(spark.createDataFrame(alike_pairs(40, 30, 1), "doc_id long, text string").repartition(3), "docs")
    groups = {r["doc"]: r["grp"] for r in line_dedup.line_groups(docs).collect()}
    assert all(groups[2 * k] == groups[2 * k + 1] for k in range(40)) and len(set(groups.values())) == 40


def test_lines_apart(spark):
    """All pairs of a key in different groups that fingerprints and lengths allow, however rows fall into blocks."""
    rng = np.random.default_rng(5)
    rows = [(int(k), int(i), int(rng.integers(0, 1 << 40)), int(rng.integers(0, 4)) if k else 7, int(rng.integers(90, 120))) for i, k in enumerate(rng.integers(0, 3, 90))]
    rows += [(4, *r[1:]) for r in rows if r[0] == 1]  # lines that meet under two keys
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[3] != b[3] and (a[2] ^ b[2]).bit_count() <= line_dedup.DISTANCE and 10 * abs(a[4] - b[4]) <= max(a[4], b[4]):
                want.add((b[1], a[1]))
    frame = components.unsettled(spark.createDataFrame(rows, "key long, id long, fp long, own long, letters int"))
    for block in (4, 512):
        got = [tuple(r) for r in line_dedup._apart(frame, line_dedup.SIMILARITY, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
