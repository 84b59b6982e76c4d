"""Recall, stable row keys, clashing columns and other promises of the operators."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat_format, common, line_dedup, mixing, near_copies, quality_rules, substring_dedup, topk_search, toxicity
from tesserae.llm.common import staged
from test_operators import BODY, brute_removed, brute_top, edits, line_words


@pytest.fixture(scope="module")
def many_files(spark, sf):
    return staged(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(24), "files")


def _under(spark, parallelism, make):
    """A result, each of whose scans is split as if there were other executors."""
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", parallelism)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 20 if parallelism > 3 else 4 << 20)
    try:
        return make()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_keep_their_keys(spark, many_files):
    one, other = (_under(spark, n, lambda: {r["doc_id"]: tuple(r["uid"]) for r in common.keyed(many_files, "uid").collect()}) for n in (2, 40))
    assert one == other and len(set(one.values())) == len(one)
    made = many_files.groupBy("doc_id").agg(F.first("text").alias("text"))
    keyed = common.keyed(made, "uid")
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, keyed.collect()))


@pytest.mark.parametrize("splits", [2, 40])
def test_substrings_under_other_splits(spark, many_files, splits):
    rows = [(r["doc_id"], r["text"]) for r in many_files.orderBy("doc_id").collect()]
    want = {i: w[:2] for (i, _), w in zip(rows, brute_removed([t for _, t in rows], 35), strict=True)}
    made = substring_dedup.remove_repeats(many_files)
    got = _under(spark, splits, lambda: {r["id"]: (r["n_words"], r["n_removed"]) for r in made.collect()})
    assert got == want


def test_lines_under_other_splits(spark, many_files):
    made = line_dedup.dedup_lines(many_files)
    texts = {r["doc_id"]: r["text"] for r in many_files.collect()}
    got = [_under(spark, n, lambda: {r["doc_id"]: (r["text"], tuple(r["line_removed"])) for r in made.collect()}) for n in (2, 40)]
    assert got[0] == got[1]
    for i, (left, gone) in got[0].items():
        assert left == (None if texts[i] is None else "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone))


def test_line_recall_on_documents(spark, sf):
    """Of all pairs of long lines of edit similarity 0.9 that share three words in a row, nine in ten and more are in one group."""
    docs = staged(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text"), "docs")
    groups, kinds = {}, {}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in line_dedup.line_groups(docs).collect():
        w = tuple(line_words(rows[r["doc"]].split("\n")[r["line"]]))
        if line_dedup.FUZZY_WORDS <= len(w) <= 60:
            groups[w] = r["grp"]
            kinds[w] = " ".join(w)
    owners = collections.defaultdict(set)
    for w in kinds:
        for i in range(len(w) - 2):
            owners[w[i : i + 3]].add(w)
    pairs = {tuple(sorted((a, b))) for v in owners.values() if len(v) <= 12 for a in v for b in v if a != b}
    close = []
    for a, b in pairs:
        x, y = kinds[a], kinds[b]
        most = int(max(len(x), len(y)) * (1 - line_dedup.SIMILARITY) + 1e-9)
        if abs(len(x) - len(y)) <= most and len(set(a) & set(b)) >= 0.4 * len(set(a) | set(b)) and edits(x, y) <= most:
            close.append((a, b))
    assert len(close) > 20 and sum(groups[a] == groups[b] for a, b in close) >= 0.95 * len(close)


def test_near_copies_recall_on_documents(spark, sf):
    """Of all pairs of documents at 0.8 or more, nearly all are in one group."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    owners = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    shared = collections.Counter((a, b) for v in owners.values() if len(v) < 60 for k, a in enumerate(v) for b in v[:k])
    close = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    groups = {r["id"]: r["component"] for r in near_copies.near_copies(docs).collect()}
    assert len(close) > 40 and sum(groups.get(a, -a) == groups.get(b, -b) for a, b in close) >= 0.97 * len(close)


def test_near_copies_in_one_large_group(spark):
    """Copies of one text that each differ from it a little, and from each other by more than the limit, all go but one."""
    rng = np.random.default_rng(4)
    base = [f"word{x}" for x in rng.integers(0, 10**6, 150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 200):
        own = list(base)
        for at in rng.choice(150, 3, replace=False):
            own[at] = f"own{k}x{at}"
        rows.append((k, " ".join(own)))
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "docs")
    for pairwise in (4, 64):
        assert near_copies.keep_one(docs, pairwise=pairwise).count() <= 4


def test_misspelled_inflections():
    machine = toxicity.Automaton(["idiot", "worthless", "ass" + toxicity.WHOLE])
    for word in ("idi0ts", "idiiots", "ldiots", "w0rthlessly", "idiotic", "1diotic", "idiot", "wortless"):
        assert machine.match(word), word
    assert machine.match("ass") == 1
    for word in ("idea", "weightless", "radiography", "assume", "as", "idyllically"):
        assert not machine.match(word), word


def test_mention_is_scored():
    reader = toxicity.Reader(["idiot"])
    quoted, told, far, meant = (reader.features(t.encode())[2] for t in ('the "idiot" of it', "they used the word idiot in it", "the word he used for me was idiot", "you idiot"))
    assert quoted > told > far > meant == 0


def test_only_copies_count_once():
    texts = [f"{BODY} end{k}".encode() for k in range(5)] + [b"word0 word1 word2 and then " + b" ".join(f"z{k}{i}".encode() for i in range(50)) for k in range(4)]
    assert len(toxicity.distinct_texts(texts)) == 5


def test_top_k_with_repeated_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 90, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for cells, blocks, group in ((4, 7, 3), (64, 20_000, 2048)):
        got = sorted(map(tuple, topk_search.top_k(table, every=10, cell_rows=cells, block_rows=blocks, group_rows=group, sample_size=32, asking_rows=cells).collect()))
        assert got == brute_top(rows, 10, 5)


def test_top_k_prunes():
    pivots = np.array([[100, 0], [0, 100], [-100, 0]])
    pairs = topk_search.reaching(pivots, np.array([5.0, 5.0, -1.0]), np.array([9000.0, 9000.0, 0.0]), pivots, np.array([5.0, 5.0, 5.0]))
    first, blocks, count = topk_search.laid_out([3, 4, 25, 1, 0, 9, 2], 10)
    assert (first.tolist(), blocks.tolist(), count) == ([0, 0, 1, 4, 4, 4, 5], [1, 1, 3, 1, 1, 1, 1], 6)
    assert pairs.tolist() == [[True, False, False], [False, True, False], [False, False, False]]


def test_orphans_without_ids_stay_apart(spark):
    calls = spark.createDataFrame([], "conv int, call_id string, pos int, tool string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, None, 0, "first"), (1, None, 1, "second"), (None, "a", 2, None), (None, "a", 3, "x" * 100_000)], "conv int, call_id string, pos int, content string").withColumn("extra", F.lit(1))
    rows = chat_format.link_calls(calls, results, chat_format.schema_table(spark, {"t": {"a": "string"}})).collect()
    assert len(rows) == 4 and {r["status"] for r in rows} == {"orphan"} and len({r["json"] for r in rows}) == 4


def test_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = ["g", "k_lang", "k_g", "mu_0", "l_00", "n", "q_row", "q_own", "uid", "slot", "line_row", "copy_row", "mix_source", "mix_cut", "grp", "fp", "key", "_uid", "line_count", "q_kept"]
    wide = staged(docs.withColumns({n: F.lit(7) for n in names}), "wide")
    assert quality_rules.judge(wide).where("g = 7 and mu_0 = 7").count() == 60
    assert line_dedup.dedup_lines(wide).where("slot = 7 and line_row = 7").count() == 60
    assert mixing.mix(wide).where("grp = 7").count() == 60
    assert near_copies.keep_one(wide).where("copy_row = 7").count() > 0
    assert substring_dedup.remove_repeats(wide).count() == 60


def test_small_groups_are_drawn_to_their_language(spark):
    """A source of a few rows is judged by its language's estimate, and junk in it does not make its own."""
    rng = np.random.default_rng(6)
    plain = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 120)), "en", "big" if i < 600 else f"small{i % 20}") for i in range(660)]
    junk = [(1000 + i, " ".join("####" if k % 2 else f"w{k}" for k in range(120)), "en", "small3") for i in range(3)]
    docs = spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["q_kept"] for r in quality_rules.judge(docs).collect()}
    assert not any(kept[i] for i, *_ in junk)
    assert sum(kept[i] for i, *_ in plain) >= 0.99 * len(plain)
