"""The ten operators against plain versions of themselves, and on odd rows."""

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import chat_format, components, line_dedup, lm_scoring, mixing, near_copies, packing, quality_rules, registry, simhash_dedup, substring_dedup, topk_search, toxicity
from tesserae.llm.common import staged, word_count, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BODY = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, BODY, "en", "a"),
    (2, BODY, "en", "a"),
    (2, BODY, "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (None, "one two three four five six seven eight nine ten", None, "b"),
    (5, " \t\n lead and trail \x0b\x0c\r\n", "de", "c"),
    (6, " ".join(f"w{i % 7000}" for i in range(30_000)), "fr", "c"),
    (7, BODY.replace("word30", "other"), "en", "é"),
    (8, "Überall ÄÖÜ ÉÀ 日本語 <|endoftext|> x<|startoftext|>y it's 3.14 don't", "de", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, in a table of files, with columns that clash with the operators' own names."""
    names = ["id", "fp", "n", "u", "v", "size", "target", "key", "h", "at", "mix", "grp", "component_id", "line", "q_kept_", "sequence_id", "length", "n_chars"]
    return staged(spark.createDataFrame(ODD, SCHEMA).repartition(3, "doc_id").withColumns({n: F.lit(7) for n in names}), "odd")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def split(text):
    return WORD.findall(text or "")


def groups_of(ids, linked):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_words(odd):
    for row in odd.select("text", word_count(F.col("text")).alias("c"), words(F.col("text")).alias("w")).collect():
        assert row["w"] == split(row["text"])
        assert row["c"] == len(row["w"])


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == groups_of({i for p in pairs for i in p}, pairs)
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# 1


def check_mix(rows, weights=(5, 2, 1), most=3.0):
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r["mix_size"] == len(split(r["text"])) and r["mix_taken"] <= most * r["mix_size"]
        sizes[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
        target[r["source"]] = r["mix_target"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while len(held) < len(order):
        share = (total - sum(most * sizes[s] for s in held)) / sum(weight[s] for s in order if s not in held)
        over = {s for s in order if s not in held and weight[s] * share > most * sizes[s]}
        if not over:
            break
        held |= over
    for s in order:
        assert target[s] == pytest.approx(most * sizes[s] if s in held else weight[s] * share)
    return sizes, taken, target


def test_mixing(documents):
    rows = mixing.mix(documents).collect()
    sizes, taken, target = check_mix(rows)
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.02 * sum(sizes.values())
    assert sorted(r["mix_times"] for r in mixing.mix(documents).collect()) == sorted(r["mix_times"] for r in rows)
    assert mixing.repeat_rows(mixing.mix(documents)).count() == sum(r["mix_times"] for r in rows)
    assert mixing.repeat_rows(mixing.mix(documents)).columns == documents.columns


def test_mixing_odd(spark, odd, none):
    check_mix(mixing.mix(odd).collect())
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["mix_target"], r["mix_taken"]) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]
    skewed = spark.createDataFrame([(i, "a b c d", "big") for i in range(50)] + [(99, "a b", "small"), (100, "a", "tiny")], "doc_id long, text string, source string")
    check_mix(mixing.mix(skewed).collect())


# 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    terms = ["scum", "idiot", "worthless", "idiocy"]
    machine = toxicity.Automaton(terms)
    tried = ["idiot", "idiots", "idoit", "1diot", "idot", "wortless", "worthles", "wrthlss", "scum", "scam", "scums", "clean", "", "w", "idiiot", "idio", "orthless", "worthlessly", "widiot"]
    for word in tried:
        exact = any(word.startswith(t) for t in terms)
        near = any(edits(word, t) <= toxicity.errors_allowed(len(t)) for t in terms)
        assert machine.match(word) == (1 if exact else 2 if near else 0), word


def test_quotation_is_set_apart():
    reader = toxicity.Reader(["idiot"])
    abuse, mention = reader.features(b"you are an idiot and so on"), reader.features('he said the word "idiot" is rude'.encode())
    assert abuse[0] > 0 and abuse[2] == 0
    assert mention[0] == 0 and mention[2] > 0


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").where("held_out").collect()
    assert all(zlib.crc32(str(r["id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    found = sum(r["predicted"] for r in rows if r["toxic"]) / max(1, sum(r["toxic"] for r in rows))
    assert right > 0.97 and found > 0.85


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd, labels).count() == len(ODD)
    assert toxicity.score(none, labels).count() == 0
    empty = toxicity.score(odd, labels.limit(0)).collect()
    assert {r["predicted"] for r in empty} == {0} and {r["held_out"] for r in empty if r["id"] is None} == {False}


# 3


def brute_top(rows, every, k):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, np.pad(v, (0, width - len(v)))) for i, v in kept]
    out = []
    for i, v in kept:
        if i % every == 0:
            best = sorted(((-int(v @ w), j) for j, w in kept if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.2 * rng.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2004, [9.0]), (2010, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for blocks in (20_000, 37):
        got = sorted(map(tuple, topk_search.top_k(table, every=10, k=5, group_rows=8, block_rows=blocks, sample_size=64).collect()))
        assert got == brute_top(rows, 10, 5)
    assert topk_search.top_k(table.limit(0)).count() == 0
    assert [r["vec_id"] for r in topk_search.top_k(table.where("vec_id in (0, 7)"), every=10).collect()] == [7]


# 4


def test_chat_order_validation_and_canonical_json(spark):
    calls = spark.createDataFrame(
        [
            (1, "b", 0, "add", '{"y": 2, "x": 1}', ["a"]),
            (1, "a", 1, "add", '{"x": "1", "z": 0}', None),
            (1, "c", 2, "none", "{}", ["b"]),
            (1, "d", 3, "add", "not json", []),
            (2, "p", 0, "add", '{"x":1,"y":{"b":1,"a":[2,1]}}', ["q"]),
            (2, "q", 1, "add", None, ["p"]),
            (2, "p", 5, "add", "{}", None),
            (None, "n", 0, "add", "{}", None),
        ],
        "conv int, call_id string, pos int, tool string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, "a", 9, "late"), (1, "a", 5, "early"), (1, "x", 4, "lost"), (None, "n", 1, "r")], "conv int, call_id string, pos int, content string")
    schemas = chat_format.schema_table(spark, {"add": {"x": "integer", "y": "number"}})
    rows = chat_format.link_calls(calls, results, schemas).collect()
    by = {(r["conv"], r["call_id"], r["status"]): r for r in rows}
    assert [r["call_id"] for r in sorted((r for r in rows if r["conv"] == 1), key=lambda r: r["seq"])] == ["a", "b", "d", "c", "x"] or [r["call_id"] for r in sorted((r for r in rows if r["conv"] == 1), key=lambda r: r["seq"])] == ["a", "d", "b", "c", "x"]
    assert by[1, "a", "linked"]["n_results"] == 2 and json.loads(by[1, "a", "linked"]["json"])["result"] == "early"
    assert by[1, "a", "linked"]["errors"] == ["missing:y", "type:x", "unknown:z"]
    assert by[1, "b", "open"]["errors"] == [] and by[1, "b", "open"]["json"].startswith('{"arguments":{"x":1,"y":2},"id":"b"')
    assert by[1, "c", "open"]["errors"] == ["tool"] and by[1, "d", "open"]["errors"] == ["arguments"]
    assert by[2, "p", "open"]["cyclic"] and by[2, "q", "open"]["cyclic"] and '"y":{"a":[2,1],"b":1}' in by[2, "p", "open"]["json"]
    assert by[1, "x", "orphan"]["errors"] == []
    assert (None, "n", "open") in by and (None, "n", "orphan") in by
    assert chat_format.link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


# 5


def test_likelihood_learns_context(spark):
    rng = np.random.default_rng(1)
    follow = {f"a{i}": f"b{i}" for i in range(40)}
    texts = [(k, " ".join(w for i in rng.integers(0, 40, 120) for w in (f"a{i}", follow[f"a{i}"]))) for k in range(300)]
    texts += [(1000, " ".join(f"a{i} b{(i + 11) % 40}" for i in rng.integers(0, 40, 120))), (1001, None), (1002, ""), (None, "a1 b1"), (1003, "new words only here")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    rows = {r["id"]: r for r in lm_scoring.score(docs, rounds=3, mask_rate=1.0, batch_size=256).collect()}
    plain = {r["id"]: r for r in lm_scoring.score(docs, rounds=0).collect()}
    assert rows[0]["mean"] > plain[0]["mean"] + 0.3
    assert rows[0]["mean"] > rows[1000]["mean"]
    assert (rows[1001]["n_words"], rows[1001]["log_likelihood"], rows[1002]["mean"]) == (0, 0.0, 0.0)
    assert rows[None]["n_words"] == 2 and len(rows) == len(texts)
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_likelihood_trains_on_every_position():
    draws = np.random.default_rng(3).random(10_000)
    met = np.concatenate([lm_scoring.round_positions(draws, k, lm_scoring.MASK_RATE) for k in range(lm_scoring.ROUNDS)])
    assert sorted(met.tolist()) == list(range(len(draws)))


def test_likelihood_of_rare_words(spark, monkeypatch):
    """A word outside the vocabulary scores by its own count, and the words of a bucket leave some for unseen ones."""
    ids = {b"the": 0, b"of": 1}
    counts = spark.createDataFrame([(bytearray(w), n) for w, n in ((b"the", 90), (b"of", 50), (b"rare", 3), (b"rarer", 1))], "word binary, n long")
    monkeypatch.setattr(lm_scoring, "BUCKETS", 1)
    shares = {bytes(r["word"]): r["share"] for r in lm_scoring.bucket_shares(counts, ids).collect()}
    assert shares == {b"rare": pytest.approx(np.log(3 / 5)), b"rarer": pytest.approx(np.log(1 / 5))}
    common = [f"w{i:04d}" for i in range(lm_scoring.VOCABULARY - lm_scoring.BUCKETS)]
    texts = [(0, " ".join(common * 3)), (1, "zebra zebra quagga"), (2, "zebra"), (3, "quagga")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["id"]: r["log_likelihood"] for r in lm_scoring.score(docs, rounds=0).collect()}
    assert rows[2] - rows[3] == pytest.approx(np.log(3 / 2), abs=1e-3)


def test_likelihood_never_sees_the_word_itself():
    net = lm_scoring.Network()
    net.o[:] = np.random.default_rng(0).normal(size=net.o.shape)
    ids = lm_scoring.Words({b"a": 1, b"b": 2, b"c": 70})
    _, (x,) = lm_scoring.document_scores(net, ids, [b"a b"])
    left = np.zeros((1, lm_scoring.SIZE), np.float32)
    _, h = net.hidden(left, net.e[[2]])
    first = net.log_likelihood(h, np.array([1]))[0]
    _, h = net.hidden(net.e[[1]], left)
    assert x == pytest.approx(first + net.log_likelihood(h, np.array([2]))[0], abs=1e-4)


# 6


def brute_removed(texts, length):
    split_ = [split(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + length]) for w in split_ for i in range(len(w) - length + 1))
    out = []
    for w in split_:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 35])
def test_substrings(spark, length):
    rng = np.random.default_rng(length)
    letters = [chr(97 + i) for i in range(3 if length < 10 else 9)]
    share = [" ".join(rng.choice(letters, 60)) for _ in range(4)]
    texts = [" ".join([" ".join(rng.choice(letters, int(rng.integers(0, 40)))), share[int(rng.integers(0, 4))][int(rng.integers(0, 30)) :], " ".join(rng.choice(letters, 30))]) for _ in range(40)]
    texts += ["x " * 100, "x " * 50, "", None, "y " * length, BODY]
    docs = staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "docs")
    got = {r["id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs, length=length, with_text=True).collect()}
    for k, want in enumerate(brute_removed(texts, length)):
        assert got[k] == want


def test_substrings_odd(odd, none):
    rows = substring_dedup.remove_repeats(odd).collect()
    want = sorted(w[:3] for w in brute_removed([r[1] for r in ODD], 35))
    assert sorted(tuple(r)[1:] for r in rows) == want
    assert substring_dedup.remove_repeats(none).count() == 0


# 7


def line_words(line):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", line.lower()) if w]


def brute_lines(rows):
    lines = [(d, u, i, tuple(w)) for u, (d, text) in enumerate(rows) if text is not None for i, x in enumerate(text.split("\n")) if len(w := line_words(x)) >= line_dedup.MIN_WORDS]
    prints = {}
    for *_, w in lines:
        hashes = [xxhash.xxh64_intdigest(a.encode(), 42) for a in set(w)]
        prints[w] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    kinds = sorted(prints)
    linked = []
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            x, y = " ".join(a), " ".join(b)
            most = int(max(len(x), len(y)) * (1 - line_dedup.SIMILARITY) + 1e-9)
            if (prints[a] ^ prints[b]).bit_count() <= line_dedup.DISTANCE and abs(len(x) - len(y)) <= most and edits(x, y) <= most:
                linked.append((a, b))
    group, seen, gone = groups_of(kinds, linked), set(), collections.Counter()
    for d, _u, _i, w in sorted(lines, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        if group[w] in seen:
            gone[d] += 1
        seen.add(group[w])
    return gone


def test_lines(spark):
    base = [" ".join(f"token{(i * 37 + k * 11) % 500}" for i in range(40)) for k in range(6)]
    rows = [(k, "\n".join([base[k % 6], "short line", base[(k + 1) % 6].replace("token7 ", f"token{k} ").upper() if k % 3 else base[(k + 1) % 6] + f" end{k}"])) for k in range(60)]
    rows += [(100, None), (101, ""), (None, base[0]), (102, "| " * 30 + "a"), (103, "| " * 30 + "b c d e f g h i j")]
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "docs").withColumns({"uid": F.lit(1), "line": F.lit(2), "grp": F.lit(3)})
    done = line_dedup.dedup_lines(docs)
    got = collections.Counter({r["doc_id"]: len(r["line_removed"]) for r in done.collect() if r["line_removed"]})
    assert got == brute_lines(rows)
    for r in done.collect():
        text = dict(rows)[r["doc_id"]]
        assert r["text"] == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in r["line_removed"]))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("pairwise", [1, line_dedup.PAIRWISE])
def test_line_recall(spark, pairwise):
    """Nearly all lines that are alike by edits alone are linked, however far apart their fingerprints lie."""
    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    stock = ["".join(rng.choice(letters, int(rng.integers(2, 10)))) for _ in range(3000)]
    pairs = []
    while len(pairs) < 80:
        a = [str(w) for w in rng.choice(stock, int(rng.integers(8, 60)))]
        b = list(a)
        for at in rng.choice(len(a), max(1, len(a) // 15), replace=False):
            b[at] = str(rng.choice(stock))
        x, y = " ".join(a), " ".join(b)
        if a != b and edits(x, y) <= int(max(len(x), len(y)) * (1 - line_dedup.SIMILARITY) + 1e-9):
            pairs.append((x, y))
    rows = [(2 * k + j, text) for k, pair in enumerate(pairs) for j, text in enumerate(pair)]
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "docs")
    group = {r["doc"]: r["grp"] for r in line_dedup.line_groups(docs, pairwise=pairwise).collect()}
    assert sum(group[2 * k] == group[2 * k + 1] for k in range(len(pairs))) >= 0.98 * len(pairs)
    assert len(set(group.values())) >= len(pairs)


def test_short_lines(spark):
    """Equal short lines go but for the first; others of few edits and blank lines stay."""
    rows = [(1, "Read more\n\nPage 1 of 12 here"), (2, "read  MORE\n\nPage 2 of 12 here"), (3, "x\nRead more\n ")]
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == {1: rows[0][1], 2: "\nPage 2 of 12 here", 3: "x\n "}


def test_wide_lines(spark, monkeypatch):
    """Lines of more words than a lane counts have the same fingerprints by another way."""
    rows = spark.createDataFrame([(0, 0, 0, 1, [f"w{i}" for i in range(90)]), (1, 1, 0, 2, [f"w{i}" for i in range(20)])], "uid long, doc long, line int, same long, tokens array<string>")
    want = {r["uid"]: r["fp"] for r in line_dedup.fingerprints(rows).collect()}
    monkeypatch.setattr(line_dedup, "MOST", 32)
    assert {r["uid"]: r["fp"] for r in line_dedup.fingerprints(rows).collect()} == want


# 8


def brute_print(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = split(lowered)
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(documents):
    rows = {r["id"]: r for r in simhash_dedup.simhash_components(documents).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = {i: brute_print(t, 3) for i, t in texts.items()}
    assert {i: r["fp"] % (1 << 64) for i, r in rows.items()} == prints
    ids = sorted(prints)
    want = groups_of(ids, [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {i: r["component_id"] for i, r in rows.items()} == want


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("pairwise", [1, 10**6])
def test_links_are_whole(spark, distance, pairwise):
    """Dense and sparse groups, by pairs and by the linear way."""
    rng = np.random.default_rng(distance)
    prints = {0}
    for _ in range(6):
        centre = int(rng.integers(0, 2**63))
        prints |= {centre ^ sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 5)))) for _ in range(12)}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    linked = [tuple(r) for r in simhash_dedup.links(frame, distance, pairwise).collect()]
    near = [(a, b) for a in signed for b in signed if a > b and ((a ^ b) % (1 << 64)).bit_count() <= distance]
    assert groups_of(signed, linked) == groups_of(signed, near)


def test_thresholds_cover_the_distance():
    sample = np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64)
    for total in (10, 10**6, 10**11):
        chosen = simhash_dedup.allocate(sample, total, 2)
        assert sum(t + 1 for _, t in chosen) == 3
        assert len({b for bits, _ in chosen for b in bits}) == sum(len(bits) for bits, _ in chosen)


def test_simhash_odd(odd, none):
    rows = simhash_dedup.simhash_components(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["id"]: r for r in rows}
    assert by[3]["fp"] == by[4]["fp"] == 0 and by[4]["component_id"] == 3 and by[2]["component_id"] == 1
    assert simhash_dedup.simhash_components(none).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    groups = {r["id"]: r["component"] for r in near_copies.near_copies(docs).collect()}
    owners = collections.defaultdict(list)
    for i, s in sets.items():
        for x in sorted(s)[:: max(1, len(s) // 20)]:
            owners[x].append(i)
    close = {(a, b) for v in owners.values() for a in v for b in v if a < b and jaccard(sets[a], sets[b]) >= 0.83}
    found = sum(groups.get(a, a) == groups.get(b, b) for a, b in close)
    assert len(close) > 50 and found >= 0.75 * len(close)
    members = collections.defaultdict(list)
    for i, c in groups.items():
        members[c].append(i)
    for v in members.values():  # nobody is in a group without a neighbour that is alike
        assert all(max(jaccard(sets[i], sets[j]) for j in v if j != i) > 0.7 for i in v) or len(v) == 1


def test_near_copies_recall_and_precision(spark):
    """Texts in pairs of a similarity of 0.8 or little more are linked, those just under it are not."""
    rng = np.random.default_rng(5)
    rows, want = [], []
    for k in range(150):
        a = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(60, 900)))]
        b = list(a)
        for at in range(7, len(a), int(rng.integers(30, 60))):
            b[at] = f"new{at}"
        j = jaccard(shingles(" ".join(a)), shingles(" ".join(b)))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want.append(j >= 0.8)
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    groups = {r["id"]: r["component"] for r in near_copies.near_copies(docs).collect()}
    found = [groups.get(2 * k, -1) == groups.get(2 * k + 1, -2) for k in range(len(want))]
    assert 20 < sum(want) < 130 and not any(f and not w for f, w in zip(found, want, strict=True))
    assert sum(f and w for f, w in zip(found, want, strict=True)) >= 0.98 * sum(want)


def test_near_copies_odd(odd, none):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 5, 6, 8]
    assert near_copies.keep_one(none).count() == 0


# 9


def brute_counts(text):
    w = split(text)
    n = len(w)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    again = [False] * n
    for i in range(n - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            again[i : i + 8] = [True] * 8
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(again), n < 20 or 100 * sum(again) > 30 * n)


COUNTS = ["q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words", "q_base_failed"]


def test_quality_counts(spark, odd, none):
    texts = ["a b c d e f g h " * 3, "a b c d e f g h", "line\nline\n\nline", "x " * 40, BODY + " " + BODY, "#|<> $$ %%"]
    more = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)
    for frame in (odd, more):
        for r in quality_rules.judge(frame).collect():
            assert tuple(r[c] for c in COUNTS) == brute_counts(r["text"])
            assert not (r["q_kept"] and r["q_base_failed"])
    assert quality_rules.judge(none).count() == 0


def test_quality_fit_is_robust(spark):
    """The estimate is that of a plain fit with the same start, steps and bins; outliers do not move it."""
    rng = np.random.default_rng(2)
    bulk = np.rint(rng.multivariate_normal(np.arange(5) * 50.0, np.diag([400.0, 300, 200, 100, 50]) + 60, 800)).astype(int)
    x = np.vstack([bulk, np.full((150, 5), 4000) + rng.integers(0, 9, (150, 5))])
    frame = staged(spark.createDataFrame([("g", *map(int, r)) for r in x], "q_group string, " + ", ".join(f"{a} long" for a in quality_rules.AXES)), "vectors")
    got = quality_rules.fit(frame).first()
    p, floor = quality_rules.P, np.array(list(quality_rules.AXES.values())) * quality_rules.GRID
    q1, mu, q3 = np.percentile(x, [25, 50, 75], axis=0)
    cov = np.diag(np.maximum((q3 - q1) / 1.349, floor) ** 2)
    c = quality_rules.COVERAGE
    scale = c / quality_rules.chi_square_cdf(quality_rules.chi_square_quantile(c, p), p + 2)
    for _ in range(quality_rules.STEPS):
        d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
        bins = np.floor(np.log1p(d) * quality_rules.BINS_PER_LOG)
        values, n = np.unique(bins, return_counts=True)
        near = x[np.isin(bins, values[np.cumsum(n) - n < c * len(x)])]
        mu, cov = near.mean(axis=0), np.cov(near.T, bias=True) * scale + np.diag(floor**2)
    assert [got[f"mu_{i}"] for i in range(p)] == pytest.approx(mu.tolist())
    assert np.abs(mu - bulk.mean(axis=0)).max() < 10
    factor = np.array([[got[f"l_{i}{j}"] if j <= i else 0.0 for j in range(p)] for i in range(p)])
    assert factor @ factor.T == pytest.approx(cov, rel=1e-6)


def test_chi_square():
    assert quality_rules.chi_square_cdf(2.0, 2) == pytest.approx(1 - math.exp(-1))
    assert quality_rules.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_quality_keeps_good_and_rejects_junk(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs, keep_text=False).join(labels, "doc_id").where("not q_base_failed").select("quality", "q_kept").collect()
    good = [r["q_kept"] for r in rows if r["quality"] == 1]
    junk = [r["q_kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(junk) / len(junk) < 0.2


# 10


def check_pack(rows, texts, capacity=packing.CAPACITY):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(path(packing.VOCABULARY))
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    want = collections.defaultdict(list)
    total = 0
    for doc, text in texts:
        ids = [*code.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            want[doc].append((k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in spans.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(spans), -(-total // capacity)


def test_packing(documents):
    used, least = check_pack(packing.pack_documents(documents).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])
    assert used <= least + 2


def test_packing_odd(odd, none):
    check_pack(packing.pack_documents(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, capacity + 1, 25), rng.integers(1, 40, 25), strict=True)}
    made = packing.plan(counts, capacity)
    placed = collections.Counter()
    for times, lengths in made:
        assert times > 0 and sum(lengths) <= capacity
        for length in lengths:
            placed[length] += times
    assert placed == collections.Counter(counts)


def test_exact_complements_are_used():
    assert sorted(packing.plan({60: 2, 40: 1, 25: 1, 15: 1, 100: 1}, 100)) == [(1, [60, 25, 15]), (1, [60, 40]), (1, [100])]
    assert packing.plan({70: 3, 10: 9}, 100) == [(3, [70, 10, 10, 10])]


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    code = packing.WordTokenizer(packing.VOCABULARY)
    texts = [f"Word{i} other{i}, it's <|ENDOFTEXT|> naïve{i}. <|endoftext|>".encode() for i in range(30)]
    for text in texts:
        want = code.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        assert np.frombuffer(code.encode([text])[0], "<u4").tolist() == want
        assert len(code.words) < 30


# all


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_duckdb(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.SQL[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
