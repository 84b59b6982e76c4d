"""Toxicity scores from a lexicon that is matched with errors and read in context.

A lexicon of word beginnings is learned from labelled documents. Its trie is intersected with Levenshtein automata, made
deterministic as words are met, so that a word is followed through all terms at once and left as soon as none can match.
A term may have an ending of up to ``ENDING`` letters after it, misspelled or not. Words shorter than ``MIN_PREFIX`` are
terms as a whole only. Terms are at most ``MAX_PREFIX`` letters long, as longer words are told by their beginnings.
The window of ``CONTEXT`` words on either side scores how far a hit is a mention, from 0 (abuse) to 1: marks of
quotation on both sides, or on one, and words of reporting before the hit, the nearer the more. Each hit is shared out by
that score between exact or misspelled ones and quoted ones, and a logistic model over the sums gives the score.

Labels of held-out rows, language, source and id are never looked at by a score. At most ``FIT_ROWS`` labelled rows are
fitted, chosen by a hash of their id. Null and empty text has no hits and gets the score of a text without any. Rows
repeat as they do in the input; ids may be null (never held out). With no labels of a kind every score is the share of
toxic rows, 0 if there are none. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tesserae.llm.common import staged, utf8

FIT_ROWS = 20_000
COVERS = 3
MIN_PREFIX, MAX_PREFIX = 4, 14
#: Letters that may follow a misspelled term, and what ends a term that is a whole word.
ENDING = 4
WHOLE = "$"
#: Similarity of three-word shingles from which labelled texts are copies for the fit.
COPIES = 0.5
#: Evidence (in nats, against the base rate) that a beginning needs to become a term.
EVIDENCE = 12.0
CACHE_WORDS = 300_000
CONTEXT = 6
#: How far a word of reporting right before a hit makes it a mention.
REPORTED = 0.75
MARKS = "\"“”„«»‹›"
REPORTING = frozenset("said says quote quoted quotes wrote called word term phrase slur example mot dit wort sagte palabra dijo".split())
EDGES = ".,;:!?()[]{}'’‘`*#$%&|<>-_/\\" + MARKS
FEATURES = 6


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def errors_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


@dataclass
class Automaton:
    """Levenshtein automata of all terms over their trie. States are sets of (node, errors); found lazily, then kept."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    term: list[int] = field(default_factory=lambda: [0])  # length of the term that ends at a node
    room: list[int] = field(default_factory=lambda: [0])  # most errors any term below a node allows
    states: list[frozenset] = field(default_factory=list)
    number: dict[frozenset, int] = field(default_factory=dict)
    moves: dict[tuple[int, str], int] = field(default_factory=dict)
    closes: dict[tuple[int, str], bool] = field(default_factory=dict)  # whether that move reads the last letter of a term, within its errors
    exact: list[bool] = field(default_factory=list)  # whether a term has been read without errors
    near: list[bool] = field(default_factory=list)  # whether the word, ending here, is a term within its errors

    def __init__(self, terms: list[str]):
        self.children, self.term, self.room = [{}], [0], [0]
        self.states, self.number, self.moves, self.closes, self.exact, self.near = [], {}, {}, {}, [], []
        for word in terms:
            node, allowed = 0, errors_allowed(len(word))
            self.room[0] = max(self.room[0], allowed)
            for char in word:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.term.append(0)
                    self.room.append(0)
                node = self.children[node][char]
                self.room[node] = max(self.room[node], allowed)
            self.term[node] = len(word)
        self.dead = self._state(frozenset())
        self.start = self._state(self._close({(0, 0)}))

    def _close(self, items: set[tuple[int, int]]) -> frozenset:
        """With the letters of terms that the word leaves out."""
        todo = list(items)
        while todo:
            node, errors = todo.pop()
            for child in self.children[node].values():
                if errors < self.room[child] and (child, errors + 1) not in items:
                    items.add((child, errors + 1))
                    todo.append((child, errors + 1))
        least: dict[int, int] = {}
        for node, errors in items:
            least[node] = min(errors, least.get(node, errors))
        return frozenset(least.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.number:
            self.number[items] = len(self.states)
            self.states.append(items)
            self.exact.append(any(errors == 0 and self.term[node] for node, errors in items))
            self.near.append(any(self.term[node] and errors <= errors_allowed(self.term[node]) for node, errors in items))
        return self.number[items]

    def step(self, state: int, char: str) -> int:
        key = (state, char)
        if key not in self.moves:
            made: set[tuple[int, int]] = set()
            closes = False
            for node, errors in self.states[state]:
                for letter, child in self.children[node].items():
                    more = errors + (letter != char)
                    if more <= self.room[child]:
                        made.add((child, more))
                        closes |= letter == char and 0 < self.term[child] and more <= errors_allowed(self.term[child])
                if errors < self.room[node]:
                    made.add((node, errors + 1))
            self.moves[key], self.closes[key] = self._state(self._close(made)), closes
        return self.moves[key]

    def match(self, word: str) -> int:
        """1: begins with a term; 2: is or begins with a term but for a few errors, with a short ending at most; 0: neither."""
        state, ended = self.start, -1 - ENDING
        for at, char in enumerate(word):
            before, state = state, self.step(state, char)
            if self.exact[state]:
                return 1
            if self.closes[before, char]:
                ended = at
            if state == self.dead:
                break
        else:
            if self.exact[self.step(state, WHOLE)]:
                return 1
        return 2 if self.near[state] or ended >= 0 and len(word) - 1 - ended <= ENDING else 0


class Reader:
    """Features of texts for one lexicon; the kinds of words are kept, up to a bound of ``CACHE_WORDS``, then found anew."""

    def __init__(self, terms: list[str]):
        self.automaton = Automaton(terms)
        self.kept: dict[str, int] = {}

    def kind(self, word: str) -> int:
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) >= CACHE_WORDS:
                self.kept.clear()
            found = self.kept[word] = self.automaton.match(word.strip(EDGES))
        return found

    def features(self, text: bytes) -> list[float]:
        words = text.decode("utf-8", "replace").lower().split()
        kinds = list(map(self.kept.get, words))
        if None in kinds:
            kinds = list(map(self.kind, words))
        exact = near = quoted = 0.0
        for i in [i for i, x in enumerate(kinds) if x]:
            mention = self.mention(words, i)
            quoted += mention
            if kinds[i] == 1:
                exact += 1 - mention
            else:
                near += 1 - mention
        n = len(words)
        return [math.log1p(exact), math.log1p(near), math.log1p(quoted), min(1.0, exact), min(1.0, near), 10 * exact / (n + 50)]

    @staticmethod
    def mention(words: list[str], i: int) -> float:
        """How far the window shows that the hit is quoted or spoken of, not meant: 0 to 1."""
        before = words[max(0, i - CONTEXT) : i]
        after = words[i + 1 : i + 1 + CONTEXT]
        opens = any(w[0] in MARKS for w in [*before, words[i]])
        closes = any(w.rstrip(".,;:!?")[-1:] in MARKS for w in [words[i], *after] if w.rstrip(".,;:!?"))
        told = max((1 - k / CONTEXT for k, w in enumerate(reversed(before)) if w.strip(EDGES) in REPORTING), default=0.0)
        return 1 - (1 - (opens + closes) / 2) * (1 - REPORTED * told)


def beginnings(words: set[str]) -> set[str]:
    """Of words what could be a term: beginnings, and short words as a whole."""
    return {w[:n] for w in words for n in range(MIN_PREFIX, min(len(w), MAX_PREFIX) + 1)} | {w + WHOLE for w in words if 0 < len(w) < MIN_PREFIX}


def _shingles(text: bytes) -> set[int]:
    w = text.lower().split()
    return set(map(xxh64_intdigest, map(b" ".join, zip(w, w[1:], w[2:], strict=False)))) or {xxh64_intdigest(b" ".join(w))}


def distinct_texts(texts: list[bytes]) -> list[bytes]:
    """Texts that are no copies of one before: under ``COPIES`` of their shingles are shared."""
    kept: list[tuple[bytes, set[int]]] = []
    for text in sorted(texts):
        own = _shingles(text)
        if not any(len(own & other) >= COPIES * len(own | other) for _, other in kept):
            kept.append((text, own))
    return [text for text, _ in kept]


def _distinct(sample: DataFrame) -> DataFrame:
    """Labelled texts with copies of one label counted once; they meet by the smallest hash of three words."""

    def rows(batches):
        for batch in batches:
            keys = [min(_shingles(text)) >> 1 for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *batch.columns], names=["key", "text", "toxic"])

    def one(key, frame):  # the sample's rows at most
        texts = distinct_texts(frame["text"].tolist())
        return pd.DataFrame({"text": texts, "toxic": [key[1]] * len(texts)})

    return sample.mapInArrow(rows, "key long, text binary, toxic boolean").groupBy("key", "toxic").applyInPandas(one, "text binary, toxic boolean")


def prefix_counts(sample: DataFrame) -> DataFrame:
    """``(prefix, pos, neg)``: documents of ``sample(text, toxic)`` that have a word so beginning."""

    def rows(batches):
        for batch in batches:
            pos: dict[str, int] = {}
            neg: dict[str, int] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                into = pos if toxic else neg
                for prefix in beginnings({w.strip(EDGES) for w in text.decode("utf-8", "replace").lower().split()}):
                    into[prefix] = into.get(prefix, 0) + 1
            names = list(pos)  # what no toxic text has can be no term
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[x] for x in names], pa.int64()), pa.array([neg.get(x, 0) for x in names], pa.int64()), pa.array([0] * len(names), pa.int32())], names=["prefix", "pos", "neg", "part"])
            rest = [x for x in neg if x not in pos]
            yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([neg[x] for x in rest], pa.int64()), pa.array([0] * len(rest), pa.int32())], names=["prefix", "pos", "neg", "part"])

    made = sample.select("text", "toxic").mapInArrow(rows, "prefix string, pos long, neg long, part int")
    return made.groupBy("prefix").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_terms(candidates: list[tuple[str, int]], toxic: list[list[int]], total: int) -> list[str]:
    """Beginnings that cover the toxic texts: again and again the one with most evidence on texts not yet covered
    ``COVERS`` times.

    ``candidates``: (beginning, clean texts that have it); ``toxic``: for each toxic text, the candidates it has. Texts
    that share more than their terms so lend nothing to chance words once true terms cover them. Of nested beginnings
    with about the same evidence the longest is taken. It ends where no beginning has enough.
    """
    holders: list[set[int]] = [set() for _ in candidates]
    for text, held in enumerate(toxic):
        for k in held:
            holders[k].add(text)
    names = {prefix: k for k, (prefix, _) in enumerate(candidates)}
    open_ = set(range(len(toxic)))
    left = [COVERS] * len(toxic)
    chosen: list[str] = []
    while open_:
        rate = len(open_) / total

        def evidence(k: int) -> float:
            gain, against = len(holders[k] & open_), candidates[k][1]  # noqa: B023
            if not gain:
                return 0.0
            share = min(gain / (gain + against), 1 - 1e-9)
            return gain * math.log(share / rate) + against * math.log((1 - share) / (1 - rate)) if share > rate else 0.0  # noqa: B023

        best = max(range(len(candidates)), key=lambda k: (evidence(k), candidates[k][0]), default=None)
        if best is None or (most := evidence(best)) < EVIDENCE:
            break
        prefix = candidates[best][0]
        while longer := [x for x in names if len(x) == len(prefix) + 1 and x.startswith(prefix) and evidence(names[x]) >= 0.95 * most]:
            prefix = max(longer, key=lambda x: (evidence(names[x]), x))
        chosen.append(prefix)
        for text in holders[names[prefix]]:
            left[text] -= 1
        open_ = {text for text in open_ if left[text] > 0}
        gone = {k for x, k in names.items() if x.startswith(prefix) or prefix.startswith(x)}
        holders = [set() if k in gone else h & open_ for k, h in enumerate(holders)]
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the constant first, by Newton's method; the constant is not shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    shrink = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Lexicon and weights from labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg((F.max(F.col(label_col)) > 0).alias("toxic"))
    rows = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows).collect()
    if not rows:
        return [], np.zeros(0)
    chosen = spark.createDataFrame([(r["_id"], r["toxic"]) for r in rows], f"_id {labels.schema[id_col].dataType.simpleString()}, toxic boolean")
    # fit_rows pairs at most, so their size is bounded
    sample = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic")
    sample = staged(_distinct(sample), "labelled")
    total, toxic = sample.agg(F.count("*"), F.count_if("toxic")).first()
    if toxic in (0, total):
        return [], np.array([30.0 if toxic else -30.0])
    rate = toxic / total
    n = F.col("pos") + F.col("neg")
    share = F.least(F.col("pos") / n, F.lit(1 - 1e-9))
    evidence = F.col("pos") * F.log(F.greatest(share, F.lit(1e-9)) / rate) + F.col("neg") * F.log((1 - share) / (1 - rate))
    strong = prefix_counts(sample).where((F.col("pos") > rate * n) & (share > 0.6) & (F.col("pos") > 2)).withColumn("evidence", evidence)
    best = strong.orderBy(F.desc("evidence"), "prefix").collect()  # of the sample, as all that follows
    number = {r["prefix"]: k for k, r in enumerate(best)}

    def holds(batches):
        for batch in batches:
            found = [[number[x] for x in beginnings({w.strip(EDGES) for w in t.decode("utf-8", "replace").lower().split()}) if x in number] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["held"])

    held = [r["held"] for r in sample.where("toxic").select("text").mapInArrow(holds, "held array<int>").collect()]  # fit_rows rows at most
    terms = choose_terms([(r["prefix"], r["neg"]) for r in best], held, total)

    def read(batches):
        reader = Reader(terms)
        for batch in batches:
            found = [reader.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    seen = sample.mapInArrow(read, "x array<double>, toxic boolean").collect()  # fit_rows rows of a few numbers at most
    return terms, fit_logistic(np.array([r["x"] for r in seen]).reshape(-1, FEATURES), np.array([r["toxic"] for r in seen], float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``docs``."""
    terms, weights = train(docs, labels, id_col, text_col, label_col, fit_rows)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        reader = Reader(terms)
        w = np.zeros(FEATURES + 1)
        w[: len(weights)] = weights
        if not len(weights):
            w[0] = -30.0
        for batch in batches:
            x = np.array([reader.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            hits = np.round(np.expm1(x[:, :3]), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(pa.array(hits[:, k]) for k in range(3))], names=["id", "score", "predicted", "exact_hits", "near_hits", "quoted_hits"])

    scored = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(rows, f"id {kind}, score double, predicted int, exact_hits double, near_hits double, quoted_hits double")
    return scored.select("id", held_out("id").alias("held_out"), "score", "predicted", "exact_hits", "near_hits", "quoted_hits")
