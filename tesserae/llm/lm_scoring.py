"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the four words on either side, never from itself; the sum of the logarithms of these
conditional probabilities scores the document. The vocabulary is the most frequent words of the whole corpus, other words
fall into hash buckets and add the logarithm of their share of the bucket's counts. The softmax has two levels: 64 classes by frequency, 64 words in each.

The network is trained in numpy where the data lie: in each round every partition predicts a seeded share of positions of
all of its documents, each position in one of the rounds, takes Adagrad steps from the common weights, and returns weights that are averaged by the number of
positions, in groups of bounded size. Which round a position is in goes by its text; how rows are split into partitions
changes the order of steps, and scores a little. So what is gathered grows with the corpus, while the driver sees a few models only.

Null or empty text has no words, score 0 and mean 0. Repeated rows are scored alike and weigh as often in training; ids
may be null or repeat; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import staged, utf8

CLASSES = 64
VOCABULARY = CLASSES * CLASSES
BUCKETS = 256
SIZE = 32
SIDE = 4  # a power of two, see windows
ROUNDS = 2
#: Share of positions that a round trains on; shares of successive rounds follow each other, so that all have their turn.
MASK_RATE = 1 / ROUNDS
RATE = 0.15
BATCH = 2048
SEED = 29
#: Models averaged in one task, and words counted by a worker before it passes counts on.
FAN_IN = 16
COUNTED = 200_000
#: Bytes of text that a worker splits at a time, and whose rare words it holds before it passes scores on.
HELD_BYTES = 1_000_000
#: Positions that are scored at a time.
SCORED = 8192


def tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of ``text.lower().split()`` by first use, the place there of each word, and the number of words of each text."""
    # bytes are taken as they are, whether or not they are UTF-8
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    words = split.flatten().view(pa.binary())
    there = pc.binary_length(words).to_numpy() > 0  # space at either end leaves an empty word
    sizes = np.diff(np.concatenate([[0], there.cumsum()])[split.offsets.to_numpy()])
    coded = words.filter(pa.array(there)).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), sizes


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``(word, n)`` over all documents; workers add up before the shuffle."""

    def rows(batches):
        counts: Counter = Counter()

        def made():
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        from tesserae.llm.packing import chunks

        for batch in batches:
            for run in chunks(batch.column(0).to_pylist(), HELD_BYTES):
                words, codes, _ = tokens(run)
                counts.update(dict(zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True)))
                if len(counts) > COUNTED:
                    yield made()
                    counts.clear()
        yield made()

    return docs.select(utf8(text_col).alias("text")).mapInArrow(rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Network:
    """Weights and their gradients' squares."""

    NAMES = ("e", "a", "b", "c", "cb", "o", "ob")

    def __init__(self, flat: np.ndarray | None = None):
        shapes = {"e": (VOCABULARY + 1, SIZE), "a": (2 * SIZE, SIZE), "b": (SIZE,), "c": (SIZE, CLASSES), "cb": (CLASSES,), "o": (CLASSES, SIZE, CLASSES), "ob": (CLASSES, CLASSES)}
        if flat is None:
            rng = np.random.default_rng(SEED)
            parts = {"e": rng.normal(0, 0.1, shapes["e"]), "a": rng.normal(0, SIZE**-0.5, shapes["a"])}
            flat = np.concatenate([np.ravel(parts.get(n, np.zeros(shapes[n]))) for n in self.NAMES]).astype(np.float32)
        self.flat, at = flat.copy(), 0
        for n in self.NAMES:
            size = int(np.prod(shapes[n]))
            setattr(self, n, self.flat[at : at + size].reshape(shapes[n]))
            at += size
        self.e[VOCABULARY] = 0
        self.squares = {n: np.full(shapes[n] if n not in ("e",) else (VOCABULARY + 1, 1), 1e-2, np.float32) for n in self.NAMES}

    def start_from(self, counts: np.ndarray) -> None:
        """Constants of the output set to the frequencies."""
        by_class = counts.reshape(CLASSES, CLASSES) + 1.0
        self.cb[:] = np.log(by_class.sum(axis=1) / by_class.sum())
        self.ob[:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))

    def hidden(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.hstack([left, right])
        return x, np.tanh(x @ self.a + self.b)

    def log_likelihood(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log p of each word given its hidden row."""
        # hidden values lie within 1, so weights bound the logits; below that bound no maximum need be taken out
        if not hasattr(self, "calm"):
            self.calm = bool(max((np.abs(self.c).sum(axis=0) + np.abs(self.cb)).max(), (np.abs(self.o).sum(axis=1) + np.abs(self.ob)).max()) < CALM)
        order = np.argsort((words // CLASSES).astype(np.int16), kind="stable")
        h, cls, inside = h[order], words[order] // CLASSES, words[order] % CLASSES
        out = np.empty(len(words))
        out[order] = _log_softmax_at(h @ self.c + self.cb, cls, self.calm) + _log_softmax_at(self.within(h, cls), inside, self.calm)
        return out

    def within(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Logits of the words of each row's class; rows are in the order of classes."""
        out = np.empty((len(h), CLASSES), np.float32)
        for k, rows in _runs(cls):
            np.matmul(h[rows], self.o[k], out=out[rows])
            out[rows] += self.ob[k]
        return out

    def step(self, line: np.ndarray, at: np.ndarray) -> None:
        """One Adagrad step on places ``at`` of a line of ids, each with ``SIDE`` places on either side; the pad id has a zero row."""
        n = len(at)
        at = at[np.argsort((line[at] // CLASSES).astype(np.int16), kind="stable")]
        cls, inside = line[at] // CLASSES, line[at] % CLASSES
        left, right = at - SIDE, at + 1  # windows on either side
        there = np.maximum(1, windows((line != VOCABULARY).astype(np.float32)))[:, None]
        around = windows(self.e.take(line, axis=0)) / there
        x, h = self.hidden(around.take(left, axis=0), around.take(right, axis=0))
        d = _softmax(h @ self.c + self.cb)
        d[np.arange(n), cls] -= 1
        d /= n
        dh = d @ self.c.T
        grads = {"c": h.T @ d, "cb": np.ones(n, np.float32) @ d}
        d = _softmax(self.within(h, cls))
        d[np.arange(n), inside] -= 1
        d /= n
        seen = list(_runs(cls))
        here = [k for k, _ in seen]
        o = np.empty((len(seen), SIZE, CLASSES), np.float32)
        for j, (k, rows) in enumerate(seen):
            np.matmul(h[rows].T, d[rows], out=o[j])
            dh[rows] += d[rows] @ self.o[k].T
        every = slice(None) if len(here) == CLASSES else here
        self._move("o", o, every)
        self._move("ob", np.add.reduceat(d, [rows.start for _, rows in seen]), every)
        dz = dh * (1 - h * h)
        grads |= {"a": x.T @ dz, "b": dz.sum(axis=0)}
        dx = dz @ self.a.T
        for name, grad in grads.items():
            self._move(name, grad, slice(None))
        # each window's share goes to the places it has, which are windows again
        spread = np.zeros((len(line) + SIDE - 1, SIZE), np.float32)
        spread[left + SIDE - 1] += dx[:, :SIZE] / there[left]
        spread[right + SIDE - 1] += dx[:, SIZE:] / there[right]
        places = (line[:, None] * np.int64(SIZE) + np.arange(SIZE)).ravel()
        ids = np.flatnonzero(np.bincount(line))
        total = np.bincount(places, windows(spread).ravel()).reshape(-1, SIZE)[ids].astype(np.float32)
        self.squares["e"][ids] += (total**2).mean(axis=1, keepdims=True)
        self.e[ids] -= RATE * total / np.sqrt(self.squares["e"][ids])
        self.e[VOCABULARY] = 0

    def _move(self, name: str, grad: np.ndarray, at) -> None:
        squares = self.squares[name]
        squares[at] += grad**2
        getattr(self, name)[at] -= RATE * grad / np.sqrt(squares[at])


#: Logits within this can be exponentiated as they are.
CALM = 80


def windows(rows: np.ndarray) -> np.ndarray:
    """Row k is the sum of rows k to k + SIDE - 1."""
    width = 1
    while width < SIDE:
        rows = rows[:-width] + rows[width:]
        width *= 2
    return rows


def _runs(cls: np.ndarray):
    """Classes that rows have, in order, and where their rows are."""
    stops = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    return ((k, slice(stops[k], stops[k + 1])) for k in range(CLASSES) if stops[k] < stops[k + 1])


def _softmax(x: np.ndarray) -> np.ndarray:
    if max(x.max(), -x.min()) > CALM:
        x = x - x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray, calm: bool = False) -> np.ndarray:
    if not calm:
        x = x - x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return (own - np.log(x @ np.ones(x.shape[1], x.dtype))).astype(np.float64)


class Words(dict):
    """Ids of words; those that are not in the vocabulary fall into buckets by their hash."""

    def of(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))
        (rare,) = np.nonzero(found < 0)
        found[rare] = np.fromiter(map(crc32, map(words.__getitem__, rare.tolist())), np.int64, len(rare)) % BUCKETS + (VOCABULARY - BUCKETS)
        return found


def padded_line(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of texts in one line, parted by pads so that every word has all places on either side; where words are."""
    at = np.arange(len(words)) + SIDE * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    line = np.full(len(words) + SIDE * (len(sizes) + 1), VOCABULARY, np.int32)
    line[at] = words
    return line, at


def round_positions(draws: np.ndarray, round_: int, mask_rate: float) -> np.ndarray:
    """Positions that a round trains on, by a draw from [0, 1) for each that is the same in all rounds."""
    return np.flatnonzero((draws - round_ * mask_rate) % 1.0 < mask_rate)


def _cut(line: np.ndarray, at: np.ndarray, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What lies around places of a line, up to ``stop`` if given, and where they are there."""
    if not len(at):
        return line[:0], at
    start = at[0] - SIDE
    return line[start : at[-1] + SIDE + 1 if stop is None else stop], at - start


def _train(docs: DataFrame, text_col: str, ids: dict[bytes, int], flat: np.ndarray, round_: int, mask_rate: float, batch_size: int) -> np.ndarray:
    """The average of what all partitions make of the common weights."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast((ids, flat))  # a fixed number of words and weights

    def rows(batches):
        from pyspark import TaskContext

        from tesserae.llm.packing import chunks

        part = TaskContext.get().partitionId()
        known, flat = common.value
        known = Words(known)
        net, seen = Network(flat), 0
        line, at = np.empty(0, np.int32), np.empty(0, np.int64)
        for batch in batches:
            for run in chunks(batch.column(0).to_pylist(), HELD_BYTES):
                words, codes, sizes = tokens(run)
                more, places = padded_line(known.of(words)[codes], sizes)
                draws = [np.random.default_rng((SEED, crc32(text))).random(size) for text, size in zip(run, sizes, strict=True)]
                places = places[round_positions(np.concatenate(draws), round_, mask_rate)]
                line, at = np.concatenate([line, more]), np.concatenate([at, len(line) + places])
                done = len(at) // batch_size * batch_size
                for k in range(0, done, batch_size):
                    net.step(*_cut(line, at[k : k + batch_size]))
                seen += done
                line, at = _cut(line, at[done:], len(line))
        if len(at):
            net.step(line, at)
            seen += len(at)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([net.flat.tobytes()], pa.binary())], names=["part", "seen", "model"])

    def average(frame: pd.DataFrame) -> pd.DataFrame:
        weight = frame["seen"].to_numpy(float)
        total = sum(np.frombuffer(m, np.float32) * np.float32(w / weight.sum()) for m, w in zip(frame["model"], weight, strict=True))
        return pd.DataFrame({"part": [int(frame["part"].min()) // FAN_IN], "seen": [int(weight.sum())], "model": [total.astype(np.float32).tobytes()]})

    models = staged(docs.select(utf8(text_col).alias("text")).mapInArrow(rows, "part long, seen long, model binary"), "models")
    while models.count() > FAN_IN:
        models = staged(models.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInPandas(average, "part long, seen long, model binary"), "models")
    last = models.toPandas()  # FAN_IN models at most
    return flat if last.empty else np.frombuffer(average(last)["model"][0], np.float32)


def bucket_shares(counts: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """``(word, share)``: log p(word | bucket) of words outside the vocabulary; in each bucket one count is for unseen words."""
    known = counts.sparkSession.createDataFrame([(bytearray(w),) for w in ids], "word binary")
    rare = counts.join(F.broadcast(known), "word", "left_anti").withColumn("bucket", F.crc32("word") % BUCKETS)
    sums = rare.groupBy("bucket").agg(F.sum("n").alias("all"))  # a row for each bucket
    return rare.join(F.broadcast(sums), "bucket").select("word", F.ln(F.col("n") / (F.col("all") + 1)).alias("share"))


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, mask_rate: float = MASK_RATE, batch_size: int = BATCH, counts: DataFrame | None = None) -> tuple[dict[bytes, int], np.ndarray]:
    """Vocabulary and weights from the whole corpus."""
    counts = staged(word_counts(docs, text_col), "counts") if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - BUCKETS).collect()
    ids = {bytes(r["word"]): k for k, r in enumerate(top)}
    seen = np.zeros(VOCABULARY)
    seen[: len(top)] = [r["n"] for r in top]
    total = counts.agg(F.sum("n")).first()[0] or 0
    seen[VOCABULARY - BUCKETS :] = (total - seen.sum()) / BUCKETS
    net = Network()
    net.start_from(seen)
    flat = net.flat
    for k in range(rounds):
        flat = _train(docs, text_col, ids, flat, k, mask_rate, batch_size)
    return ids, flat


def _totals(net: Network, words: np.ndarray, sizes: np.ndarray) -> list[float]:
    """Summed conditional log-probabilities of every text, of ids of words."""
    line, at = padded_line(words, sizes)
    each = [np.zeros(1)]
    for k in range(0, len(at), SCORED):
        part, here = _cut(line, at[k : k + SCORED])
        around = windows(net.e.take(part, axis=0)) / np.maximum(1, windows((part != VOCABULARY).astype(np.float32)))[:, None]
        _, h = net.hidden(around.take(here - SIDE, axis=0), around.take(here + 1, axis=0))
        each.append(net.log_likelihood(h, part[here]))
    sums = np.concatenate(each).cumsum()
    ends = np.cumsum(sizes)
    return (sums[ends] - sums[ends - sizes]).tolist()


def document_scores(net: Network, ids: Words, texts: list[bytes]) -> tuple[list[int], list[float]]:
    """Words and summed conditional log-probabilities of every text."""
    words, codes, sizes = tokens(texts)
    return sizes.tolist(), _totals(net, ids.of(words)[codes], sizes)


def scored(batch: pa.RecordBatch, net: Network, top: dict[bytes, int], known: Words, limit: int = HELD_BYTES):
    """``(id, n_words, total, rare)`` of ``(id, text)``, with the counts of words outside ``top``; ``limit`` bytes of text at a time."""
    from tesserae.llm.packing import chunks

    kind = pa.struct([("word", pa.binary()), ("k", pa.int64())])
    at = 0
    for part in chunks(batch.column(1).to_pylist(), limit):
        words, codes, sizes = tokens(part)
        total = _totals(net, known.of(words)[codes], sizes)
        rare = np.array([word not in top for word in words], bool)[codes]
        # a number for each word of each text, in the order of texts and then of first use
        pairs, k = np.unique((np.repeat(np.arange(len(part)), sizes) * len(words) + codes)[rare], return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(part) + 1) * len(words))
        counts = pa.StructArray.from_arrays([pa.array(words, pa.binary()).take(pa.array(pairs % max(1, len(words)))), pa.array(k, pa.int64())], fields=list(kind))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(sizes, pa.int64()), pa.array(total, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counts)], names=["id", "n_words", "total", "rare"])
        at += len(part)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, mask_rate: float = MASK_RATE, batch_size: int = BATCH) -> DataFrame:
    """``(id, n_words, log_likelihood, mean)`` of every document."""
    counts = staged(word_counts(docs, text_col), "counts")
    ids, flat = fit(docs, text_col, rounds, mask_rate, batch_size, counts)
    common = docs.sparkSession.sparkContext.broadcast((ids, flat))
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        known, flat = common.value
        top, known, net = known, Words(known), Network(flat)
        for batch in batches:
            yield from scored(batch, net, top, known)

    made = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(rows, f"id {kind}, n_words long, total double, rare array<struct<word: binary, k: long>>")
    # rows are told apart by a number that is written with them, as ids may repeat
    parts = staged(made.withColumn("uid", F.monotonically_increasing_id()), "scored")
    each = parts.select("uid", F.inline("rare")).hint("merge").join(bucket_shares(counts, ids), "word")
    within = each.groupBy("uid").agg(F.sum(F.col("k") * F.col("share")).alias("within"))
    both = parts.drop("rare").hint("merge").join(within, "uid", "left").withColumn("log_likelihood", F.col("total") + F.coalesce("within", F.lit(0.0)))
    return both.select("id", "n_words", "log_likelihood", (F.col("log_likelihood") / F.greatest("n_words", F.lit(1))).alias("mean"))
