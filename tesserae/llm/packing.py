"""Tokenizing whole documents and packing them into sequences by exact complements, then best fit.

The packing plan needs only how many pieces each length has, so it is made on at most ``capacity`` counts. It indexes
single, pair and triple length sums: a piece that opens a sequence is completed by one, two or three pieces that fill
the gap exactly, as often as the counts allow; what is left goes to the tightest open gap, longest first. Pieces are
then numbered within their length (salted, so that a length that many share is spread) and take the places of the plan.

Null text counts as empty and gives the end token alone. Repeated rows are packed as often as they appear; ids may be
null or repeat. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import staged, utf8

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = (0).to_bytes(4, "little")
#: Words kept with their ids in a Python worker, and bytes of text split at a time: memory stays bounded.
CACHE_WORDS = 500_000
CHUNK_BYTES = 2_000_000
#: A word whose letters and closing marks the vocabulary's pattern always takes apart.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?:;#*$%&|]*)")


class WordTokenizer:
    """Ids of texts for a vocabulary that never joins across white space, so that words can be cached."""

    def __init__(self, vocabulary: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        # for runs of lower-case letters the pattern and the normalizer do nothing that white space does not
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        # two generations: when the young one is full it becomes the old one, and words still met move up again
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, stems: list[str]) -> dict[str, bytes]:
        """Ids of runs of letters: each ends with a token that ends a word, so one call does many."""
        found: dict[str, bytes] = {}
        for at in range(0, len(stems), 2000):
            some = stems[at : at + 2000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(some):
                found.update(zip(some, self._encode(some), strict=True))
                continue
            raw = ids.tobytes()
            found.update((stem, raw[4 * a : 4 * b]) for stem, a, b in zip(some, [0, *stops[:-1]], stops, strict=True))
        return found

    def learn(self, missing: list[bytes]) -> None:
        plain, odd = [], []
        stems: dict[str, bytes | None] = {}
        match = PLAIN.fullmatch
        for word in missing:
            if (ids := self.old.get(word)) is not None:
                self.words[word] = ids
                continue
            text = word.decode("utf-8", "replace")
            if found := match(text):
                stem = found[1].lower()
                plain.append((word, stem, found[2]))
                if stem not in stems:
                    key = stem.encode()
                    stems[stem] = self.words.get(key) or self.old.get(key)
            else:
                odd.append((word, text))
        stems |= self._letters([stem for stem, ids in stems.items() if ids is None])
        tails = list({tail for _, _, tail in plain} - self.tails.keys())
        self.tails.update(zip(tails, self._encode(tails), strict=True))
        self.words.update((word, stems[stem] + self.tails[tail]) for word, stem, tail in plain)
        self.words.update(zip([w for w, _ in odd], self._encode([t for _, t in odd]), strict=True))
        if len(self.tails) > 10_000:
            self.tails = {"": b""}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        # ASCII letters may be lowered at once, but not in what could name a special token
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        if len(self.words) > CACHE_WORDS:
            self.old, self.words = self.words, {}
        known = self.words.__contains__
        missing = {word for words in split for word in filterfalse(known, words)}
        self.learn(list(missing))
        ids = self.words.__getitem__
        return [b"".join(map(ids, words)) for words in split]


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str) -> WordTokenizer:
    return WordTokenizer(vocabulary)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """Runs of texts of about ``limit`` bytes."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` and, if asked for, the ids: documents closed by id 0, cut only where longer."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids

    def rows(batches):
        code = tokenizer(vocabulary)
        for batch in batches:
            owner, piece, start, length, crc, held = [], [], [], [], [], []
            at = 0
            for run in chunks(batch.column(1).to_pylist()):
                for ids in code.encode(run):
                    ids += END
                    for k in range(0, len(ids), 4 * capacity):
                        part = ids[k : k + 4 * capacity]
                        owner.append(at)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            held.append(part)
                    at += 1
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(held, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(rows, schema)


class Complements:
    """Single, pair and triple sums of the lengths still to be had."""

    def __init__(self, counts: np.ndarray):
        self.left = counts
        self.no_pair: set[int] = set()
        self.no_triple: set[int] = set()

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        if gap < 2 or gap in self.no_pair:
            return None
        low = np.arange(1, gap // 2 + 1)
        have = (self.left[low] > 0) & (self.left[gap - low] > 0) & ((low * 2 != gap) | (self.left[low] > 1))
        if not have.any():
            self.no_pair.add(gap)
            return None
        a = int(low[have.argmax()])
        return (gap - a, a)

    def triple(self, gap: int) -> tuple[int, ...] | None:
        if gap < 3 or gap in self.no_triple:
            return None
        for a in (np.flatnonzero(self.left[: gap - 1] > 0)[::-1]).tolist():
            if found := self.pair(gap - a):
                need = Counter((a, *found))
                if all(self.left[k] >= n for k, n in need.items()):
                    return (a, *found)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Sequences to be made, as (how many, lengths in order); every piece counted in ``counts`` has a place."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made: list[tuple[int, list[int]]] = []

    def take(lengths: tuple[int, ...]) -> bool:
        need = Counter(lengths)
        times = min(int(left[k]) // n for k, n in need.items())
        if times < 1:
            return False
        for k, n in need.items():
            left[k] -= n * times
        made.append((times, list(lengths)))
        return True

    if left[capacity]:
        take((capacity,))
    index = Complements(left)
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        for find in (index.single, index.pair, index.triple):
            while left[length] > 0 and (found := find(gap)) and take((length, *found)):
                pass
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    gaps = np.zeros(capacity + 1, bool)

    def put(times: int, lengths: list[int]) -> None:
        gap = capacity - sum(lengths)
        open_.setdefault(gap, []).append((times, lengths))
        gaps[gap] = True

    for length in range(capacity, 0, -1):
        while left[length] > 0:
            n = int(left[length])
            if gaps[length:].any():
                gap = length + int(gaps[length:].argmax())
                times, lengths = open_[gap].pop()
                used = min(times, n)
                if times > used:
                    open_[gap].append((times - used, lengths))
                gaps[gap] = bool(open_[gap])
                put(used, [*lengths, length])
                left[length] -= used
            else:
                fit = capacity // length
                full, rest = divmod(n, fit)
                if full:
                    put(full, [length] * fit)
                if rest:
                    put(1, [length] * rest)
                left[length] = 0
    return made + [x for runs in open_.values() for x in runs]


def places(made: list[tuple[int, list[int]]], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of ranks within a length: (length << 40 | first rank), first sequence, offset; sorted."""
    taken: Counter = Counter()
    keys, sequences, offsets = [], [], []
    first = 0
    for times, lengths in made:
        offset = 0
        for length in lengths:
            keys.append(length << 40 | taken[length])
            sequences.append(first)
            offsets.append(offset)
            taken[length] += times
            offset += length
        first += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(sequences, np.int64)[order], np.array(offsets, np.int64)[order]


def pack(parts: DataFrame, capacity: int = CAPACITY, per_salt: int = 4000) -> DataFrame:
    """``parts`` (of ``pieces``) with ``sequence_id`` and ``offset``. ``parts`` is read twice, so pass a written table."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    salts = max(1, -(-sum(counts.values()) // per_salt))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(inside).cast("long") - 1).join(sizes, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_first", "_salt")
    shared = parts.sparkSession.sparkContext.broadcast(places(plan(counts, capacity), capacity))  # bounded by the plan: some runs for each length

    def rows(batches):
        keys, sequences, offsets = shared.value
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            length = batch.column(at["length"]).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(at["_rank"]).to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            sequence = sequences[k] + rank - (keys[k] & ((1 << 40) - 1))
            kept = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in kept), pa.array(sequence), pa.array(offsets[k])], names=[*kept, "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(rows, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places."""
    parts = staged(pieces(docs, id_col, text_col, vocabulary, capacity), "pieces")
    return pack(parts, capacity).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
