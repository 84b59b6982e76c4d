"""Scalar functions on maps, time, text and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP_WORDS = (
    "the", "and", "is", "in", "to", "for", "with", "on", "of", "a", "an", "this",
    "that", "you", "it", "not", "are", "be", "will", "can", "have", "has", "had",
    "was", "were", "they", "them", "their", "we", "our", "us", "i", "me", "my",
)
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Units from coarse to fine, as ``date_trunc`` names them.
PRECISIONS = ("year", "month", "day", "hour", "minute", "second", "millisecond", "microsecond")


def merge_maps(old: Column, new: Column) -> Column:
    """Map merge; the later value of a key stays. Null counts as empty."""
    kind = "map<string,string>"
    old, new = (F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).cast(kind) for m in (old, new))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def without_keys(content: Column, keys: Column) -> Column:
    return F.map_filter(content, lambda k, v: ~F.array_contains(keys, k))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def seconds(ts: Column) -> Column:
    """Epoch seconds of a time without zone."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def seconds_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1e6)


def precedes(a: Column, b: Column) -> Column:
    return a < b


def equal_at(a: Column, b: Column, precision_a: str, precision_b: str) -> Column:
    """Equality at the coarser of two precisions."""
    unit = PRECISIONS[min(PRECISIONS.index(precision_a), PRECISIONS.index(precision_b))]
    return F.date_trunc(unit, a) == F.date_trunc(unit, b)


def bucket(t: Column, size: float) -> Column:
    return F.floor(t / F.lit(float(size))).cast("long")


def topic_probability(distance: Column, degree: Column, max_degree: Column, mean_gap: Column, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2) -> Column:
    """Weighted sum of nearness to the centre, share of the largest degree and speed of change, within [0, 1]."""
    related = F.coalesce(degree / F.nullif(max_degree, F.lit(0)), F.lit(0.0))
    speed = F.coalesce(1.0 / (1.0 + mean_gap), F.lit(0.0))
    return clamp(alpha / (1.0 + distance) + beta * related + gamma * speed)


def window_score(t: Column, start: float, end: float, recency: Column, weight: float = 0.7, horizon: float = 30 * 86400.0) -> Column:
    """Priority of a row: nearness to a time window, fading over ``horizon``, and recency of use."""
    apart = F.greatest(F.lit(0.0), F.lit(float(start)) - t, t - F.lit(float(end)))
    return weight * (1.0 - F.least(apart / horizon, F.lit(1.0))) + (1.0 - weight) * recency


def frequency_score(counts: Column, windows_apart: Column) -> Column:
    """From use counts by window (latest first) and their distance in windows: faded over five, weighted 1/rank, in [0, 1)."""
    faded = F.zip_with(counts, windows_apart, lambda c, d: c * F.greatest(F.lit(0.0), 1.0 - d / 5.0))
    weighted = F.aggregate(F.transform(faded, lambda c, i: c / (i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    weights = F.aggregate(F.transform(faded, lambda c, i: 1.0 / (i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(counts) > 0, 1.0 - 1.0 / (weighted / weights / 2.0 + 1.0)).otherwise(0.0)


def recency_score(last_use: Column, uses: Column) -> Column:
    return F.coalesce(last_use / F.nullif(uses, F.lit(0)), F.lit(0.0))


def verified(confidence: Column, new: Column | None = None, step: float = 0.1) -> Column:
    return clamp(F.coalesce(new, confidence + step) if new is not None else confidence + step)


def summary(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def truncated(text: Column, most: int = 20) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def snippet(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower case, split at white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def speaker(text: Column) -> Column:
    return F.when(text.contains('"') | text.contains("'"), "character").otherwise("narrator")


def mentions(text: Column, names: list[str], whole_word: bool = False) -> Column:
    """Those of ``names`` that the text has; whole words are sought without regard to case."""
    import re

    if whole_word:
        return F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{re.escape(n)}\b"), F.lit(n)) for n in names]))
    return F.array_compact(F.array(*[F.when(text.contains(n), F.lit(n)) for n in names]))


def theme(sentence: Column) -> Column:
    """The first three words of a sentence that has more."""
    words = F.split(F.trim(sentence), r"\s+")
    return F.when(F.size(words) > 3, F.concat_ws(" ", F.slice(words, 1, 3)))


def spiral(index: Column) -> tuple[Column, Column]:
    """(distance, angle in degrees) of the message at an index."""
    return F.lit(0.2) + F.lit(0.05) * index, ((index * 30) % 360).cast("double")


def name_uuid(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5."""
    import uuid

    raw = F.substring(F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), name.cast("binary"))), 1, 32)
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))), 1, 1)
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def ordered_id(ts: Column, node: int, seq: Column) -> Column:
    """Ids that sort by time: milliseconds, node and sequence in hex."""
    millis = (F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")
    return F.lower(F.concat(F.lpad(F.hex(millis), 12, "0"), F.lpad(F.hex(F.lit(node)), 4, "0"), F.lpad(F.hex(seq.cast("long")), 4, "0")))


def seeded_share(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 by a hash, the same in every run and engine that has MD5."""
    text = F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("double") / float(1 << 24)


def delta_position(time: Column, distance: Column, angle: Column, significance: Column, id_: Column, seed: int = 0) -> tuple[Column, Column, Column]:
    """Where a change of a node goes: ``time``, and the node's place moved a little, more if the change matters more.

    The radius moves by up to a fifth and the angle by up to 5 degrees, both by seeded hashes of the id; it stays at 0.1 or more.
    """
    out = (seeded_share(seed, id_) * 2.0 - 1.0) * 0.2 * significance
    turn = (seeded_share(seed + 1, id_) * 2.0 - 1.0) * 5.0 * significance
    return time, F.greatest(F.lit(0.1), distance + out), F.pmod(angle + turn, F.lit(360.0))
