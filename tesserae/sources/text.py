"""Text sources: Markdown conversations, paragraphs, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def section(text: Column, title: str) -> Column:
    """The body of a ``## title`` section; null if there is none."""
    body = F.regexp_extract(text, rf"(?ms)^##\s+{title}\s*$\n(.*?)(?=^##\s+|\z)", 1)
    return F.nullif(F.trim(F.regexp_replace(body, r"\A\s+|\s+\z", "")), F.lit(""))


def markdown_sections(df: DataFrame, text: str = "value") -> DataFrame:
    """Title, summary, keywords and message block of Markdown conversations."""
    title = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    words = F.transform(F.filter(F.split(section(F.col(text), "Keywords"), r"\s*,\s*"), lambda x: x != ""), F.trim)
    return df.select("*", F.nullif(title, F.lit("")).alias("title"), section(F.col(text), "Summary").alias("summary"), words.alias("keywords"), section(F.col(text), "Messages").alias("messages"))


def parse_messages(df: DataFrame, block: str = "messages") -> DataFrame:
    """``(index, role, content)`` of the ``### User`` and ``### Assistant`` blocks."""
    pattern = r"(?ms)^###\s+(User|Assistant)\s*$\n(.*?)(?=^###\s+(?:User|Assistant)\s*$|\z)"
    roles = F.regexp_extract_all(block, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(block, F.lit(pattern), F.lit(2))
    made = df.select(*[c for c in df.columns if c != block], F.posexplode(F.arrays_zip(roles.alias("role"), bodies.alias("content"))).alias("index", "m"))
    return made.select(*[c for c in df.columns if c != block], "index", F.lower("m.role").alias("role"), F.regexp_replace("m.content", r"\A\s+|\s+\z", "").alias("content"))


def load_conversations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each message of each Markdown file."""
    return parse_messages(markdown_sections(spark.read.text(path, wholetext=True))).drop("value")


def paragraphs(df: DataFrame, key: str, text: str = "text", blank: str = r"\n\s*\n") -> DataFrame:
    """Parts between blank lines, trimmed, without empty ones."""
    parts = df.select(key, F.posexplode(F.split(text, blank)).alias("paragraph", "content"))
    return parts.select(key, "paragraph", F.trim("content").alias("content")).where("content <> ''")


def sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Parts after a full stop, exclamation or question mark."""
    parts = df.select(key, F.posexplode(F.split(text, r"(?<=[.!?])\s+")).alias("sentence", "content"))
    return parts.select(key, "sentence", F.trim("content").alias("content")).where("content <> ''")


def key_event(paras: Column, index: int, most: int = 200) -> Column:
    """The start of the paragraph at a place, or of the last one."""
    at = F.least(F.lit(index + 1), F.size(paras))
    return F.when(F.size(paras) > 0, F.substring(F.element_at(paras, at), 1, most))
