"""Domains, topics and facts; conversations and their keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import STOP_WORDS, snippet, summary
from tesserae.operators.aggregates import top_terms
from tesserae.operators.joins import shared_values


def topics_by_domain(domains: DataFrame, topics: DataFrame) -> DataFrame:
    return domains.join(topics, "domain_id")


def facts_by_topic(topics: DataFrame, facts: DataFrame) -> DataFrame:
    return topics.join(facts, "topic_id")


def topic_growth(domains: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics of a domain as they come, counted up."""
    w = Window.partitionBy("domain_id").orderBy("topic_id")
    return topics_by_domain(domains, topics).select("domain_id", "domain", "topic_id", F.row_number().over(w).cast("long").alias("topics_so_far"))


def facts_per_topic(topics: DataFrame, facts: DataFrame) -> DataFrame:
    return facts_by_topic(topics, facts).groupBy("topic_id", "topic").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


def related_facts(pairs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` in both directions, each once."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))).where("src <> dst").distinct()


def search_messages(messages: DataFrame, words: str) -> DataFrame:
    """Messages with a text, whatever its case, and the start of each."""
    return messages.where(F.lower("text").contains(words.lower())).select("conv_id", "turn", "role", snippet(F.col("text")).alias("snippet"))


def keywords(messages: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent terms of each conversation."""
    return top_terms(messages, "conv_id", "text", k, 3, STOP_WORDS)


def all_keywords(keywords_: DataFrame) -> DataFrame:
    return keywords_.select("term").distinct().orderBy("term")


def by_keyword(keywords_: DataFrame, term: str) -> DataFrame:
    return keywords_.where(F.col("term") == term).select("conv_id").distinct()


def related_conversations(keywords_: DataFrame) -> DataFrame:
    """Pairs of conversations by how many keywords they share."""
    return shared_values(keywords_.groupBy("conv_id").agg(F.collect_set("term").alias("terms")), "conv_id", "terms")


def summaries(messages: DataFrame, most: int = 200) -> DataFrame:
    """The start of what was said in each conversation; only so much of each message as can be shown is gathered."""
    part = messages.select("conv_id", F.struct("turn", F.substring(F.coalesce("text", F.lit("")), 1, most + 1).alias("text")).alias("m"))
    said = part.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"), F.count("*").alias("n_messages"))
    return said.select("conv_id", "n_messages", summary(F.array_join(F.transform("ms", lambda m: m["text"]), " "), most).alias("summary"))


def newest_first(conversations: DataFrame, when: str = "conv_id") -> DataFrame:
    return conversations.orderBy(F.desc(when))
