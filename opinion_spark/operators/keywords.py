"""Posts that mention given words, and what they link to."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.text import contains_any, text_digest
from opinion_spark.operators.terms import find_terms
from opinion_spark.sources.posts import linked_urls, valid
from opinion_spark.staging import stage, staged_lookup

# The ten parties of the 2013 election.
PARTY_NAMES = (
    "自民党",
    "民主党",
    "日本維新の会",
    "公明党",
    "みんなの党",
    "生活の党",
    "共産党",
    "社民党",
    "新党改革",
    "みどりの風",
)


def keyword_filter(posts: DataFrame, terms: Iterable[str]) -> DataFrame:
    """Parsed posts with a known author whose text holds any of ``terms``."""
    return valid(posts).where((F.col("key") != 0) & contains_any(F.col("text"), terms))


def _distinct_texts(posts: DataFrame) -> DataFrame:
    """``(digest, text, posts)``: each text once, with the number of posts that have it."""
    named = posts.where(F.col("text").isNotNull()).select(text_digest(F.col("text")).alias("digest"), "text")
    return stage(named.groupBy("digest", "text").agg(F.count("*").alias("posts")), "texts")


def keyword_filter_by_table(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """``keyword_filter`` for a table ``(term)`` of any size; empty terms match nothing.

    Distinct texts are searched for all terms at once, posts meet the result by digest.
    """
    kept = valid(posts).where((F.col("key") != 0) & F.col("text").isNotNull())
    hits = staged_lookup(find_terms(_distinct_texts(kept), terms).select("digest").distinct())
    digested = kept.withColumn("digest", text_digest(F.col("text")))
    return digested.join(hits, "digest", "left_semi").drop("digest")


def topic_posts(posts: DataFrame, topics: Iterable[str]) -> DataFrame:
    """Parsed posts whose text holds any of ``topics``, whatever their key."""
    return valid(posts).where(contains_any(F.col("text"), topics))


def term_buzz(posts: DataFrame, terms: Iterable[str] = PARTY_NAMES) -> DataFrame:
    """Posts per term. A post counts once for each term it names. One pass, no row explosion."""
    terms = list(dict.fromkeys(terms))
    totals = valid(posts).agg(
        *[
            F.count_if(F.contains("text", F.lit(t))).alias(f"n{i}")
            for i, t in enumerate(terms)
        ]
    )
    cells = [c for i, t in enumerate(terms) for c in (F.lit(t), F.col(f"n{i}"))]
    return totals.select(F.stack(F.lit(len(terms)), *cells).alias("term", "n")).where("n > 0")


def term_buzz_by_table(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term_buzz`` for a table ``(term)`` of any size; empty terms match nothing."""
    texts = _distinct_texts(valid(posts))
    found = find_terms(texts, terms).join(texts.select("digest", "posts"), "digest")
    return found.groupBy("term").agg(F.sum("posts").alias("n"))


def topic_url_user(posts: DataFrame, topics: Iterable[str]) -> DataFrame:
    """One ``(url, key)`` row for each link in a post on the topics; repeats stay."""
    return linked_urls(topic_posts(posts, topics), "key")


def topic_url_count(posts: DataFrame, topics: Iterable[str]) -> DataFrame:
    """Mentions per link inside posts on the topics."""
    links = topic_url_user(posts, topics)
    return links.groupBy("url").agg(F.count("*").alias("n"))
