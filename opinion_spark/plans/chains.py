"""The usual chains of jobs, each one Spark plan from posts to result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.text import one_line
from opinion_spark.operators import counts, links, network, opinion, reshares, similarity
from opinion_spark.staging import stage


def activity_histogram(posts: DataFrame, th: int = 10) -> DataFrame:
    """How many users wrote how often, for users above ``th`` posts."""
    per_user = counts.filter_user_counts(counts.user_tweet_count(posts), th)
    return counts.user_count(per_user)


def link_network(
    posts: DataFrame, redirects: DataFrame, th: int = 10, jaccard: float = 0.2
) -> DataFrame:
    """Links between pages that the same users share."""
    edges = links.url_refer(posts, redirects, th).withColumnRenamed("url", "item")
    return similarity.jaccard_links(edges, jaccard)


def reshare_network(posts: DataFrame, th: int = 10, jaccard: float = 0.2) -> DataFrame:
    """Links between texts that the same users reshare, with the texts in plain.

    The texts come in last, so only those with a link are looked up.
    """
    links = stage(similarity.jaccard_links(reshares.retweet_edges(posts, th), jaccard), "links")
    ends = links.select(F.col("item1").alias("item")).union(links.select("item2"))
    texts = reshares.texts(posts, ends)
    named = links
    for end in ("item1", "item2"):
        named = named.join(
            texts.select(F.col("item").alias(end), F.col("text").alias(f"_{end}")), end
        )
    first, second = F.least("_item1", "_item2"), F.greatest("_item1", "_item2")
    return named.select(one_line(first).alias("item1"), one_line(second).alias("item2"), "jaccard")


def opinion_exposure(
    posts: DataFrame, rt_opinions: DataFrame, follows: DataFrame, th: int = 10
) -> DataFrame:
    """Opinion of each user by the texts reshared, next to that of the accounts followed."""
    edges = reshares.retweet_edges(posts, th)
    return network.neighbor_opinion(follows, opinion.user_opinion(edges, rt_opinions))
