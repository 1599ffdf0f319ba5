"""Counts, time series and histograms over posts.

Every job is one scan and one aggregation that is combined map-side, so a key that holds most of
the rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.times import day_bucket, readable
from opinion_spark.sources.posts import valid


def tweet_count(raw: DataFrame) -> DataFrame:
    """``tweetNum`` (records with content) and ``errorNum`` (records with key 0)."""
    totals = raw.agg(
        F.count_if(F.octet_length("raw") > 1).alias("tweets"),
        F.count_if(F.col("key") == 0).alias("errors"),
    )
    stacked = totals.select(
        F.stack(
            F.lit(2), F.lit("tweetNum"), F.col("tweets"), F.lit("errorNum"), F.col("errors")
        ).alias("metric", "n")
    )
    return stacked.where("n > 0")


def user_tweet_count(posts: DataFrame) -> DataFrame:
    """Posts per author."""
    named = valid(posts).where(F.col("user_id").isNotNull())
    return named.groupBy("user_id").agg(F.count("*").alias("n"))


def filter_user_counts(counts: DataFrame, th: int = 10) -> DataFrame:
    """Users with strictly more than ``th`` posts."""
    return counts.where(F.col("n") > th)


def user_count(counts: DataFrame) -> DataFrame:
    """Users per post count, and their total as ``userNum``, in one pass."""
    metric = F.when(F.grouping("n") == 1, F.lit("userNum")).otherwise(F.col("n").cast("string"))
    return (
        counts.select("n")
        .rollup("n")
        .agg(metric.alias("metric"), F.count("*").alias("users"))
        .select("metric", F.col("users").alias("n"))
        .where("n > 0")
    )


def time_series(posts: DataFrame) -> DataFrame:
    """Posts per creation time in epoch ms."""
    dated = valid(posts).where(F.col("created_ms").isNotNull())
    return dated.groupBy("created_ms").agg(F.count("*").alias("n"))


def time_stamp(posts: DataFrame, tz: str = "UTC", label: str | None = None) -> DataFrame:
    """``time_series`` with the time in words."""
    return time_series(posts).withColumn("created", readable(F.col("created_ms"), tz, label))


def daily_freq(
    posts: DataFrame,
    anchor_ms: int,
    days: int = 31,
    originals_only: bool = False,
    tz: str = "UTC",
    label: str | None = None,
) -> DataFrame:
    """Posts per day for the ``days`` days up to the one starting at ``anchor_ms``; bucket 0 has
    the rest. With ``originals_only`` reshares are left out."""
    dated = valid(posts).where(F.col("created_ms").isNotNull())
    if originals_only:
        dated = dated.where(~F.col("is_retweet"))
    bucket = day_bucket(F.col("created_ms"), anchor_ms, days)
    counts = dated.groupBy(bucket.alias("day_ms")).agg(F.count("*").alias("n"))
    return counts.withColumn("day", readable(F.col("day_ms"), tz, label))


def retweet_count(posts: DataFrame) -> DataFrame:
    """Reshares per original post."""
    reshares = valid(posts).where(F.col("is_retweet") & F.col("retweeted_id").isNotNull())
    return reshares.groupBy("retweeted_id").agg(F.count("*").alias("n"))


def histogram(counts: DataFrame) -> DataFrame:
    """How often each count ``n`` occurs."""
    return counts.groupBy(F.col("n").alias("value")).agg(F.count("*").alias("freq"))


def sum_by_key(pairs: DataFrame) -> DataFrame:
    """``(key, value)`` pairs with equal keys added up, ready for a text sink."""
    return pairs.groupBy("key").agg(F.sum("value").cast("bigint").alias("value"))
