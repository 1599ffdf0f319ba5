"""Posts: raw JSON records to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.functions.once import once
from opinion_spark.functions.times import created_ms
from opinion_spark.schemas import POST_JSON, RAW_POST, URL_ENTITIES
from opinion_spark.sources.files import read_records


def read_posts(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Raw ``(key, raw)`` records; the key is the author, 0 where loading failed."""
    return read_records(spark, path, RAW_POST, fmt)


def parse_posts(raw: DataFrame) -> DataFrame:
    """Typed columns next to ``key`` and ``raw``. A record that fails to parse keeps its row,
    with a NULL ``tweet_id``."""
    parsed = raw.select("key", "raw", once(F.from_json("raw", POST_JSON)).alias("p"))
    return parsed.select("key", "raw", "p.*").select(
        "key",
        "raw",
        F.col("id").alias("tweet_id"),
        F.col("user.id").alias("user_id"),
        created_ms(F.col("created_at")).alias("created_ms"),
        "text",
        "retweet_count",
        F.col("retweeted_status").isNotNull().alias("is_retweet"),
        F.col("retweeted_status.id").alias("retweeted_id"),
        F.col("retweeted_status.text").alias("retweeted_text"),
        F.coalesce("entities.urls", F.array().cast(URL_ENTITIES)).alias("urls"),
    )


def linked_urls(posts: DataFrame, *columns: str) -> DataFrame:
    """One ``url`` row per link of a post, with ``columns``; the expanded form where there is one."""
    rows = posts.select(F.explode("urls").alias("link"), *columns)
    url = F.coalesce("link.expanded_url", "link.url")
    return rows.select(url.alias("url"), *columns).where("url IS NOT NULL")


def valid(posts: DataFrame) -> DataFrame:
    """Posts that could be parsed."""
    return posts.where(F.col("tweet_id").isNotNull())
