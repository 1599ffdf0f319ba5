"""Chains that hand records over in files, as one batch job leaves them for the next.

Every function writes its input below ``path`` in the layout of the batch jobs and goes on from what
it reads there. ``path`` must be new and on a file system that all executors reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark import schemas
from opinion_spark.operators import counts, keywords, network, opinion
from opinion_spark.sources import files
from opinion_spark.sources.network import parse_network, read_network
from opinion_spark.sources.posts import parse_posts, read_posts
from opinion_spark.sources.sets import read_item_sets, read_user_items


def posts_per_user(raw: DataFrame, path: str) -> DataFrame:
    """``user_tweet_count`` of raw posts crawled into two folders of ``long, text`` records."""
    crawls = [f"{path}/failed", f"{path}/loaded"]
    for crawl, rows in zip(crawls, (F.col("key") == 0, F.col("key") != 0), strict=True):
        files.write_sequence(raw.where(rows), crawl)
    return counts.user_tweet_count(parse_posts(read_posts(raw.sparkSession, crawls, "sequence")))


def counts_as_text(pairs: DataFrame, path: str) -> DataFrame:
    """``(key, value)`` counts as ``text, int`` records, added up and written once more as ordered lines."""
    spark = pairs.sparkSession
    files.write_sequence(pairs.select("key", F.col("value").cast("int").alias("value")), f"{path}/counts")
    summed = counts.sum_by_key(files.read_sequence(spark, f"{path}/counts", schemas.COUNTED_KEY))
    files.write_tsv(summed, f"{path}/lines", order_by=["key"])
    return files.read_tsv(spark, f"{path}/lines", "key string, value bigint")


def listed_network(raw: DataFrame, listed: DataFrame, path: str, follow_limit: int | None) -> DataFrame:
    """``filter_network_by_list`` with the network in ``text, text`` records and the list as text."""
    spark = raw.sparkSession
    files.write_sequence(raw, f"{path}/network")
    files.write_tsv(listed, f"{path}/users")
    users = files.side_list(files.read_tsv(spark, f"{path}/users", schemas.SIDE_LIST))
    records = parse_network(read_network(spark, f"{path}/network", "sequence"))
    return network.filter_network_by_list(records, users, follow_limit).select("profile", "csv")


def user_items(lists: DataFrame, path: str) -> DataFrame:
    """``(user_id, item)`` of ``(user_id, items)`` lists kept as ``long, text`` records."""
    files.write_sequence(lists.select("user_id", F.array_join("items", ",").alias("csv")), path)
    return read_user_items(lists.sparkSession, path)


def item_users(sets: DataFrame, path: str) -> DataFrame:
    """``(item, user_id)`` of ``(item, users)`` lists kept as ordered text."""
    files.write_tsv(sets.select("item", "users"), path, order_by=["item"])
    return read_item_sets(sets.sparkSession, path)


def keyword_buzz(posts: DataFrame, terms: DataFrame, path: str) -> DataFrame:
    """``term_buzz_by_table`` with the terms in a keyword file; a term with line breaks is several terms there."""
    terms.select("term").write.text(path)
    return keywords.term_buzz_by_table(posts, files.read_terms(posts.sparkSession, path))


def opinion_by_file(texts: DataFrame, rt_opinions: DataFrame, path: str) -> DataFrame:
    """``user_opinion`` with the opinions of encoded texts in a text file."""
    files.write_tsv(rt_opinions, path)
    opinions = files.read_tsv(texts.sparkSession, path, schemas.ITEM_OPINIONS)
    return opinion.user_opinion(texts, opinions, key="base64", digests=False)


def ranked_lines(pairs: DataFrame, path: str) -> DataFrame:
    """``(line, value)``: the lines of the one sorted file of ``pairs``, numbered."""
    files.write_sorted(pairs, path, [pairs.columns[0]])
    return files.numbered_lines(pairs.sparkSession, path)
