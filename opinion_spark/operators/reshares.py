"""Reshared texts and the users around them.

A text is the key of these jobs. Its SHA-256 digest stands for it while rows are shuffled and
counted; ``with_texts`` puts the base64 form that sinks expect in its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.text import text_digest, to_base64
from opinion_spark.operators.item_sets import PART_BYTES, among, at_least, pack
from opinion_spark.sources.posts import valid
from opinion_spark.staging import stage, staged_lookup

MIN_RESHARES = 100


def _shared(posts: DataFrame, *columns: Column, form: str = "text") -> DataFrame:
    """``text`` and ``columns`` of each share: a reshare counts for the original text, a post that
    was reshared for its own. ``form`` names what stands for the text."""
    text = F.when(F.col("is_retweet"), F.col(f"retweeted_{form}")).when(
        F.col("retweet_count") > 0, F.col(form)
    )
    shares = valid(posts).where("user_id IS NOT NULL").withColumn("_text", text)
    return shares.where("_text IS NOT NULL").select(F.col("_text").alias("text"), *columns)


def retweet_edges(posts: DataFrame, th: int = 10) -> DataFrame:
    """``(item, user_id, n)``: distinct users, and their number, of each text that ``th`` or more
    users share. The item is the digest of the text. Posts that have it as ``digest`` and ``retweeted_digest`` need
    no texts."""
    if "digest" in posts.columns:
        shares = _shared(posts, F.col("user_id"), form="digest").select(F.col("text").alias("item"), "user_id")
    else:
        shares = _shared(posts, F.col("user_id")).select(text_digest(F.col("text")).alias("item"), "user_id")
    return at_least(shares, "item", th)


def texts(posts: DataFrame, named: DataFrame) -> DataFrame:
    """``(item, text)``: the text behind each digest of ``named``, and maybe behind some others. Each is written once."""
    shared = _shared(posts).select(text_digest(F.col("text")).alias("item"), "text")
    return stage(among(shared, named, "item").distinct(), "texts")


def with_texts(named: DataFrame, posts: DataFrame) -> DataFrame:
    """``named`` with the base64 text as ``item`` in place of its digest."""
    columns = [to_base64(F.col("text")).alias(c) if c == "item" else c for c in named.columns]
    return named.join(texts(posts, named), "item").select(*columns)


def retweet_sets(posts: DataFrame, th: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """One list of users per base64 text that ``th`` or more users share."""
    sets = pack(retweet_edges(posts, th), "item", "user_id", "users", part_bytes, unique=True)
    return with_texts(sets, posts)


def user_rt_freq(edges: DataFrame, th: int = MIN_RESHARES) -> DataFrame:
    """``(user_id, value)``: texts per user, for users with ``th`` or more."""
    counts = edges.groupBy("user_id").agg(F.count("*").alias("value"))
    return counts.where(F.col("value") >= th)


def user_text_list(edges: DataFrame, posts: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``user_rt_list`` of ``retweet_edges``: lists are laid out by digest, and the texts, in plain until they are in
    their list, move once."""
    found = texts(posts, edges)
    width = F.octet_length(to_base64(F.col("text"))).cast("bigint")
    sized = edges.select("user_id", "item").join(found.select("item", width.alias("width")), "item")
    sizes = sized.groupBy("user_id").agg(
        F.count("*").alias("n"), F.ceil(F.sum("width") / part_bytes).alias("parts")
    )
    part = F.pmod(F.xxhash64("item"), F.greatest("parts", F.lit(1))).cast("int")
    rows = edges.select("user_id", "item").join(staged_lookup(sizes), "user_id")
    placed = rows.select("user_id", "n", part.alias("part"), "item")
    named = placed.join(found, "item").select("user_id", "n", "part", "text")
    lists = named.repartition("user_id", "part").groupBy("user_id", "n", "part").agg(F.collect_list("text").alias("texts"))
    return lists.select("user_id", "n", "part", F.sort_array(F.transform("texts", to_base64)).alias("items"))


def user_rt_list(edges: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Texts per user, the inverse of the item sets; an ``(item, user_id)`` row occurs once."""
    rows = edges.select("user_id", "item")
    return pack(rows, "user_id", "item", "items", part_bytes, unique=True)
