"""Filters over follow-network records, and how active or opinionated the followed accounts are.

Record jobs work on one record at a time and never touch its lists unless they cut them. Neighbour
jobs work on ``follows``, one ``(user_id, followee)`` row each. An account that follows nobody has
one row with a NULL followee and so has a share of 0; a followee that cannot be read is NULL as
well and counts in the denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.once import once
from opinion_spark.functions.text import strict_long
from opinion_spark.sources.files import side_list
from opinion_spark.sources.network import csv_tokens
from opinion_spark.staging import staged_lookup

FOLLOW_LIMIT = 2000
LANGUAGE = "ja"
UNLISTED = -1


def _below(follow_limit: int | None) -> Column:
    """Accounts that follow fewer than ``follow_limit``; all of them without a limit."""
    return F.lit(True) if follow_limit is None else F.col("friends_count") < follow_limit


def filter_network_by_profile(
    net: DataFrame, lang: str = LANGUAGE, follow_limit: int | None = FOLLOW_LIMIT
) -> DataFrame:
    """Records of accounts in one language that follow fewer than ``follow_limit``."""
    same_language = F.lower("lang") == lang.lower()
    return net.where(
        F.col("id").isNotNull() & same_language & _below(follow_limit)
    )


def filter_network_by_list(
    net: DataFrame, listed: DataFrame, follow_limit: int | None = FOLLOW_LIMIT
) -> DataFrame:
    """Records of listed accounts that follow fewer than ``follow_limit``."""
    ids = listed.select(F.col("user_id").alias("id"))
    return net.where(_below(follow_limit)).join(ids, "id", "left_semi")


def drop_profile_and_filter(
    net: DataFrame, listed: DataFrame, follow_limit: int | None = FOLLOW_LIMIT
) -> DataFrame:
    """``filter_network_by_list`` keyed by account id, without the profile."""
    return filter_network_by_list(net, listed, follow_limit).select("id", "csv")


def _cut_following(net: DataFrame) -> DataFrame:
    """``net`` with ``following``, the followee part of the CSV; protected accounts drop out, and
    so do records shorter than their counts say."""
    public = net.where("n_followers >= 0 AND n_following >= 0")
    complete = public.withColumn("tokens", once(csv_tokens(F.col("csv")))).where(
        F.size("tokens") >= 3 + F.col("n_followers") + F.col("n_following")
    )
    cut = F.slice("tokens", F.col("n_followers") + 4, F.col("n_following"))
    return complete.withColumn("following", F.array_join(cut, ",")).drop("tokens")


def following_only(net: DataFrame) -> DataFrame:
    """``(profile, following)``: only the followees of each record."""
    return _cut_following(net).select("profile", "following")


def simplify_network(net: DataFrame, follow_limit: int | None = FOLLOW_LIMIT) -> DataFrame:
    """``(id, csv)`` of accounts that follow fewer than ``follow_limit``."""
    kept = net.where(F.col("id").isNotNull() & _below(follow_limit))
    return kept.select("id", "csv")


def simplify_all(net: DataFrame, follow_limit: int | None = FOLLOW_LIMIT) -> DataFrame:
    """``(id, following)``: both of the above."""
    kept = net.where(F.col("id").isNotNull() & _below(follow_limit))
    return _cut_following(kept).select("id", "following")


def follow_rows(following: DataFrame) -> DataFrame:
    """``follows`` rows of ``(id, following)`` records, as the neighbour jobs read them."""
    return following.select(
        F.col("id").alias("user_id"), F.explode(csv_tokens(F.col("following"))).alias("token")
    ).select("user_id", strict_long(F.col("token")).alias("followee"))


def annotate_following(
    net: DataFrame,
    listed: DataFrame,
    lang: str = LANGUAGE,
    follow_limit: int = FOLLOW_LIMIT,
) -> DataFrame:
    """``(profile, csv)`` with each account's value (0 if unlisted) behind the id and the followees.

    Keeps accounts below the follow limit that are listed or use the language. Tokens that are no
    ids are left out before positions are counted. One record per account is expected.
    """
    listed = staged_lookup(side_list(listed))
    own = listed.select(F.col("user_id").alias("id"), F.col("value").alias("own"))
    kept = (
        net.where(F.col("id").isNotNull() & _below(follow_limit))
        .join(own, "id", "left")
        .where((F.lower("lang") == lang.lower()) | F.col("own").isNotNull())
    )
    ids = F.filter(F.transform(csv_tokens(F.col("csv")), strict_long), lambda x: x.isNotNull())
    parsed = (
        kept.select("id", "profile", F.coalesce("own", F.lit(0)).alias("own"), once(ids).alias("t"))
        .where(F.size("t") >= 3)
        .select(
            "id",
            "profile",
            "own",
            F.get("t", 0).alias("self"),
            F.get("t", 1).alias("followed"),
            F.get("t", 2).alias("follows"),
            "t",
        )
        .where(F.col("follows") <= follow_limit)
    )
    start = F.greatest(F.col("followed"), F.lit(0)).cast("int") + 3
    listed_followees = F.slice("t", start + 1, F.greatest(F.size("t") - start, F.lit(0)))
    followees = parsed.where("follows > 0").select(
        "id", F.posexplode(listed_followees).alias("pos", "followee")
    )
    values = listed.select(F.col("user_id").alias("followee"), "value")
    marked = F.concat_ws(";", F.col("followee"), F.coalesce("value", F.lit(0)))
    # At most one row's worth of followees comes back together.
    annotated = (
        followees.join(values, "followee", "left")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", marked.alias("m")))).alias("marked"))
        .select("id", F.array_join("marked.m", ",").alias("following"))
    )
    followers = F.when(
        F.col("follows") > 0, F.slice("t", F.lit(4), F.least(start, F.size("t")) - 3)
    ).otherwise(F.array().cast("array<bigint>"))
    head = F.concat_ws(
        ",", F.concat_ws(" ", "self", "own"), F.col("followed"), F.col("follows")
    )
    followers_csv = F.nullif(
        F.array_join(F.transform(followers, lambda x: x.cast("string")), ","), F.lit("")
    )
    return parsed.join(annotated, "id", "left").select(
        "profile", F.concat_ws(",", head, followers_csv, "following").alias("csv")
    )


def neighbor_stats(follows: DataFrame, listed: DataFrame) -> DataFrame:
    """For each listed account: own value, followees, listed followees and the sum of their values.

    Rows of unlisted accounts go first; the followee lookup is a left join with a unique right
    side, which adaptive execution splits at a followee that very many follow.
    """
    listed = staged_lookup(side_list(listed))
    own = listed.select("user_id", F.col("value").alias("own"))
    values = listed.select(F.col("user_id").alias("followee"), "value")
    return (
        follows.join(own.select("user_id"), "user_id", "left_semi")
        .join(values, "followee", "left")
        .groupBy("user_id")
        .agg(
            F.count("*").alias("n_following"),
            F.count("value").alias("n_vocal"),
            F.coalesce(F.sum("value"), F.lit(0)).alias("total"),
        )
        .join(own, "user_id")
    )


def vocal_rate(follows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Share of listed accounts among the followees of each listed account."""
    stats = neighbor_stats(follows, frequencies)
    return stats.select(
        "user_id",
        F.col("own").alias("freq"),
        (F.col("n_vocal") / F.col("n_following")).alias("vocal_rate"),
    )


def vocal_rate_avg(follows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Mean of ``vocal_rate`` per reshare frequency."""
    rates = vocal_rate(follows, frequencies)
    return rates.groupBy("freq").agg(F.avg("vocal_rate").alias("vocal_rate"))


def vocal_avg(follows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Mean frequency of the listed followees, and the same spread over all followees."""
    stats = neighbor_stats(follows, frequencies)
    mean = F.when(F.col("n_vocal") > 0, F.col("total") / F.col("n_vocal")).otherwise(0.0)
    return stats.select(
        "user_id",
        F.col("own").alias("freq"),
        mean.alias("vocal_avg"),
        (F.col("total") / F.col("n_following")).alias("total_avg"),
    )


def neighbor_opinion(follows: DataFrame, opinions: DataFrame) -> DataFrame:
    """Mean opinion of the listed followees of each listed account, 0 without any.

    ``n_vocal`` tells an all-0 neighbourhood from an empty one.
    """
    stats = neighbor_stats(follows, opinions)
    mean = F.when(F.col("n_vocal") > 0, F.col("total") / F.col("n_vocal")).otherwise(0.0)
    return stats.select(
        "user_id", F.col("own").alias("opinion"), mean.alias("avg_opinion"), "n_vocal"
    )


def follower_counts(records: DataFrame) -> DataFrame:
    """``(id, n_followers)`` of ``(id, csv)`` records without a profile."""
    count = F.get(F.split("csv", ",", 3), F.lit(1))
    return records.select("id", strict_long(count).try_cast("int").alias("n_followers"))


def degree_hist_by_opinion(accounts: DataFrame, opinions: DataFrame) -> DataFrame:
    """Accounts per opinion and number of followers; unlisted accounts have opinion -1."""
    values = opinions.select(F.col("user_id").alias("id"), "value")
    return (
        accounts.where("n_followers >= 0")
        .select("id", "n_followers")
        .join(values, "id", "left")
        .groupBy(
            F.coalesce("value", F.lit(UNLISTED)).alias("opinion"),
            F.col("n_followers").alias("degree"),
        )
        .agg(F.count("*").alias("freq"))
    )


def degree_hist(accounts: DataFrame) -> DataFrame:
    """Accounts per number of followers."""
    return (
        accounts.where("n_followers >= 0")
        .groupBy(F.lit(1).alias("key"), F.col("n_followers").alias("degree"))
        .agg(F.count("*").alias("freq"))
    )
