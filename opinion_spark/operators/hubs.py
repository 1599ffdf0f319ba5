"""Follow-network records too large for one row.

A record may come in numbered parts, ``(profile, part, csv)``: pieces of the positional CSV, cut at commas,
the three leading numbers in part 0. Which tokens of a part are followees follows from the counts of the
account and from how many tokens stand in the parts before. These numbers are taken once, from rows without
lists, and joined to the parts by account and part, so no task ever holds an account. What the jobs give
is the record of the unsplit job, in parts of the same numbers; the size of the parts changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinion_spark.functions.once import once
from opinion_spark.functions.text import strict_long
from opinion_spark.operators.network import FOLLOW_LIMIT, LANGUAGE
from opinion_spark.schemas import PROFILE_JSON
from opinion_spark.sources.files import side_list
from opinion_spark.sources.network import csv_tokens
from opinion_spark.staging import stage, staged_lookup

PART_TOKENS = 1 << 20


def split_records(raw: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``(profile, part, csv)`` of whole ``(profile, csv)`` records; empty tokens at the end do not count."""
    if part_tokens < 3:
        raise ValueError("part_tokens must be at least 3")
    tokens = raw.select("profile", once(csv_tokens(F.col("csv"))).alias("tokens"))
    last = F.greatest(F.floor((F.size("tokens") - 1) / part_tokens), F.lit(0)).cast("int")
    parts = tokens.select("profile", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    own = F.slice("tokens", F.col("part") * part_tokens + 1, F.lit(part_tokens))
    return parts.select("profile", "part", F.array_join(own, ",").alias("csv"))


def _placed(parts: DataFrame, tokens: Column) -> DataFrame:
    """``(profile, part, tokens, offset, total, head)`` of each part; ``head`` is the leading three."""
    listed = parts.select("profile", "part", once(tokens).alias("tokens"))
    listed = stage(listed, "tokens")
    head = F.when(F.col("part") == 0, F.slice("tokens", 1, 3))
    narrow = listed.select("profile", "part", F.size("tokens").cast("bigint").alias("size"), head.alias("head"))
    account = W.partitionBy("profile")
    ahead = account.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    numbers = narrow.select(
        "profile",
        "part",
        F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("offset"),
        F.sum("size").over(account).alias("total"),
        F.max("head").over(account).alias("head"),
    )
    return listed.join(staged_lookup(numbers), ["profile", "part"])


def _between(low: Column, high: Column) -> Column:
    """The tokens of a part that are at ``low`` to ``high`` of the account."""
    first = F.greatest(low - F.col("offset"), F.lit(0))
    end = F.least(high - F.col("offset"), F.size("tokens").cast("bigint"))
    return F.slice("tokens", (first + 1).cast("int"), F.greatest(end - first, F.lit(0)).cast("int"))


def following_parts(parts: DataFrame) -> DataFrame:
    """``(profile, part, following)``: ``following_only`` for records in parts.

    Parts without followees are left out, but an account that follows nobody keeps its part 0 with an
    empty list. Protected accounts and records shorter than their counts say are left out as there.
    """
    placed = _placed(parts, F.split("csv", ","))
    n_followers, n_following = (strict_long(F.get("head", F.lit(i))).try_cast("int") for i in (1, 2))
    counted = placed.withColumns({"n_followers": n_followers, "n_following": n_following})
    start = F.col("n_followers").cast("bigint") + 3
    whole = counted.where("n_followers >= 0 AND n_following >= 0").where(F.col("total") >= start + F.col("n_following"))
    cut = whole.withColumn("cut", _between(start, start + F.col("n_following")))
    silent = (F.col("n_following") == 0) & (F.col("part") == 0)
    return cut.where((F.size("cut") > 0) | silent).select("profile", "part", F.array_join("cut", ",").alias("following"))


def simplify_parts(parts: DataFrame, follow_limit: int | None = FOLLOW_LIMIT) -> DataFrame:
    """``(id, part, following)``: ``simplify_all`` for records in parts; ``follow_rows`` reads it."""
    profile = F.from_json("profile", PROFILE_JSON)
    named = parts.select("profile", "part", "csv", once(profile).alias("p")).where("p.id IS NOT NULL")
    if follow_limit is not None:
        named = named.where(F.coalesce("p.friends_count", F.lit(-1)) < follow_limit)
    following = following_parts(named.select("profile", "part", "csv"))
    return following.select(F.from_json("profile", PROFILE_JSON)["id"].alias("id"), "part", "following")


def annotate_parts(
    parts: DataFrame, listed: DataFrame, lang: str = LANGUAGE, follow_limit: int = FOLLOW_LIMIT
) -> DataFrame:
    """``(profile, part, csv)``: ``annotate_following`` for records in parts; parts with nothing to say
    are left out. Joined by commas in the order of their parts they are the record of the unsplit job."""
    listed = staged_lookup(side_list(listed))
    own = listed.select(F.col("user_id").alias("id"), F.col("value").alias("own"))
    profile = F.from_json("profile", PROFILE_JSON)
    named = parts.select("profile", "part", "csv", once(profile).alias("p")).select("*", F.col("p.id").alias("id"))
    kept = (
        named.where("id IS NOT NULL")
        .where(F.coalesce("p.friends_count", F.lit(-1)) < follow_limit)
        .join(own, "id", "left")
        .where((F.lower("p.lang") == lang.lower()) | F.col("own").isNotNull())
    )
    kept = stage(kept.select("profile", "part", "csv", F.coalesce("own", F.lit(0)).alias("own")), "kept")
    ids = F.filter(F.transform(F.split("csv", ","), strict_long), lambda x: x.isNotNull())
    placed = _placed(kept, ids).where(F.size("head") == 3)
    own_of = staged_lookup(kept.where("part = 0").select("profile", "own"))
    placed = placed.join(own_of, "profile").where(F.get("head", F.lit(2)) <= follow_limit)
    followed, follows = F.get("head", F.lit(1)), F.get("head", F.lit(2))
    start = F.greatest(followed, F.lit(0)) + 3
    cut = stage(
        placed.select(
            "profile",
            "part",
            F.when(F.col("part") == 0, F.concat_ws(",", F.concat_ws(" ", F.get("head", F.lit(0)), "own"), followed, follows)).alias("lead"),
            F.when(follows > 0, _between(F.lit(3).cast("bigint"), start)).alias("followers"),
            F.when(follows > 0, _between(start, F.col("total"))).alias("followees"),
        ),
        "cut",
    )
    values = listed.select(F.col("user_id").alias("followee"), "value")
    marked = F.concat_ws(";", F.col("followee"), F.coalesce("value", F.lit(0)))
    # a part's worth of followees comes back together
    annotated = (
        cut.select("profile", "part", F.posexplode("followees").alias("pos", "followee"))
        .join(values, "followee", "left")
        .groupBy("profile", "part")
        .agg(F.sort_array(F.collect_list(F.struct("pos", marked.alias("m")))).alias("marked"))
        .select("profile", "part", F.array_join("marked.m", ",").alias("following"))
    )
    followers = F.nullif(F.array_join(F.transform("followers", lambda x: x.cast("string")), ","), F.lit(""))
    joined = cut.join(annotated, ["profile", "part"], "left")
    csv = F.concat_ws(",", "lead", followers, "following")
    return joined.select("profile", "part", csv.alias("csv")).where("csv <> ''")
