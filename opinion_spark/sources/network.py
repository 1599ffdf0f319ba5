"""Follow-network records: a profile and a positional CSV of account ids.

The CSV holds ``id, n_followers, n_following, followers..., following...``; a count of -1 marks a
protected account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.functions.once import once
from opinion_spark.functions.text import strict_long
from opinion_spark.schemas import PROFILE_JSON, RAW_NETWORK
from opinion_spark.sources.files import read_records


def read_network(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Raw ``(profile, csv)`` records."""
    return read_records(spark, path, RAW_NETWORK, fmt)


def csv_tokens(csv: Column) -> Column:
    """Tokens of a CSV; empty ones at its end do not count."""
    return F.split(F.regexp_replace(csv, ",+$", ""), ",")


def parse_network(raw: DataFrame) -> DataFrame:
    """``raw`` with the profile fields and the two counts. An unreadable profile has a NULL id."""
    profile = F.from_json("profile", PROFILE_JSON)
    # The two counts stand at the front, so the lists are not split to read them.
    head = F.split("csv", ",", 4)
    record = F.struct(
        profile.alias("p"),
        strict_long(F.get(head, F.lit(1))).try_cast("int").alias("n_followers"),
        strict_long(F.get(head, F.lit(2))).try_cast("int").alias("n_following"),
    )
    return raw.select("profile", "csv", once(record).alias("r")).select(
        "profile",
        "csv",
        F.col("r.p.id").alias("id"),
        F.col("r.p.lang").alias("lang"),
        F.coalesce("r.p.friends_count", F.lit(-1)).alias("friends_count"),
        F.col("r.n_followers").alias("n_followers"),
        F.col("r.n_following").alias("n_following"),
    )
