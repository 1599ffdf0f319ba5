"""Readers for lists kept as CSV next to their key. They return the long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.functions.text import strict_long
from opinion_spark.schemas import ITEM_CSV, USER_ITEMS_CSV
from opinion_spark.sources.files import read_records


def read_item_sets(spark: SparkSession, path: str | list[str], fmt: str = "tsv") -> DataFrame:
    """``(item, user_id)`` rows of ``item, user ids`` records; repeats stay."""
    records = read_records(spark, path, ITEM_CSV, fmt)
    tokens = records.select("item", F.explode(F.split("csv", ",")).alias("token"))
    users = tokens.select("item", strict_long(F.col("token")).alias("user_id"))
    return users.where("user_id IS NOT NULL")


def read_user_items(spark: SparkSession, path: str | list[str], fmt: str = "sequence") -> DataFrame:
    """``(user_id, item)`` rows of ``user, items`` records."""
    records = read_records(spark, path, USER_ITEMS_CSV, fmt)
    return records.select("user_id", F.explode(F.split("csv", ",")).alias("item"))


def read_item_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Joined pairs, one ``item1,users <tab> item2,users`` line each, in the form of
    ``similarity.item_pairs``."""
    ends = F.split("value", r"\s")
    lines = spark.read.text(path).where(F.size(ends) == 2)
    pairs = lines.select(F.split(ends[0], ",").alias("one"), F.split(ends[1], ",").alias("two"))

    def members(end: str) -> DataFrame:
        rows = pairs.select(
            F.col("one")[0].alias("item1"),
            F.col("two")[0].alias("item2"),
            F.posexplode(end).alias("pos", "token"),
        )
        return rows.where("pos > 0").select(
            "item1",
            "item2",
            strict_long(F.col("token")).alias("user_id"),
            F.lit(end == "one").alias("in1"),
            F.lit(end == "two").alias("in2"),
        )

    return (
        members("one")
        .unionByName(members("two"))
        .groupBy("item1", "item2", "user_id")
        .agg(F.bool_or("in1").alias("in1"), F.bool_or("in2").alias("in2"))
    )
