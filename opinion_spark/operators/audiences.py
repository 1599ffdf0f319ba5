"""Distinct users per item as bitmaps.

Users are numbered densely, once for all jobs. An audience is then a bitmap per range of 32,768 numbers,
built before the shuffle: a hot item sends four kilobytes a range and task, not a row per user. The size
of an audience is a count of bits, and the audience of several items or days is the OR of their bitmaps, so
it can be rolled up without going back to the pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinion_spark.staging import stage, staged_lookup

#: Numbers in one bitmap, as ``bitmap_construct_agg`` makes them.
RANGE = 1 << 15
#: Bits of ``monotonically_increasing_id`` below the partition.
ROW_BITS = 33


def user_numbers(edges: DataFrame) -> DataFrame:
    """``(user_id, number)``: the users of ``edges`` in order, from 0 on without a gap.

    Users are dealt by range and numbered inside their partition; the number of users in the partitions
    before is added. Null is nobody.
    """
    users = edges.where("user_id IS NOT NULL").select("user_id").distinct()
    dealt = users.repartitionByRange("user_id").sortWithinPartitions("user_id")
    placed = stage(dealt.select("user_id", F.monotonically_increasing_id().alias("place")), "placed")
    part = F.shiftrightunsigned("place", ROW_BITS)
    # one row per partition
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("users"))
    offsets = staged_lookup(sizes.select("part", F.coalesce(F.sum("users").over(before), F.lit(0)).alias("offset")))
    inside = F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = placed.withColumn("part", part).join(offsets, "part")
    return stage(numbered.select("user_id", (F.col("offset") + inside).alias("number")), "numbers")


def audience_bitmaps(edges: DataFrame, numbers: DataFrame, by: Sequence[str] = ("item",)) -> DataFrame:
    """``(*by, bucket, bits)``: which users each key has, one row per range of numbers.

    Users without a number are left out; repeated edges set a bit again.
    """
    numbered = edges.join(numbers, "user_id")
    bucket = F.floor(F.col("number") / RANGE).alias("bucket")
    bits = F.bitmap_construct_agg(F.pmod("number", F.lit(RANGE))).alias("bits")
    return numbered.groupBy(*by, bucket).agg(bits)


def rolled_up(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bitmaps of fewer keys: everybody who is in any of those that fall together."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def audience_sizes(bitmaps: DataFrame, by: Sequence[str] = ("item",)) -> DataFrame:
    """``(*by, n)``: the number of different users; ``bitmaps`` have one row per key and range."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def items_at_least(edges: DataFrame, numbers: DataFrame, th: int) -> DataFrame:
    """Distinct ``(item, user_id, n)`` of items with ``th`` or more users, as ``item_sets.at_least`` gives them.

    The items are chosen by their bitmaps, so only pairs of items that stay are made distinct.
    """
    named = edges.where("item IS NOT NULL AND user_id IS NOT NULL").select("item", "user_id")
    sizes = audience_sizes(audience_bitmaps(named, numbers))
    kept = staged_lookup(sizes.where(F.col("n") >= th))
    return named.join(kept, "item").distinct()
