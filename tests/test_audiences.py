"""Audiences as bitmaps, and the counters before the shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from opinion_spark.operators import audiences, item_sets
from util import rows

SCHEMA = "item string, user_id long, day int"


def edges(n=4000, seed=0):
    """A hot item with a third of all rows, a long tail, users with far apart ids."""
    rng = random.Random(seed)
    found = []
    for i in range(n):
        item = "hot" if i % 3 == 0 else rng.choice([f"i{rng.randrange(30)}", f"rare{i}"])
        found.append((item, rng.randrange(900) ** 5, i % 5))
    return found + found[:100] + [("none", None, 1), (None, 5, 1)]


def brute(data):
    users = {}
    for item, user, _ in data:
        if item is not None and user is not None:
            users.setdefault(item, set()).add(user)
    return users


def shuffled_bytes(spark, action):
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    action()
    return total() - before


def test_numbers_are_dense_and_in_order(table, conf):
    conf("spark.sql.shuffle.partitions", "5")
    got = sorted((r.number, r.user_id) for r in audiences.user_numbers(table(edges(), SCHEMA)).collect())
    users = sorted({u for _, u, _ in edges() if u is not None})
    assert got == list(enumerate(users))


def test_sizes_and_rollups(table, monkeypatch):
    df = table(edges(), SCHEMA).where("item IS NOT NULL")
    numbers = audiences.user_numbers(df)
    want = sorted((item, len(users)) for item, users in brute(edges()).items())
    assert rows(audiences.audience_sizes(audiences.audience_bitmaps(df, numbers))) == want
    daily = audiences.audience_bitmaps(df, numbers, ["item", "day"])
    assert rows(audiences.audience_sizes(audiences.rolled_up(daily, ["item"]))) == want
    by_day = audiences.audience_sizes(daily, ["item", "day"])
    assert by_day.where("item = 'hot' AND day = 1").head().n == len({u for i, u, d in edges() if i == "hot" and d == 1})


def test_more_users_than_one_range(spark):
    df = spark.range(100_000).select(F.lit("a").alias("item"), (F.col("id") * 7).alias("user_id"))
    bitmaps = audiences.audience_bitmaps(df, audiences.user_numbers(df))
    assert bitmaps.count() == 4 and rows(audiences.audience_sizes(bitmaps)) == [("a", 100_000)]


@pytest.mark.parametrize("th", [1, 20, 500])
def test_items_at_least_equals_the_plain_job(table, th):
    df = table(edges(), SCHEMA)
    named = df.where("item IS NOT NULL AND user_id IS NOT NULL").select("item", "user_id")
    want = rows(item_sets.at_least(named, "item", th), "item", "user_id", "n")
    assert rows(audiences.items_at_least(df, audiences.user_numbers(df), th), "item", "user_id", "n") == want
    reach = item_sets.may_reach(named, "item", th)
    assert rows(item_sets.at_least(reach, "item", th), "item", "user_id", "n") == want


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_no_item_is_lost_whatever_shares_its_cell(table, cells):
    named = table(edges(), SCHEMA).where("user_id IS NOT NULL").select("item", "user_id")
    kept = {r.item for r in item_sets.may_reach(named, "item", 20, cells).collect()}
    assert kept >= {item for item, users in brute(edges()).items() if len(users) >= 20}
    assert cells < 100 or not any(item.startswith("rare") for item in kept)


def test_fewer_bytes_are_shuffled(spark, conf):
    conf("spark.sql.shuffle.partitions", "4")
    i = F.col("id")
    item = F.when(i % 3 == 0, F.lit("hot")).when(i % 3 == 1, F.lit("warm")).otherwise(F.concat(F.lit("rare"), i))
    df = spark.range(0, 300_000, 1, 4).select(item.alias("item"), F.pmod(F.xxhash64(i), F.lit(20_000)).alias("user_id"))
    numbers = audiences.user_numbers(df)
    hot = df.where(~F.startswith("item", F.lit("rare")))
    plain = shuffled_bytes(spark, lambda: hot.distinct().groupBy("item").count().collect())
    bits = shuffled_bytes(spark, lambda: audiences.audience_sizes(audiences.audience_bitmaps(hot, numbers)).collect())
    assert bits < plain / 5
    whole = shuffled_bytes(spark, lambda: item_sets.at_least(df, "item", 50))
    short = shuffled_bytes(spark, lambda: item_sets.at_least(item_sets.may_reach(df, "item", 50), "item", 50))
    assert short < whole


def test_empty_tables(table):
    none = table([], SCHEMA)
    numbers = audiences.user_numbers(none)
    assert numbers.count() == 0
    assert audiences.items_at_least(none, numbers, 1).count() == 0
    assert item_sets.may_reach(none, "item", 1).count() == 0
