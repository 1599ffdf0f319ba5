"""A third of all rows sit under one key; adaptive execution must be able to split it."""

import pytest
from pyspark.sql import functions as F

from opinion_spark.functions.text import text_digest
from opinion_spark.operators import item_sets, links, network, reshares
from opinion_spark.operators.opinion import user_opinion
from opinion_spark.staging import stage


@pytest.fixture
def small_partitions(conf):
    conf("spark.sql.shuffle.partitions", "64")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "32KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")


def skewed(spark, key, value, n=300_000):
    """A third of the rows have key 0, the others one of 20,000 keys; values do not repeat."""
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20_000)
    return spark.range(0, n, 1, 16).select(hot.alias(key), F.col("id").alias(value))


def plan_after_run(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), rows


def test_threshold_join_splits(spark, small_partitions, monkeypatch):
    plans = []

    def run_instead(df, name):
        if name != "kept":
            return stage(df, name)
        plans.append(plan_after_run(df.select(F.count("*").alias("n"))))
        return df

    monkeypatch.setattr(item_sets, "stage", run_instead)
    item_sets.at_least(skewed(spark, "item", "user_id"), "item", 2)
    plan, rows = plans[0]
    assert "skew=true" in plan
    assert rows[0].n == 300_000


def test_texts_of_hot_item_split(spark, small_partitions):
    edges = skewed(spark, "item", "user_id").withColumn("text", F.col("item").cast("string"))
    posts = edges.select(
        F.col("user_id").alias("tweet_id"),
        "user_id",
        F.lit(True).alias("is_retweet"),
        F.col("text").alias("retweeted_text"),
        "text",
        F.lit(0).alias("retweet_count"),
    )
    named = reshares.with_texts(reshares.retweet_edges(posts, th=2), posts)
    plan, rows = plan_after_run(named.agg(F.count("*").alias("n")))
    assert "skew=true" in plan
    assert rows[0].n == 300_000


def test_pack_splits(spark, small_partitions):
    edges = skewed(spark, "item", "user_id")
    packed = item_sets.pack(edges, "item", "user_id", "users", part_bytes=8 * 1000, unique=True)
    plan, rows = plan_after_run(packed.select("item", F.size("users").alias("s")))
    assert "skew=true" in plan
    assert sum(r.s for r in rows) == 300_000
    assert max(r.s for r in rows) < 2000


def test_followee_lookup_splits(spark, small_partitions):
    follows = skewed(spark, "followee", "user_id")
    listed = spark.range(0, 300_000, 1, 4).select(
        F.col("id").alias("user_id"), F.lit(1).alias("value")
    )
    rates = network.vocal_rate(follows, listed).agg(F.sum("vocal_rate").alias("s"))
    plan, rows = plan_after_run(rates)
    assert "skew=true" in plan
    assert rows[0].s == 300_000


def test_opinion_lookup_splits(spark, small_partitions):
    item = text_digest(F.col("item").cast("string"))
    items = skewed(spark, "item", "user_id").withColumn("item", item)
    opinions = spark.range(0, 20_000).select(
        F.col("id").cast("string").alias("rt"), F.lit(1).alias("opinion")
    )
    votes = user_opinion(items, opinions).agg(F.count("*").alias("n"))
    plan, rows = plan_after_run(votes)
    assert "skew=true" in plan
    assert rows[0].n == 300_000


def test_popular_link_splits(spark, small_partitions):
    url = F.concat(F.lit("http://x/"), F.col("item"))
    entity = F.struct(url.alias("url"), F.lit(None).cast("string").alias("expanded_url"))
    posts = skewed(spark, "item", "user_id").select(
        F.col("user_id").alias("tweet_id"), "user_id", F.array(entity).alias("urls")
    )
    redirects = spark.range(1, 20_000).select(
        F.concat(F.lit("http://x/"), F.col("id")).alias("src"), F.lit("http://x/0").alias("dst")
    )
    moved = links.url_refer(posts, redirects, th=1)
    plan, rows = plan_after_run(moved.groupBy("url").count())
    assert "skew=true" in plan
    assert [(r.url, r["count"]) for r in rows] == [("http://x/0", 300_000)]
