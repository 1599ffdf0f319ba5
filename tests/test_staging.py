"""Tables between steps leave nothing behind but themselves."""

from pyspark.sql import functions as F

from opinion_spark.staging import FREE_SHUFFLES, stage


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return set(f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f)


def test_shuffles_of_a_staged_table_are_deleted(spark):
    before = shuffle_files(spark)
    grouped = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count(), "grouped")
    joined = stage(spark.range(7).withColumnRenamed("id", "x").join(grouped.hint("merge"), "x"), "joined")
    assert sorted(tuple(r) for r in joined.collect()) == [(x, 1000 // 7 + (x < 1000 % 7)) for x in range(7)]
    assert not shuffle_files(spark) - before


def test_setting_of_the_session_stays(spark, conf):
    for value in ("true", "false"):
        conf(FREE_SHUFFLES, value)
        stage(spark.range(3), "three")
        assert spark.conf.get(FREE_SHUFFLES) == value
