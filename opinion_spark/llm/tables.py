"""The driver tables as the operators take them."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def release(spark: SparkSession) -> None:
    """Free the shuffle files of jobs that are over.

    Spark deletes them once the driver's JVM collects the plans that named them, which can take
    longer than the disk lasts. The first round lets go of the plans, the second of their shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
