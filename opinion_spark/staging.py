"""Intermediate tables that several branches of one job read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Whether Spark deletes the shuffle files of a query when it ends, and not when its plan is collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a private one only on a single machine."""
    context = spark.sparkContext
    path = (
        spark.conf.get(CHECKPOINT_DIR, None)
        or context.getConf().get(CHECKPOINT_DIR)
        or context.getCheckpointDir()
    )
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="opinion-stage-")
    spark.conf.set(CHECKPOINT_DIR, path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged_lookup(df: DataFrame) -> DataFrame:
    """A table with unique keys, written once before many rows look their key up in it.

    An aggregate is already placed by its key, so a join on that key takes it without a shuffle of
    its own, and adaptive execution then cannot split a hot key on the other side. Read back, the
    table is shuffled like any other, or broadcast if its true size allows.
    """
    return stage(df, "lookup")


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def stage(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the true size. What was shuffled for it is
    deleted at once: the driver may not collect its plan before the disk is full. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _freed_shuffles(spark):
        df.write.options(**options).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def drop_staged(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote, once nothing will read them again."""
    for df in staged:
        spark, path = df.sparkSession, df._staged_path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
