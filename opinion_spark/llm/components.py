"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.staging import drop_staged, stage, staged_lookup


#: Edges that one task writes, about; fewer, larger files where the graph is small.
TASK_EDGES = 200_000


def _smallest(pairs: DataFrame, tasks: int) -> DataFrame:
    """``(u, m)``: the smallest neighbour of each node, written so that a hot node can be split."""
    return staged_lookup(pairs.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each neighbour above a node is tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both, tasks)
    starred = both.where("v > u").join(least, "u")
    tied = stage(
        starred.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .where("u <> v")
        .distinct()
        .coalesce(tasks),
        "star",
    )
    drop_staged(least)
    return tied


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them; edges have u > v."""
    least = _smallest(edges, tasks)
    own = least.select("u", F.col("m").alias("v"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    tied = stage(own.unionByName(others).distinct().coalesce(tasks), "star")
    drop_staged(least)
    return tied


def _settled(edges: DataFrame) -> bool:
    """Whether all edges ``(u, v)`` lead to a node that leads nowhere, and only to one."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("to"))
    )
    seen = ends.groupBy("node").agg(
        F.min("to").alias("low"), F.max("to").alias("high"), F.count(F.lit(1)).alias("n"), F.count("to").alias("out")
    )
    return seen.where("low < high OR (out > 0 AND n > out)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` ``(a, b)``; the smallest node names it.

    Large and small stars alternate until every node hangs on the smallest one, a number of rounds
    logarithmic in the size of the largest component. All state is in tables; only whether it is
    over reaches the driver. Null ends and loops are ignored, repeated edges count once.
    """
    a, b = F.col("a"), F.col("b")
    ends = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = stage(ends, "star")
    # neither star adds edges
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, now.count() // TASK_EDGES + 1)
    while not _settled(now):
        large = _large_star(now, tasks)
        small = _small_star(large, tasks)
        drop_staged(now, large)
        now = small
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    hung = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hung.unionByName(roots).distinct()
