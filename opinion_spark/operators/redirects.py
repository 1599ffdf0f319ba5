"""Short URLs to the pages they lead to, from a ``(src, dst)`` table of observed redirects.

The table is joined with itself, which doubles the hops it spans each time. Only chains that go on are
joined again; those that have ended leave, and the rounds are over when all have. The URLs are joined once, with the
table that spans all hops. Many URLs may lead to one page; that skew is on the left of a left join, where
adaptive execution splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.urls import is_malformed
from opinion_spark.staging import staged_lookup

MAX_HOPS = 10


def redirect_table(redirects: DataFrame) -> DataFrame:
    """One target per source; of several the greatest stays."""
    return (
        redirects.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        .groupBy("src")
        .agg(F.max("dst").alias("dst"))
    )


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Where ``first`` leads if ``second`` follows. Chains that have ended take no part in the join."""
    further = second.select(F.col("_src").alias("_at"), F.col("_dst").alias("_next"), F.col("_on").alias("_more"))
    moved = first.where("_on").join(further, F.col("_dst") == F.col("_at"))
    moved = moved.select("_src", F.col("_next").alias("_dst"), F.col("_more").alias("_on"))
    return staged_lookup(first.where("NOT _on").unionByName(moved))


def _after(table: DataFrame, hops: int) -> DataFrame:
    """``(_src, _dst, _on)`` after ``hops`` hops, by doubling, until every chain has ended."""
    if hops < 1:
        return table.select("_src", F.col("_src").alias("_dst"), F.lit(True).alias("_on"))
    reached, power = None, table
    while hops:
        if hops & 1:
            reached = power if reached is None else _then(reached, power)
        hops >>= 1
        if hops:
            if power.where("_on").isEmpty():
                return power
            power = _then(power, power)
    return reached


def resolve_redirects(
    urls: DataFrame,
    redirects: DataFrame,
    max_hops: int = MAX_HOPS,
    on_malformed: str = "drop",
    unreachable: DataFrame | None = None,
) -> DataFrame:
    """Add ``final``, the end of the redirect chain of ``url``.

    A chain may visit fewer than ``max_hops`` URLs. A longer one counts as a loop and keeps the
    start, as does a chain that meets a URL in ``unreachable``. A chain that meets a malformed URL
    is dropped, or keeps its start with ``on_malformed="keep"``.
    """
    if on_malformed not in ("drop", "keep"):
        raise ValueError("on_malformed must be 'drop' or 'keep'")
    table = redirect_table(redirects)
    if unreachable is not None:
        dead = unreachable.select(F.col("url").alias("src")).distinct()
        table = table.join(dead, "src", "left_anti").unionByName(
            dead.select("src", F.col("src").alias("dst"))
        )
    table = table.where(~is_malformed(F.col("src"))).select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
    sources = table.select(F.col("_src").alias("_dst"), F.lit(True).alias("_on"))
    table = table.join(sources, "_dst", "left").select("_src", "_dst", F.coalesce("_on", F.lit(False)).alias("_on"))
    reached = _after(staged_lookup(table), max_hops - 2)
    ends = urls.join(reached, F.col("url") == F.col("_src"), "left").withColumn(
        "final", F.coalesce("_dst", "url")
    )
    unresolved = F.coalesce("_on", F.lit(False))
    malformed = ~unresolved & is_malformed(F.col("final"))
    if on_malformed == "drop":
        ends = ends.where(~malformed)
        keep_start = unresolved
    else:
        keep_start = unresolved | malformed
    return ends.withColumn(
        "final", F.when(keep_start, F.col("url")).otherwise(F.col("final"))
    ).drop("_src", "_dst", "_on")


def expand_once(
    url_counts: DataFrame, redirects: DataFrame, unreachable: DataFrame | None = None
) -> DataFrame:
    """Counts by the target of one hop; malformed and unreachable URLs are dropped."""
    usable = url_counts.where(~is_malformed(F.col("url")))
    if unreachable is not None:
        usable = usable.join(unreachable.select("url").distinct(), "url", "left_anti")
    table = redirect_table(redirects).withColumnRenamed("src", "url")
    hop = usable.join(table, "url", "left").withColumn("url", F.coalesce("dst", "url"))
    return hop.groupBy("url").agg(F.sum("n").cast("bigint").alias("n"))
