"""Mixing sources to target weights, cut at each source's exact word budget.

Rows get a hash-random key, are range-sorted within their source, and a distributed prefix sum of
their sizes says where the budget of the source ends. A source whose budget exceeds its size is
repeated in whole epochs first. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinion_spark.llm.tables import documents
from opinion_spark.staging import stage, staged_lookup

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def words(text: str = "text") -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(id_col: str) -> Column:
    """A key in hash order, the same in every run; null ids share one."""
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``(source, source_size, target)`` from one row ``(source, source_size)`` per source.

    All sizes together are shared by weight. A target stops at ``max_epochs`` times its source's
    size and the excess is reshared by weight among the others, until none is above: that is one
    level ``l`` with ``target = min(weight * l, cap)``. Sources that fill up have the smallest
    cap per weight, so a running sum in that order finds them. The windows are over one row per
    source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    weighed = sizes.withColumn("weight", weight.cast("bigint")).withColumn(
        "cap", F.col("source_size") * max_epochs
    )
    ratio = F.col("cap").cast("double") / F.col("weight")
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    sums = (
        weighed.withColumn("ratio", ratio)
        .withColumn("caps", F.sum("cap").over(upto))
        .withColumn("filled", F.sum("weight").over(upto))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weights", F.sum("weight").over(everything))
    )
    at_ratio = F.col("caps").cast("double") + F.col("ratio") * (F.col("all_weights") - F.col("filled"))
    full = at_ratio <= F.col("total").cast("double")
    sums = (
        sums.withColumn("full", full)
        .withColumn("caps", F.max(F.when(F.col("full"), F.col("caps"))).over(everything))
        .withColumn("filled", F.max(F.when(F.col("full"), F.col("filled"))).over(everything))
    )
    caps, filled = F.coalesce("caps", F.lit(0)), F.coalesce("filled", F.lit(0))
    free = F.nullif(F.col("all_weights") - filled, F.lit(0))
    level = (F.col("total") - caps).cast("double") / free
    cap = F.col("cap").cast("double")
    share = F.least(F.col("weight") * level, cap)
    return sums.select(
        "source", "source_size", F.when(F.col("full"), cap).otherwise(share).alias("target")
    )


def prefix_sums(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` ahead of the row within its ``group``.

    Rows are dealt out by range of ``(group, *order)``, so a large group is spread over many
    partitions. Sums per partition and group give each partition its offset; only the rows of one
    partition and group are sorted together.
    """
    ranged = stage(
        rows.repartitionByRange(F.col(group).asc_nulls_last(), *order).withColumn(
            "part", F.spark_partition_id()
        ),
        "ranged",
    )
    sums = ranged.groupBy(group, "part").agg(F.sum(value).alias("sum"))
    ahead = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = staged_lookup(
        sums.select(
            F.col(group).alias("_group"),
            F.col("part").alias("_part"),
            F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("offset"),
        )
    )
    inside = W.partitionBy("part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part"))
    return (
        summed.join(offsets, same)
        .withColumn("before", F.col("offset") + F.col("inside"))
        .drop("_group", "_part", "offset", "inside", "part")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """``(<id_col>, source, size, source_size, target, taken)``, one row per row of ``docs``.

    ``taken`` counts the words the mix takes of the row, repeats included; the row at the end of a
    budget is taken in part. Null and empty texts have size 0 and give nothing; rows without a
    source form a source of their own, weighed last; null ids share a key and repeated rows are
    told apart by size alone, rows equal in both are interchangeable. Other columns are ignored.
    """
    sized = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source).alias("source"),
            words(text).alias("size"),
            random_key(id_col).alias("key"),
        ),
        "sized",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = staged_lookup(targets(sizes, weights, max_epochs))
    placed = prefix_sums(sized, "source", ["key", "id", "size"], "size")
    budgets = budgets.withColumnRenamed("source", "_source")
    joined = placed.join(budgets, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.round("target").cast("bigint")
    epochs = F.coalesce(F.floor(budget / F.nullif("source_size", F.lit(0))), F.lit(0))
    rest = budget - epochs * F.col("source_size")
    partial = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return joined.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        F.coalesce("target", F.lit(0.0)).alias("target"),
        (epochs * F.col("size") + partial).cast("bigint").alias("taken"),
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def mixing_sql(docs: str) -> str:
    """The query over a table with ``doc_id``, ``text`` and ``source``, in SQL."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM {docs}
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
    source_size * 3 AS cap FROM sizes
), sums AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio, sum(source_size) OVER () AS total,
    sum(weight) OVER () AS all_weights FROM weighed
), running AS (
  SELECT *,
    sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS caps,
    sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS filled
  FROM sums
), marked AS (
  SELECT *, CAST(caps AS DOUBLE) + ratio * (all_weights - filled) <= CAST(total AS DOUBLE) AS is_full
  FROM running
), levels AS (
  SELECT *, coalesce(max(CASE WHEN is_full THEN caps END) OVER (), 0) AS full_caps,
    coalesce(max(CASE WHEN is_full THEN filled END) OVER (), 0) AS full_weights
  FROM marked
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE least(
    weight * (CAST(total - full_caps AS DOUBLE) / nullif(all_weights - full_weights, 0)),
    CAST(cap AS DOUBLE)) END AS target
  FROM levels
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
), budgets AS (
  SELECT p.doc_id, p.source, p.size, t.source_size, coalesce(t.target, 0.0) AS target, p.before,
    CAST(round(t.target) AS BIGINT) AS budget,
    coalesce(CAST(round(t.target) AS BIGINT) // nullif(t.source_size, 0), 0) AS epochs
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + least(
  greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) AS taken
FROM budgets"""
