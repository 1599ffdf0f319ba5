"""Exact dedup with a heavy-hitter split.

Every row gets the digest of its normalised text. A Misra-Gries sketch (Spark's ``approx_top_k``
state: a bounded number of counters per task, merged in two steps) names the digests that may be
frequent. These are counted exactly; the ones that hold a stated share of all rows are the winners.
Their number is bounded by that share, so they are broadcast and their copies decided map-side,
without a shuffle. All other digests are grouped by an ordinary shuffle, in which no group is larger
than the share. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinion_spark.llm.tables import documents
from opinion_spark.staging import stage

WHITE = r"[\x20\x09-\x0D]+"
#: A digest is heavy with one row in so many, so there are at most so many winners.
SHARE = 1024
#: Counters of a sketch. Its error is at most 3.5 / TRACKED of all rows, less than a half share.
TRACKED = 8192
#: Sketches of tasks are merged in so many groups before the last merge.
MERGERS = 64


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text with every stretch of ASCII white space as one space; null is empty."""
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")
    return F.sha2(normal, 256)


def _first(id_col: str = "id") -> Column:
    """The row of a group that stays: smallest id, rows without id last, one of its repeats."""
    return F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("row")))


def frequent(digests: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``(digest)``: at most ``tracked`` digests, among them all that hold 7 / ``tracked`` of the rows."""
    merger = F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("merger")
    sketches = digests.groupBy(merger).agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch"))
    # grouped by a constant, so that no row stays no row: the combination of no sketches fails
    merged = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("found"))
    return found.select(F.col("found.item").alias("digest"))


def winners(digests: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """``(digest, size, first)``: the digests with at least one row in ``share``, counted exactly.

    At most ``share`` rows, and ``tracked`` candidates before.
    """
    total = digests.count()
    named = stage(frequent(digests.select("digest"), tracked), "frequent")
    counted = (
        digests.join(F.broadcast(named), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("size"), _first().alias("first"))
    )
    return stage(counted.where(F.col("size") * share >= total), "winners")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
    share: int = SHARE,
    tracked: int = TRACKED,
) -> DataFrame:
    """``(<id_col>, keep_id, group_size, kept, text_sha256)`` and ``row`` with the columns ``carry``,
    one row per row of ``docs``.

    Texts are equal if they differ in ASCII white space between words alone, null and empty ones
    included. The row with the smallest id stays, one of them if it is repeated; rows without id
    stay only where no row of their group has one, and then ``keep_id`` is null. Other columns are
    ignored; carried ones may have any name. An empty table gives no rows.
    """
    carried = [F.col(c) for c in carry]
    digests = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        text_digest(text).alias("digest"),
        *([F.struct(*carried).alias("carried")] if carried else []),
    )
    digests = stage(digests, "digests")
    heavy = winners(digests, share, tracked)
    same = W.partitionBy("digest")
    light = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    light = light.withColumn("size", F.count("*").over(same)).withColumn("first", _first().over(same))
    decided = digests.join(F.broadcast(heavy), "digest").unionByName(light)
    return decided.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        *([F.col("carried").alias("row")] if carried else []),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return exact_dedup(docs, id_col, text, docs.columns).where("kept").select("row.*")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def exact_dedup_sql(docs: str) -> str:
    """The query over a table with ``doc_id`` and ``text``, in SQL."""
    return f"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM {docs}
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM digests"""
