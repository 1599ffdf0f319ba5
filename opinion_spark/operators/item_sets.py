"""Items and the users around them.

The working form is long, one ``(item, member)`` row each, so no step depends on how many members
an item has. ``pack`` makes lists from it for sinks and for readers that expect lists. A list too
large for one row is split by a hash of the member into parts; an item below the limit has the one
part 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.staging import stage, staged_lookup

PART_BYTES = 32 << 20
ID_BYTES = 8


def at_least(edges: DataFrame, item: str, th: int) -> DataFrame:
    """Distinct ``edges`` of items with ``th`` or more members, with their number as ``n``.

    The members are counted with a map-side combine and only the counts meet the edges again. The
    result is written, so that a later step by the same key gets a shuffle of its own and a hot
    item stays split here.
    """
    distinct = stage(edges.distinct(), "edges")
    sizes = distinct.groupBy(item).agg(F.count("*").alias("n")).where(F.col("n") >= th)
    return stage(distinct.join(staged_lookup(sizes), item), "kept")


#: Cells of the counters that ``may_reach`` broadcasts at most, 16 bytes each.
CELLS = 1 << 20


def may_reach(edges: DataFrame, item: str, th: int, cells: int = CELLS) -> DataFrame:
    """``edges`` without those of items that cannot have ``th`` members.

    Rows are counted by a hash of the item into a fixed number of cells, before any pair is shuffled.
    A cell counts every row of its items, so one below ``th`` holds no item to keep; no other item is lost.
    Of long tails of rare items little is left to make distinct. Null items are left out.
    """
    cell = F.pmod(F.xxhash64(item), F.lit(cells))
    counted = edges.where(F.col(item).isNotNull()).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    full = stage(counted.where(F.col("n") >= th).select("cell"), "cells")  # at most ``cells`` rows
    return edges.withColumn("cell", cell).join(F.broadcast(full), "cell", "left_semi").drop("cell")


def among(rows: DataFrame, wanted: DataFrame, item: str, cells: int = CELLS) -> DataFrame:
    """``rows`` whose item may be in ``wanted``, before any row is shuffled: every wanted item stays, and of the others
    those that share a cell with one, as in ``may_reach``."""
    cell = F.pmod(F.xxhash64(item), F.lit(cells)).alias("cell")
    full = stage(wanted.where(F.col(item).isNotNull()).select(cell).distinct(), "cells")  # at most ``cells`` rows
    return rows.withColumn("cell", cell).join(F.broadcast(full), "cell", "left_semi").drop("cell")


def pack(
    edges: DataFrame,
    key: str,
    value: str,
    name: str,
    part_bytes: int = PART_BYTES,
    unique: bool = False,
) -> DataFrame:
    """``(key, n, part, name)``: the values of a key as sorted lists of bounded size.

    ``n`` is the size of the whole list. Repeated values stay in the list: they are counted
    before the shuffle, and very frequent ones are cut into runs so that they spread as well.
    ``unique`` says that no value repeats under its key. Unique ids that already come with ``n``
    are packed in one shuffle.
    """
    is_id = dict(edges.dtypes)[value] != "string"
    width = (F.lit(ID_BYTES) if is_id else F.octet_length(value)).cast("bigint")
    if unique and is_id and "n" in edges.columns:
        parts = F.ceil(F.col("n") * width / part_bytes)
        spread = edges.select(
            key, "n", value, F.pmod(F.xxhash64(value), parts).cast("int").alias("part")
        )
        collected = F.collect_list(value)
    else:
        spread = _runs(edges, key, value, width, part_bytes, unique)
        collected = F.flatten(F.collect_list(F.array_repeat(value, F.col("repeats"))))
    # The join before may have placed the rows by key alone, so place them by part first.
    placed = spread.repartition(key, "part")
    lists = placed.groupBy(key, "n", "part").agg(collected.alias(name))
    return lists.select(key, "n", "part", F.sort_array(name).alias(name))


def _runs(edges, key, value, width, part_bytes, unique) -> DataFrame:
    """``(key, n, part, value, repeats)`` with no more repeats in a row than fit one part."""
    if unique:
        counted = edges.select(key, value, F.lit(1).cast("bigint").alias("times"))
    else:
        counted = edges.groupBy(key, value).agg(F.count("*").alias("times"))
    counted = stage(counted, "counted")
    sizes = counted.groupBy(key).agg(
        F.sum("times").alias("n"),
        F.ceil(F.sum(F.col("times") * width) / part_bytes).alias("parts"),
    )
    length = F.greatest(F.lit(1), F.floor(F.lit(part_bytes) / F.greatest(width, F.lit(1))))
    runs = F.sequence(F.lit(1), F.ceil(F.col("times") / length))
    rest = F.col("times") - (F.col("run") - 1) * length
    part = F.pmod(F.xxhash64(value, "run"), F.greatest(F.col("parts"), F.lit(1)))
    return (
        counted.join(staged_lookup(sizes), key)
        .withColumn("run", F.explode(runs))
        .select(
            key,
            "n",
            part.cast("int").alias("part"),
            value,
            F.least(length, rest).cast("int").alias("repeats"),
        )
    )


def unpack(sets: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """The long form of packed lists."""
    return sets.select(key, F.explode(name).alias(value))


def item_sets(
    edges: DataFrame, drop_quoted: bool = False, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Users per item, repeats kept; ``drop_quoted`` leaves out items that start with a quote."""
    rows = edges.where(F.col("item").isNotNull() & F.col("user_id").isNotNull())
    if drop_quoted:
        rows = rows.where(~F.startswith("item", F.lit('"')))
    return pack(rows.select("item", "user_id"), "item", "user_id", "users", part_bytes)


def threshold_item_sets(sets: DataFrame, th: int = 1) -> DataFrame:
    """Lists of items with ``th`` or more entries, all parts counted."""
    return sets.where(F.col("n") >= th)


def latest_sets(sets: DataFrame, *later: DataFrame) -> DataFrame:
    """One list per item out of several packed tables; a later table replaces whole lists."""
    for newer in later:
        sets = sets.join(newer.select("item"), "item", "left_anti").unionByName(newer)
    return sets
