"""Opinions of users from the opinions of the texts they reshare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.text import from_base64, one_line, text_digest, to_base64
from opinion_spark.staging import staged_lookup


def user_opinion(
    user_items: DataFrame,
    rt_opinions: DataFrame,
    key: str = "text",
    digests: bool = True,
    normalise: bool = False,
) -> DataFrame:
    """``(user_id, value)``: 0 or 1, the opinion most of a user's texts have; ties are dropped.

    ``user_items`` has one ``(user_id, item)`` row per text, the item being its digest, or its
    base64 form with ``digests=False``. The list names its texts in plain (``key="text"``) or
    base64 form. ``normalise``, for base64 items, compares texts with white space and commas as
    ``jaccard_links(..., decode=True)`` writes them. Digests meet, whole texts are not shuffled.
    """
    if key not in ("text", "base64"):
        raise ValueError("key must be 'text' or 'base64'")
    if normalise and digests:
        raise ValueError("normalise needs base64 items")
    text = F.col("rt") if key == "text" else from_base64(F.col("rt"))
    item = F.col("item")
    if normalise:
        name, item = text_digest(one_line(text)), text_digest(one_line(from_base64(item)))
    elif digests:
        name = text_digest(text)
    else:
        # Bring the short list to the form of the items rather than decode every item.
        name, item = text_digest(to_base64(text)), text_digest(item)
    opinions = (
        rt_opinions.where(F.col("opinion").isin(0, 1))
        .select(name.alias("name"), "opinion")
        .groupBy("name")
        .agg(F.max("opinion").alias("opinion"))
    )
    votes = (
        user_items.select("user_id", item.alias("name"))
        .join(staged_lookup(opinions), "name")
        .groupBy("user_id")
        .agg(
            F.count_if(F.col("opinion") == 0).alias("zeros"),
            F.count_if(F.col("opinion") == 1).alias("ones"),
        )
    )
    return votes.where("zeros <> ones").select(
        "user_id", F.when(F.col("zeros") > F.col("ones"), 0).otherwise(1).alias("value")
    )
