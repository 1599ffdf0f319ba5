"""Quotation linking in conversations.

Lines that begin with ``>`` quote, as deep as they have marks. Runs of lines of one depth are passages;
passages, lines and whole messages are normalised and hashed, and what a message quotes is joined with
what messages say themselves, at every level. A message answers the earlier message of its conversation
that most of its quotes come from, those of the shallowest level of which any is found. Messages are returned without quotes, each thread together and
every answer behind what it answers. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinion_spark.llm.mixing import prefix_sums
from opinion_spark.llm.tables import table
from opinion_spark.staging import stage, staged_lookup

MARKS = r"^(?:[\x20\t]{0,3}>)+"
#: A level-0 line before a quote that only says whose it is.
ATTRIBUTION = r"(?:wrote|schrieb|escribió|écrit)\x20?:\s*$"

QUOTES = "array<struct<level:int,origin_conv:bigint,origin_turn:bigint>>"


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _lines(messages: DataFrame) -> DataFrame:
    """``(conv, turn, key, pos, level, body)``: the lines of each message."""
    split = messages.select("conv", "turn", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    return split.select(
        "conv",
        "turn",
        "key",
        "pos",
        F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
        F.regexp_replace("line", MARKS, "").alias("body"),
    )


def _passages(lines: DataFrame) -> DataFrame:
    """``lines`` with ``run``: stretches of one level between blank lines; blank lines are left out."""
    order = W.partitionBy("conv", "turn", "key").orderBy("pos")
    blank = F.trim("body") == ""
    new = (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))) | blank
    runs = lines.withColumn("new", new.cast("int"))
    return runs.withColumn("run", F.sum("new").over(order)).where(~blank).drop("new")


def _joined(lines: DataFrame, *by: str) -> DataFrame:
    """``(*by, unit)``: the bodies of each group in order, normalised."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "body")))
    grouped = lines.groupBy(*by).agg(listed.alias("bodies"))
    return grouped.select(*by, _normal(F.array_join(F.transform("bodies", lambda x: x["body"]), " ")).alias("unit"))


def _units(passages: DataFrame) -> DataFrame:
    """``(conv, turn, key, level, run, unit)``: every passage and every line."""
    by = ["conv", "turn", "key", "level", "run"]
    return _joined(passages, *by).unionByName(passages.select(*by, _normal(F.col("body")).alias("unit")))


def link_quotes(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per row of ``messages``: ``(<conv>, <turn>, <role>, own_text, n_quotes, max_level,
    quotes, origin_conv, origin_turn, reply_to, thread, depth, position)``.

    ``own_text`` has no quoted lines, nor a line that only introduces them. ``quotes`` lists the quoted
    passages in order, ``(level, origin_conv, origin_turn)`` each. The origin of a passage is the message
    most of it comes from: an earlier one of the conversation (the earliest that says so), else the
    first of all other conversations by id and turn; ties go to the later turn. ``origin`` of the
    message is found in the same way from all its quotes of the shallowest level that has an origin.
    ``reply_to`` is the origin's turn if it is in the same conversation. ``thread`` is the turn at the
    root, ``depth`` the number of answers up to it, ``position`` the place in the conversation by
    thread and turn, from 0. Null and empty texts quote nothing and are quoted by nobody; rows without
    conversation or turn are returned as they are, without links and position. Rows that repeat conversation and
    turn take neighbouring positions. Other columns are ignored.
    """
    named = messages.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("key", F.md5("text"))
    placed = named.where("conv IS NOT NULL AND turn IS NOT NULL")
    says = F.col("text").rlike("(?m)" + MARKS)
    quoting = placed.where(says).select("conv", "turn", "key", "text").distinct()
    quoted_passages = _passages(_lines(quoting))
    quotes = stage(_units(quoted_passages.where("level > 0")), "quotes")
    owns = _own_texts(quoting)
    counts = quotes.groupBy("conv", "turn", "key").agg(
        F.countDistinct("run").alias("n_quotes"), F.max("level").alias("max_level")
    )
    origins = _origins(quotes, _said(placed))
    about = staged_lookup(
        counts.join(owns, ["conv", "turn", "key"], "left").join(origins, ["conv", "turn", "key"], "left")
    )
    keyed = named.join(
        about.withColumnsRenamed({"conv": "_conv", "turn": "_turn", "key": "_key"}),
        (F.col("conv") == F.col("_conv")) & (F.col("turn") == F.col("_turn")) & (F.col("key") == F.col("_key")),
        "left",
    )
    rows = stage(
        keyed.select(
            "conv",
            "turn",
            "role",
            F.when(F.col("_key").isNull(), F.col("text")).otherwise(F.coalesce("own", F.lit(""))).alias("own_text"),
            F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"),
            F.coalesce("max_level", F.lit(0)).alias("max_level"),
            F.coalesce("quotes", F.array().cast(QUOTES)).alias("quotes"),
            "origin_conv",
            "origin_turn",
            F.when(F.col("origin_conv") == F.col("conv"), F.col("origin_turn")).alias("reply_to"),
        ),
        "messages",
    )
    return _ordered(rows).withColumnsRenamed({"conv": conv, "turn": turn, "role": role})


def _own_texts(quoting: DataFrame) -> DataFrame:
    """``(conv, turn, key, own)``: the level-0 lines of messages that quote, without introductions."""
    order = W.partitionBy("conv", "turn", "key").orderBy("pos")
    lines = _lines(quoting).withColumn("next", F.lead("level").over(order))
    introduces = (F.coalesce("next", F.lit(0)) > 0) & F.col("body").rlike(ATTRIBUTION)
    own = lines.where((F.col("level") == 0) & ~introduces)
    listed = F.array_sort(F.collect_list(F.struct("pos", "body")))
    joined = F.array_join(F.transform(listed, lambda x: x["body"]), "\n")
    own_text = F.regexp_replace(joined, r"^\s+|\s+$", "")
    return own.groupBy("conv", "turn", "key").agg(own_text.alias("own"))


def _said(placed: DataFrame) -> DataFrame:
    """``(hash, conv, turn)``: what each message says itself, as a whole, in passages and in lines."""
    # a repeated row says everything once
    rows = placed.select("conv", "turn", "key", "text").distinct()
    own = _passages(_lines(rows)).where("level = 0")
    whole = _joined(own, "conv", "turn", "key").select("conv", "turn", "unit")
    units = _units(own).select("conv", "turn", "unit").unionByName(whole)
    return units.where("unit <> ''").select(F.md5("unit").alias("hash"), "conv", "turn")


def _origins(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """``(conv, turn, key, quotes, origin_conv, origin_turn)`` of messages that quote.

    What is said is first reduced to one row per hash and conversation, and to the two smallest
    conversations per hash, so a common line meets each quote once and one of the two is not its own.
    """
    asked = quotes.where("unit <> ''").select(
        "conv", "turn", "key", "level", "run", F.md5("unit").alias("hash"), F.length("unit").alias("weight")
    )
    wanted = staged_lookup(asked.select("hash").distinct())
    found = said.join(wanted, "hash").groupBy("hash", "conv").agg(F.min("turn").alias("turn"))
    found = stage(found, "said")
    near = found.withColumnRenamed("turn", "near_turn")
    least = F.min(F.struct("conv", "turn"))
    first = staged_lookup(found.groupBy("hash").agg(least.alias("first")))
    later = found.join(first, "hash").where(F.col("conv") != F.col("first.conv"))
    second = later.groupBy("hash").agg(least.alias("second"))
    firsts = staged_lookup(first.join(second, "hash", "left"))
    met = asked.join(near, ["hash", "conv"], "left").join(firsts, "hash", "left")
    here = F.col("near_turn") < F.col("turn")
    other = F.when(F.col("first.conv") != F.col("conv"), F.col("first")).otherwise(F.col("second"))
    origin = F.when(here, F.struct(F.col("conv").alias("conv"), F.col("near_turn").alias("turn"))).otherwise(other)
    message, passage = ["conv", "turn", "key"], ["conv", "turn", "key", "level", "run"]
    votes = stage(
        met.withColumn("origin", origin)
        .where(F.col("origin").isNotNull())
        .groupBy(*passage, "origin")
        .agg(F.sum("weight").alias("weight")),
        "votes",
    )
    listed = F.struct("run", "level", "best.origin_conv", "best.origin_turn")
    passages = quotes.select(*passage).distinct().join(_best(votes, *passage), passage, "left")
    lists = passages.groupBy(*message).agg(F.array_sort(F.collect_list(listed)).alias("quotes"))
    by_level = votes.groupBy(*message, "level", "origin").agg(F.sum("weight").alias("weight"))
    shallowest = _best(by_level, *message, "level").groupBy(*message).agg(F.min_by("best", "level").alias("best"))
    return lists.join(shallowest, message, "left").select(
        *message,
        F.transform("quotes", lambda q: q.dropFields("run")).cast(QUOTES).alias("quotes"),
        "best.origin_conv",
        "best.origin_turn",
    )


def _best(votes: DataFrame, *by: str) -> DataFrame:
    """``(*by, best)``: the origin with most votes, of the own conversation if there is one."""
    near_first = (F.col("origin.conv") == F.col("conv")).cast("int")
    order = F.struct(near_first, "weight", "origin.turn", -F.col("origin.conv"))
    found = F.struct(F.col("origin.conv").alias("origin_conv"), F.col("origin.turn").alias("origin_turn"))
    return votes.groupBy(*by).agg(F.max_by(found, order).alias("best"))


def _roots(rows: DataFrame) -> DataFrame:
    """``(conv, turn, thread, depth)`` of messages that answer one.

    Each round doubles the distance looked up, so chains of n answers take log2(n) rounds. Rows that
    repeat conversation and turn share the parent that comes first.
    """
    links = rows.where("reply_to IS NOT NULL").groupBy("conv", "turn").agg(F.min("reply_to").alias("up"))
    now = stage(links.withColumn("depth", F.lit(1).cast("bigint")).withColumn("open", F.lit(True)), "threads")
    while not now.where("open").isEmpty():
        above = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        now = stage(
            now.join(above, ["conv", "up"], "left").select(
                "conv",
                "turn",
                F.coalesce("top", "up").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("top").isNotNull().alias("open"),
            ),
            "threads",
        )
    return now.select("conv", "turn", F.col("up").alias("thread"), "depth")


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``thread``, ``depth`` and ``position``."""
    threaded = rows.join(staged_lookup(_roots(rows)), ["conv", "turn"], "left")
    threaded = threaded.withColumn("thread", F.coalesce("thread", "turn")).withColumn(
        "depth", F.coalesce("depth", F.lit(0)).cast("bigint")
    )
    whole = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    one = threaded.where(whole).withColumn("one", F.lit(1).cast("bigint"))
    placed = prefix_sums(one, "conv", ["thread", "turn", "own_text", "role"], "one").drop("one")
    loose = threaded.where(~whole).withColumn("before", F.lit(None).cast("bigint"))
    return placed.unionByName(loose).withColumnRenamed("before", "position")


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))
