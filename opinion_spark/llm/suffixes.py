"""Removal of substrings that an earlier document has, by sorting sampled suffixes.

Every string of ``LENGTH`` bytes is looked at, but not every suffix is sorted. As in induced sorting,
only suffixes at local minima are: of the ``KEY``-byte starts inside a string the one with the
smallest hash is its anchor, and equal strings have their anchors at the same place. The strings
with one anchor follow each other and form a run.

1. One tuple per run, (hash of the anchor's key, hash of the whole run, document, place), is sorted
   externally: an exchange by key, then Spark's spilling sort. In that order neighbours share their
   key or the whole run, which are the common prefixes that count.
2. A run that an earlier document has as a whole is settled for all its strings.
3. Where runs share their key but not the rest, the strings of the run are induced: each gets its
   own hash and they are sorted in turn. Those are mostly the ends of repeated passages.

No task holds more than a batch of rows and one document. Keys with very many runs are found in a
sample and spread; their runs go to step 3, so that nothing depends on the sample but the layout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinion_spark.llm.decontaminate import joined
from opinion_spark.llm.tables import documents, release
from opinion_spark.llm.words import BYTE_HASH, mix, powers_to, texts
from opinion_spark.staging import drop_staged, stage, staged_lookup

LENGTH, KEY = 50, 20
#: One document in so many is looked at for keys with very many runs; most keys that are spread.
SAMPLE, MOST_HOT, HOT_RUNS, SALTS = 64, 10_000, 50, 64
#: Rows of one key that are held before the rest of them is judged apart.
HELD = 200_000

# A place: 19 bits of the text's hash, 36 of the first byte, 7 of the number of strings, 1 if spread.
TAG, START, COUNT = 44, 8, 1


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def text_tag(text: bytes) -> int:
    """Tells texts apart that share an id."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=3).digest(), "big") >> 5


def runs(data: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, ...]:
    """``(key hash, run hash, first string, number of strings)`` of a text of ``length`` bytes or more."""
    sums, inverse = _sums(data)
    h = mix((sums[key:] - sums[:-key]) * inverse[: len(data) - key + 1])
    # the place inside the window rides in the low bits, so that the first of equal keys wins
    least, span, width = h & ~np.uint64(127), 1, length - key + 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:] + np.uint64(step))
        span += step
    anchor = np.arange(len(least)) + (least & np.uint64(127)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(first[1:], len(anchor)) - 1
    at = anchor[first]
    shape = ((at - first) * 128 + (last - first)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = mix((sums[last + length] - sums[first]) * inverse[first] + shape)
    return h[at], whole, first, last - first + 1


ROW = "g bigint, c bigint, doc bigint, at bigint"


def _rows(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    joined_columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in joined_columns], names)


def _named(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc"), F.col(text).alias("text")
    )


def _tuples(named: DataFrame, hot: np.ndarray) -> DataFrame:
    """One row per run; keys in the sorted array ``hot`` are spread by their run and document."""
    shared = named.sparkSession.sparkContext.broadcast(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for doc, value in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                    if len(value) < LENGTH:
                        continue
                    g, c, first, count = runs(np.frombuffer(value, np.uint8))
                    place = (text_tag(value) << TAG) + (first << START) + (count << COUNT)
                    if len(hot):
                        k = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
                        spread = hot[k] == g
                        salt = (c + mix(np.full(1, doc, np.int64).view(np.uint64))) % np.uint64(SALTS)
                        g = np.where(spread, mix(g + salt + np.uint64(1)), g)
                        place = place + spread
                    for column, values in zip(out, (g, c, np.full(len(g), doc, np.int64), place), strict=True):
                        column.append(values)
                yield _rows(out, ["g", "c", "doc", "at"])

    return named.mapInArrow(cut, ROW)


def _hot_keys(named: DataFrame) -> np.ndarray:
    """Keys that many runs of the sampled documents have; only the layout depends on them."""
    some = named.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    frequent = (
        _tuples(some, np.zeros(0, np.uint64))
        .groupBy("g")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= HOT_RUNS)
        .orderBy(F.desc("n"), "g")
        .limit(MOST_HOT)
        .collect()
    )
    return np.sort(np.array([r["g"] for r in frequent], np.int64).view(np.uint64))


FOUND = "doc bigint, at bigint, settled boolean"


def _judge(rows: tuple[np.ndarray, ...], forced: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, at, settled)`` of whole groups in the order of key, run and document.

    A run that a smaller document has before it is settled. The others are open if the key has
    different runs in different documents, was spread, or is the ``forced`` one.
    """
    g, c, doc, at = rows
    new_key = np.append(True, g[1:] != g[:-1])
    new_run = new_key | np.append(True, c[1:] != c[:-1])
    key_start, run_start = np.flatnonzero(new_key), np.flatnonzero(new_run)
    settled = doc > doc[run_start][np.cumsum(new_run) - 1]
    differs = np.add.reduceat(new_run.astype(np.int64), key_start) > 1
    differs &= np.minimum.reduceat(doc, key_start) < np.maximum.reduceat(doc, key_start)
    if forced is not None:
        differs |= g[key_start] == forced
    is_open = (differs[np.cumsum(new_key) - 1] | (at & 1 == 1)) & ~settled
    keep = settled | is_open
    return doc[keep], at[keep], settled[keep]


def _settle(tuples: DataFrame) -> DataFrame:
    """Rows of ``_judge`` from all tuples."""
    ordered = tuples.repartition("g").sortWithinPartitions("g", "c", "doc")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, forced = None, None

        def judged(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in _judge(rows, forced)], ["doc", "at", "settled"]
            )

        for batch in batches:
            rows = tuple(np.asarray(c) for c in batch.columns)
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            if not len(rows[0]):
                continue
            end = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            if end:
                yield judged(tuple(x[:end] for x in rows))
                forced = None if rows[0][-1] != forced else forced
            held = tuple(x[end:] for x in rows)
            if len(held[0]) > HELD:
                forced = int(held[0][0])
                yield judged(held)
                held = None
        if held is not None and len(held[0]):
            yield judged(held)

    return ordered.mapInArrow(walk, FOUND)


STRING = "h bigint, doc bigint, at bigint"


def _strings(named: DataFrame, open_runs: DataFrame) -> DataFrame:
    """``(h, doc, at)``: every string of the open runs, ``at`` with a count of one."""
    places = staged_lookup(open_runs.groupBy("doc").agg(F.collect_list("at").alias("at")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                out: list[list[np.ndarray]] = [[], [], []]
                for doc, value, at in zip(
                    part.column(0).to_pylist(),
                    texts(part.column(1)),
                    part.column(2).to_pylist(),
                    strict=True,
                ):
                    tag = text_tag(value)
                    first, count = _places(np.array(at, np.int64), tag)
                    if not len(first):
                        continue
                    p = np.unique(np.repeat(first, count) + _within(count))
                    sums, inverse = _sums(np.frombuffer(value, np.uint8))
                    out[0].append(mix((sums[p + LENGTH] - sums[p]) * inverse[p]))
                    out[1].append(np.full(len(p), doc, np.int64))
                    out[2].append((tag << TAG) + (p << START) + (1 << COUNT))
                yield _rows(out, ["h", "doc", "at"])

    return named.join(places, "doc").select("doc", "text", "at").mapInArrow(cut, STRING)


def _within(count: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of ``count``."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _places(at: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and number of strings of the places in the text with ``tag``."""
    own = at[(at >> TAG) == tag]
    return (own >> START) & ((1 << (TAG - START)) - 1), (own >> COUNT) & 127


REPEAT = "h bigint, doc bigint, at bigint, sure boolean"


def _repeated(strings: DataFrame) -> DataFrame:
    """``(doc, at)`` of the strings that a smaller document has.

    Strings are dealt by range of hash and document, so that one string can fill many partitions.
    What a task cannot know, whether its first string began in an earlier range, is left to a
    second look at the first and last strings of the ranges.
    """
    ordered = strings.repartitionByRange("h", "doc").sortWithinPartitions("h", "doc")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, run, least = None, None, None  # first hash here; current hash and its least document
        last: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            h, doc, at = (np.asarray(c) for c in batch.columns)
            if not len(h):
                continue
            first = int(h[0]) if first is None else first
            new = np.append(int(h[0]) != run, h[1:] != h[:-1])
            lead = np.where(new, np.arange(len(h)), -1)
            lead = np.maximum.accumulate(lead)
            own = np.where(lead >= 0, doc[np.maximum(lead, 0)], 0 if least is None else least)
            later = doc > own
            unsure = ~later & (h == first)
            out = later | unsure
            run, least = int(h[-1]), int(own[-1])
            yield _repeats(h[out], doc[out], at[out], later[out])
            tail = ~later & (h == run)
            if run != first and tail.any():
                last = tuple(x[tail][:1] for x in (h, doc, at))
        if last is not None and int(last[0][0]) == run:
            # not a repeat by itself, but what the next range must know of
            yield _repeats(*last, np.zeros(1, bool))

    found = stage(ordered.mapInArrow(walk, REPEAT), "repeated")
    unsure = found.where("NOT sure")
    least = unsure.groupBy("h").agg(F.min("doc").alias("least"))
    settled = unsure.join(least, "h").where("doc > least")
    return found.where("sure").select("doc", "at").unionByName(settled.select("doc", "at"))


def _repeats(h: np.ndarray, doc: np.ndarray, at: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(doc), pa.array(at), pa.array(sure)], ["h", "doc", "at", "sure"]
    )


def without_repeats(
    docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``_kept`` (bytes left), ``_n_bytes``, ``_runs`` (removed).

    A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id.
    Null texts are empty; texts shorter than ``LENGTH`` and rows without id stay whole and remove
    nothing. Rows that share an id are judged apart and do not remove from each other. Strings are
    told apart by 64-bit hashes. ``_runs`` are pairs of 64-bit start and end.
    """
    named = _named(docs, id_col, text)
    spark = docs.sparkSession
    hot = _hot_keys(named)
    judged = stage(_settle(_tuples(named, hot)), "judged")
    release(spark)
    repeats = _repeated(_strings(named, judged.where("NOT settled").select("doc", "at")))
    places = repeats.unionByName(judged.where("settled").select("doc", "at"))
    removed = staged_lookup(places.groupBy("doc").agg(F.collect_list("at").alias("_at")))
    drop_staged(judged)
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            n_bytes, kept, gone = [], [], []
            for value, at in zip(
                texts(batch.column(names.index(text))),
                batch.column(names.index("_at")).to_pylist(),
                strict=True,
            ):
                first, count = _places(np.array(at or [], np.int64), text_tag(value))
                spans = joined(np.stack([first, first + count + LENGTH - 1], axis=1))
                stay = np.ones(len(value) + 1, np.int64)
                edges = np.zeros(len(value) + 1, np.int64)
                edges[spans[:, 0]] += 1
                edges[spans[:, 1]] -= 1
                stay = np.cumsum(edges)[:-1] == 0
                n_bytes.append(len(value))
                kept.append(np.frombuffer(value, np.uint8)[stay].tobytes())
                gone.append(spans.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in keep]
                + [pa.array(n_bytes, pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, pa.binary())],
                [*keep, "_n_bytes", "_kept", "_runs"],
            )

    fields = [docs.schema[c] for c in keep]
    added = [
        T.StructField("_n_bytes", T.LongType()),
        T.StructField("_kept", T.BinaryType()),
        T.StructField("_runs", T.BinaryType()),
    ]
    columns = dict.fromkeys([*keep, text])
    return (
        docs.withColumn("_doc", F.col(id_col).cast("bigint"))
        .join(removed.withColumnRenamed("doc", "_doc"), "_doc", "left")
        .select(*columns, "_at")
        .mapInArrow(cut, T.StructType(fields + added))
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(documents(spark, sf_dir), ["doc_id"])
    return cut.select(
        "doc_id",
        F.col("_n_bytes").alias("n_bytes"),
        (F.col("_n_bytes") - F.octet_length("_kept")).alias("n_removed"),
        (F.octet_length("_runs") / F.lit(16)).cast("bigint").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )
