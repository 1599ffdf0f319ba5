"""Benchmark decontamination by a prefix-filtered set join.

An item gives windows of consecutive words; a document is hit where a whole window occurs. To hold
a window, a document must hold the rarest of its words, so that one word is the prefix to join on:
words are ordered by how often the corpus has them, and a document looks up only the windows whose
rarest word it meets. The place of that word fixes where the window would start; it must fit into
the document (length and position bound), and then all its words are compared.

The documents never move. Items travel to them in blocks of bounded size, one pass per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinion_spark.llm.tables import documents, table
from opinion_spark.llm.words import LETTERS, texts, word_hashes
from opinion_spark.staging import drop_staged, stage

WINDOW = 13
#: Words of items that are sent to the executors at once.
BLOCK_WORDS = 500_000
#: Words in one row of an item; the next row overlaps it by a window less one word.
ROW_WORDS = 2_000


@dataclass
class Block:
    """Windows of some items, grouped by prefix word."""

    prefixes: np.ndarray  # sorted distinct prefix words
    first: np.ndarray  # their windows are first[i] .. first[i + 1]
    offset: np.ndarray  # place of the prefix word in the window
    length: np.ndarray
    words: np.ndarray  # one row per window, padded with 0
    item: np.ndarray
    names: list[str]


def _item_rows(items: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    """``(item, words)``: bounded stretches of each item; items without id or words have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words = [], []
            for name, value in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                h = word_hashes(value, LETTERS)
                for start in range(0, max(1, len(h) - window + 1), ROW_WORDS):
                    part = h[start : start + ROW_WORDS + window - 1]
                    if len(part):
                        names.append(name)
                        words.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(words, pa.binary())], ["item", "words"]
            )

    named = items.where(F.col(id_col).isNotNull())
    return named.select(F.col(id_col).cast("string").alias("item"), text).mapInArrow(
        cut, "item string, words binary"
    )


def _windows(rows: list, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """``(words, length, item, names)`` of all windows of a block."""
    names = sorted({r["item"] for r in rows})
    code = {name: i for i, name in enumerate(names)}
    words, lengths, items = [np.zeros((0, window), np.uint64)], [], []
    for r in rows:
        h = np.frombuffer(r["words"], np.uint64)
        if len(h) < window:
            padded = np.zeros((1, window), np.uint64)
            padded[0, : len(h)] = h
            words.append(padded)
        else:
            words.append(np.lib.stride_tricks.sliding_window_view(h, window))
        lengths += [min(len(h), window)] * len(words[-1])
        items += [code[r["item"]]] * len(words[-1])
    return np.concatenate(words), np.array(lengths, np.int64), np.array(items, np.int64), names


def _counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often the documents have each word of the sorted ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for value in texts(batch.column(0)):
                code, known = _lookup(words, word_hashes(value, LETTERS))
                total += np.bincount(code[known], minlength=len(words))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    if not len(vocabulary):
        return np.zeros(0, np.int64)
    rows = (
        docs.select(text)
        .mapInArrow(count, "code bigint, n bigint")
        .groupBy("code")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most one row per word of the block
    )
    counts = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        counts[r["code"]] = r["n"]
    return counts


def _lookup(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted non-empty array, and whether it is there."""
    code = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return code, ordered[code] == values


def _block(docs: DataFrame, text: str, rows: list, window: int) -> Block:
    words, length, item, names = _windows(rows, window)
    inside = np.arange(window) < length[:, None]
    vocabulary = np.unique(words[inside])
    counts = _counts(docs, text, vocabulary)
    rarity = np.where(inside, np.iinfo(np.int64).max - 1, np.iinfo(np.int64).max)
    rarity[inside] = counts[np.searchsorted(vocabulary, words[inside])]
    offset = rarity.argmin(axis=1) if len(words) else np.zeros(0, np.int64)
    prefix = words[np.arange(len(words)), offset]
    order = np.argsort(prefix, kind="stable")
    prefixes, first = np.unique(prefix[order], return_index=True)
    return Block(
        prefixes,
        np.append(first, len(order)),
        offset[order],
        length[order],
        np.ascontiguousarray(words[order]),
        item[order],
        names,
    )


def hits(h: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """``(runs, items)`` of one document: hit words as rows of start and end, codes of the items."""
    none = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    if not len(block.prefixes) or not len(h):
        return none
    code, known = _lookup(block.prefixes, h)
    place = np.flatnonzero(known)
    if not len(place):
        return none
    low, high = block.first[code[place]], block.first[code[place] + 1]
    n = high - low
    place = np.repeat(place, n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    start = place - block.offset[window]
    fits = (start >= 0) & (start + block.length[window] <= len(h))
    start, window = start[fits], window[fits]
    for j in range(block.words.shape[1]):
        beyond = block.length[window] <= j
        same = beyond | (h[np.minimum(start + j, len(h) - 1)] == block.words[window, j])
        start, window = start[same], window[same]
    runs = np.stack([start, start + block.length[window]], axis=1)
    return joined(runs), np.unique(block.item[window])


def joined(runs: np.ndarray) -> np.ndarray:
    """Overlapping and adjacent runs as one."""
    if len(runs) < 2:
        return runs
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.append(True, runs[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([runs[first, 0], reach[np.append(first[1:], len(runs)) - 1]], axis=1)


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("runs", T.BinaryType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _pass(found: DataFrame, text: str, block: Block, first: bool, last: bool, keep: list[str]) -> DataFrame:
    """Adds the hits of one block to ``n_words``, ``runs`` and ``items``."""
    shared = found.sparkSession.sparkContext.broadcast(vars(block))
    kept = keep if last or text in keep else [*keep, text]
    fields = [found.schema[c] for c in kept]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(**shared.value)
        for batch in batches:
            names = batch.schema.names
            before = [(b"", [])] * batch.num_rows
            if not first:
                before = zip(
                    batch.column(names.index("_runs")).to_pylist(),
                    batch.column(names.index("_items")).to_pylist(),
                    strict=True,
                )
            n_words, n_hit, runs, items = [], [], [], []
            for value, (old_runs, old_items) in zip(
                texts(batch.column(names.index(text))), before, strict=True
            ):
                h = word_hashes(value, LETTERS)
                new_runs, codes = hits(h, block)
                old = np.frombuffer(old_runs, np.int64).reshape(-1, 2)
                n_words.append(len(h))
                all_runs = joined(np.concatenate([old, new_runs]))
                n_hit.append(int((all_runs[:, 1] - all_runs[:, 0]).sum()))
                runs.append(all_runs.tobytes())
                items.append(sorted({*old_items, *(block.names[c] for c in codes)}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in kept]
                + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
                + [pa.array(runs, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                [*kept, "_n_words", "_n_hit", "_runs", "_items"],
            )

    added = [T.StructField("_" + f.name, f.dataType) for f in FOUND]
    return found.mapInArrow(scan, T.StructType(fields + added))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The columns ``keep`` of ``docs``, with ``_n_words``, ``_n_hit`` and ``_items`` (sorted strings).

    Every row of ``docs`` gives one row. Null and empty texts have no words and no hits. An item
    shorter than the window, but not empty, is one window; items without id or text take no part;
    rows that repeat an item id add to it. Clashing names cannot occur: added columns start with
    an underscore, and ``keep`` says what else is returned.
    """
    rows = _item_rows(items, item_id, item_text, window).withColumn(
        "n", F.octet_length("words") / F.lit(8)
    )
    total = rows.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, int(-(-total // block_words)))
    block_of = F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks))
    found = docs.select(*dict.fromkeys([*keep, text]))
    passed = None
    for i in range(n_blocks):
        block = _block(docs, text, rows.where(block_of == i).collect(), window)
        found = _pass(found, text, block, i == 0, i == n_blocks - 1, keep)
        if i < n_blocks - 1:
            # one block at a time in the tasks, whatever the size of the benchmark
            found = stage(found, "passed")
            if passed is not None:
                drop_staged(passed)
            passed = found
    return found.select(*keep, "_n_words", "_n_hit", "_items")


#: A document is contaminated if at least one word in this many is hit.
ONE_IN = 20


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * ONE_IN >= n_words)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit, n_words = F.col("_n_hit"), F.col("_n_words")
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(n_hit, n_words).alias("contaminated"),
    )


def decontamination_sql(docs: str, items: str) -> str:
    """The query in SQL: the windows of the items joined with those of the documents."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH item_words AS (SELECT item_id, {words} AS w FROM {items} WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, len(w) AS n, w AS win FROM item_words WHERE len(w) BETWEEN 1 AND {WINDOW - 1}
  UNION
  SELECT DISTINCT item_id, {WINDOW} AS n, unnest(list_transform(range(1, len(w) - {WINDOW - 2}),
    lambda i: w[i:i + {WINDOW - 1}])) AS win FROM item_words WHERE len(w) >= {WINDOW}
), doc_words AS (SELECT doc_id, {words} AS w FROM {docs}),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
    unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS win
  FROM doc_words, lengths WHERE len(w) >= n
), found AS (
  SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t USING (n, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)"""
