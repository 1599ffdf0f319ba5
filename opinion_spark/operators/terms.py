"""Which of many terms a text holds, in one pass over the text.

The terms become an automaton over UTF-8 bytes: a dense table of next states, in which the step after a
mismatch is already worked out, and a link from every state to the longest term that ends there. Tasks
cut their texts into short stretches, as far overlapping as the longest term asks, and move all stretches
on by a byte at a time. The time depends on the texts and not on the number of terms.

Terms travel in blocks of bounded size, one pass each, so their table may have any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.staging import stage

#: Bytes of all terms of one automaton. A state has a row of at most 257 cells of four bytes.
BLOCK_BYTES = 1 << 17
#: Bytes of a stretch of text without its overlap.
STRETCH = 512
#: Bytes of text that a task looks at together.
BATCH = 1 << 22


@dataclass
class Automaton:
    """States are numbered by depth; 0 is the start."""

    classes: np.ndarray  # class of each byte; bytes in no term share class 0
    step: np.ndarray  # (states, classes): the next state
    term: np.ndarray  # the term that ends in a state, or -1
    shorter: np.ndarray  # the state of the next shorter term that ends there too, or 0
    hit: np.ndarray  # whether any term ends in a state
    longest: int

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``(text number, term number)``."""
        width = STRETCH + self.longest - 1
        data = np.frombuffer(b"\0" * width + b"".join(texts) + b"\0" * width, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = width + np.cumsum(sizes) - sizes
        pieces = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[text] + within * STRETCH
        left = (begin + sizes)[text] - start
        order = np.argsort(-left, kind="stable")
        text, start, left = text[order], start[order], left[order]
        state = np.zeros(len(start), np.int64)
        n_classes = self.step.shape[1]
        flat, hit = self.step.reshape(-1), self.hit
        seen: list[np.ndarray] = []
        going = np.searchsorted(-left, -np.arange(width), side="left")
        for i in range(width):
            n = int(going[i])
            if not n:
                break
            now = flat[state[:n] * n_classes + self.classes[data[start[:n] + i]]]
            state[:n] = now
            at = np.flatnonzero(hit[now])
            if len(at):
                seen.append(text[at] * len(hit) + now[at])
        pairs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        text, now = pairs // len(hit), pairs % len(hit)
        texts_of, terms_of = [], []
        while len(now):
            ends = self.term[now] >= 0
            texts_of.append(text[ends])
            terms_of.append(self.term[now][ends])
            more = self.shorter[now]
            text, now = text[more > 0], more[more > 0]
        if not texts_of:
            return pairs, pairs
        n_terms = int(self.term.max()) + 1
        both = np.unique(np.concatenate(texts_of) * n_terms + np.concatenate(terms_of))
        return both // n_terms, both % n_terms


def automaton(terms: list[bytes]) -> Automaton:
    """The automaton of distinct terms, none of them empty."""
    classes = np.zeros(256, np.int64)
    used = sorted(set(b"".join(terms)))
    classes[used] = np.arange(1, len(used) + 1)
    children: list[dict[int, int]] = [{}]
    depth, ends = [0], {}
    for number, term in enumerate(terms):
        at = 0
        for c in classes[np.frombuffer(term, np.uint8)].tolist():
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                depth.append(depth[at] + 1)
            at = children[at][c]
        ends[at] = number
    edges = [(p, c, child) for p, own in enumerate(children) for c, child in own.items()]
    parent, label, child = np.array(edges, np.int64).reshape(-1, 3).T
    levels = np.array(depth)[parent] if len(parent) else np.zeros(0, np.int64)
    step = np.zeros((len(children), len(used) + 1), np.int32)
    back = np.zeros(len(children), np.int64)  # where a state goes on after a mismatch
    term = np.full(len(children), -1, np.int64)
    term[list(ends)] = list(ends.values())
    shorter = np.zeros(len(children), np.int64)
    for level in range(int(levels.max()) + 1 if len(levels) else 0):
        of = levels == level
        p, c, n = parent[of], label[of], child[of]
        back[n] = step[p, c]  # what the parent's way back leads to, before the child is entered
        step[p, c] = n
        step[n] = step[back[n]]
        shorter[n] = np.where(term[back[n]] >= 0, back[n], shorter[back[n]])
    hit = (term >= 0) | (shorter > 0)
    return Automaton(classes, step, term, shorter, hit, max(map(len, terms)))


def _batches(values: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of bounded size together, with the number of the first."""
    first, size = 0, 0
    for i, value in enumerate(values):
        if i > first and size + len(value) > BATCH:
            yield first, values[first:i]
            first, size = i, 0
        size += len(value)
    if len(values) > first:
        yield first, values[first:]


def _search(texts: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """``(<key>, term)`` for the terms of one block."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)
    built: list[Automaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(automaton([t.encode() for t in shared.value]))
        names = pa.array(shared.value, pa.string())
        for batch in batches:
            values = [v or b"" for v in batch.column(1).cast(pa.binary()).to_pylist()]
            for first, part in _batches(values):
                text, term = built[0].found(part)
                keys = batch.column(0).take(pa.array(text + first))
                yield pa.RecordBatch.from_arrays([keys, names.take(pa.array(term))], [key, "term"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, "text").mapInArrow(run, f"`{key}` {kind}, term string")


def find_terms(texts: DataFrame, terms: DataFrame, key: str = "digest", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(<key>, term)``: every term of ``terms(term)`` that stands in a text of ``texts(<key>, text)``, once.

    Bytes are compared, so case counts. Null and empty terms stand in no text, null texts hold no term;
    a table of terms that repeats or is empty is fine. Texts of one key must be equal.
    """
    named = stage(terms.where("term <> ''").select("term").distinct(), "terms")
    total = named.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).head()[0]
    blocks = max(1, -(-total // block_bytes))
    block_of = F.pmod(F.xxhash64("term"), F.lit(blocks))
    found = []
    for i in range(blocks):
        # about block_bytes, whatever the size of the table
        block = sorted(r["term"] for r in named.where(block_of == i).toLocalIterator())
        if block:
            found.append(_search(texts, key, block))
            if len(found) < blocks:
                found[-1] = stage(found[-1], "found")
    if not found:
        return texts.select(key, F.lit("").alias("term")).where("false")
    return reduce(DataFrame.unionByName, found)
