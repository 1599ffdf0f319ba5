"""Toxicity by a linear-chain conditional random field.

The chain runs over the words of a sentence with two labels, inside a toxic span or not. Training
words are labelled from documents: words of clean documents are outside; a word of a toxic document
is inside if one of its features tells toxic documents from clean ones beyond chance. Features are
the word, its beginnings and its end, so inflected and unseen words are tagged too. Forward-backward
gives each word its marginal; the marginals of a document make its score, by a logistic regression
on documents that the chain did not learn from, and the words above one half its offending spans.

Learning takes a bounded sample of labelled documents; scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinion_spark.llm.tables import documents, table
from opinion_spark.llm.words import BYTE_HASH, LETTERS, lower, mix, powers_to, spans, texts

#: Most documents of one label to learn from, most bytes of one of them and of all of one label.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_TOTAL = 4_000, 50_000, 32 << 20
#: Log-likelihood ratio from which a feature marks toxic documents.
EVIDENCE = 25.0
#: Hashed features.
DIMENSIONS = 1 << 20
PREFIXES, SUFFIX = (3, 4, 5, 6), 3
#: Words of a chain; a longer sentence goes on as another chain after so many.
CHAIN = 128
#: Bytes that are looked at together.
BATCH_BYTES = 1 << 18
EPOCHS, RATE, DECAY = 4, 0.3, 1e-6
#: Least marginal that counts for a document.
DOUBT = 0.2

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Words:
    """Words of several texts: their features and the chains they form."""

    starts: np.ndarray  # byte offsets in the joined texts
    ends: np.ndarray
    doc: np.ndarray
    features: np.ndarray  # (kinds, words); 0 stands for none
    chain_starts: np.ndarray
    chain_lengths: np.ndarray


def read_words(values: list[bytes]) -> Words:
    """All words of ``values``, joined by a line break."""
    data = lower(b"\n".join(values))
    offsets = np.cumsum([0] + [len(v) + 1 for v in values])
    starts, ends = spans(data, LETTERS)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    power, inverse = powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * power[: len(data)], out=sums[1:])
    length = ends - starts

    def hashed(low: np.ndarray, high: np.ndarray, kind: int) -> np.ndarray:
        h = mix((sums[high] - sums[low]) * inverse[low] + np.uint64(kind))
        return (h % np.uint64(DIMENSIONS - 1)).astype(np.int32) + 1

    features = [hashed(starts, ends, 1)]
    for k in PREFIXES:
        h = hashed(starts, np.minimum(starts + k, ends), 10 + k)
        features.append(np.where(length > k, h, 0))
    h = hashed(np.maximum(ends - SUFFIX, starts), ends, 2)
    features.append(np.where(length > SUFFIX, h, 0))
    breaks = np.cumsum(_BREAK[data])
    sentence = breaks[starts]
    first = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])) if len(starts) else starts
    size = np.diff(np.append(first, len(starts)))
    cuts = -(-size // CHAIN)
    within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    chain_starts = np.repeat(first, cuts) + within * CHAIN
    chain_lengths = np.minimum(np.repeat(size, cuts) - within * CHAIN, CHAIN)
    return Words(starts, ends, doc, np.stack(features), chain_starts, chain_lengths)


def marginals(
    u: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 for each word, and expected transitions, by forward-backward.

    ``u`` is the log-weight of label 1 against 0. All chains advance together, longest first.
    """
    weight = np.exp(np.clip(u, -30, 30))
    e = np.exp(transitions)
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    longest = int(left[0]) if len(left) else 0
    active = [int(np.searchsorted(-left, -t, side="left")) for t in range(longest + 1)]
    ahead, behind = np.zeros(len(u)), np.zeros(len(u))  # share of label 1 in the messages
    for t in range(longest):
        place = at[: active[t]] + t
        if t:
            one = ahead[place - 1]
            zero = 1 - one
            a0, a1 = zero * e[0, 0] + one * e[1, 0], zero * e[0, 1] + one * e[1, 1]
        else:
            a0 = a1 = np.ones(len(place))
        a1 = a1 * weight[place]
        ahead[place] = a1 / (a0 + a1)
    expected = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        place = at[: active[t]] + t
        back = np.full(len(place), 0.5)
        n = active[t + 1]
        if n:
            after = place[:n] + 1
            w1, b1 = weight[after] * behind[after], 1 - behind[after]
            b_zero, b_one = e[0, 0] * b1 + e[0, 1] * w1, e[1, 0] * b1 + e[1, 1] * w1
            back[:n] = b_one / (b_zero + b_one)
            one = ahead[place[:n]]
            joint = np.stack(
                [(1 - one) * e[0, 0] * b1, (1 - one) * e[0, 1] * w1, one * e[1, 0] * b1, one * e[1, 1] * w1]
            )
            expected += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        behind[place] = back
    both = ahead * behind
    return both / np.maximum(both + (1 - ahead) * (1 - behind), 1e-300), expected


@dataclass
class Model:
    weights: np.ndarray  # per feature
    bias: float
    transitions: np.ndarray
    regression: np.ndarray  # of document scores on document_features()

    def word_marginals(self, words: Words) -> np.ndarray:
        u = self.bias + self.weights[words.features].sum(axis=0, dtype=np.float64)
        return marginals(u, words.chain_starts, words.chain_lengths, self.transitions)[0]


def document_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """``(n, 4)``: constant, largest marginal, log of the expected toxic words, and their share.

    Marginals below ``DOUBT`` do not add up, so a long text is not toxic for being long.
    """
    total = np.bincount(doc, weights=np.where(p >= DOUBT, p, 0.0), minlength=n)
    count = np.bincount(doc, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    return np.stack([np.ones(n), most, np.log1p(total), total / np.maximum(count, 1)], axis=1)


def _evidence(values: list[bytes], toxic: np.ndarray) -> np.ndarray:
    """Whether each feature marks toxic documents beyond chance."""
    df = np.zeros((2, DIMENSIONS))
    seen = 0
    for part in _batches(values):
        words = read_words(part)
        for row in words.features:
            pairs = np.unique(words.doc.astype(np.int64) * DIMENSIONS + row)
            label = toxic[seen + pairs // DIMENSIONS]
            for k in (0, 1):
                df[k] += np.bincount(pairs[label == k] % DIMENSIONS, minlength=DIMENSIONS)
        seen += len(part)
    share = toxic.mean()
    able = np.flatnonzero(df[1])  # the others mark nothing
    clean, dirty = df[:, able]
    total = clean + dirty
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (
            dirty * np.log(dirty / (total * share))
            + np.where(clean > 0, clean * np.log(clean / (total * (1 - share))), 0)
        )
    marks = np.zeros(DIMENSIONS, bool)
    marks[able] = (ratio >= EVIDENCE) & (dirty > 4 * share / (1 - share) * clean)
    marks[0] = False
    return marks


def _learn_chain(values: list[bytes], toxic: np.ndarray, seed: int = 7) -> Model:
    """Weights by AdaGrad on the likelihood of the labelled words."""
    marks = np.zeros(DIMENSIONS, bool)
    weights, squares = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-2)
    small, small_squares = np.array([-4.0, 0, 0, 0, 0]), np.full(5, 1e-2)
    if 0 < toxic.sum() < len(toxic):
        marks = _evidence(values, toxic)
    if not marks.any():
        return Model(weights.astype(np.float32), float(small[0]), np.zeros((2, 2)), np.zeros(4))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(values))
        for k in range(0, len(order), 100):
            part = order[k : k + 100]
            n, g = 0, np.zeros(5)
            gradient = np.zeros(DIMENSIONS)
            seen = 0
            for own in _batches([values[i] for i in part]):
                words = read_words(own)
                label = toxic[part[seen : seen + len(own)]]
                seen += len(own)
                if not len(words.starts):
                    continue
                y = marks[words.features].any(axis=0) & (label[words.doc] == 1)
                u = small[0] + weights[words.features].sum(axis=0)
                transitions = small[1:].reshape(2, 2)
                p, expected = marginals(u, words.chain_starts, words.chain_lengths, transitions)
                error = p - y
                for row in words.features:
                    np.add.at(gradient, row, error)
                follows = np.ones(len(y), bool)
                follows[words.chain_starts] = False
                later = np.flatnonzero(follows)
                pairs = np.bincount(2 * y[later - 1] + y[later], minlength=4)[:4]
                g += np.append(error.sum(), expected.ravel() - pairs)
                n += len(y)
            if not n:
                continue
            gradient *= 1000 / n
            gradient += DECAY * weights
            gradient[0] = 0
            squares += gradient**2
            gradient *= RATE
            gradient /= np.sqrt(squares)
            weights -= gradient
            g *= 1000 / n
            small_squares += g**2
            small -= RATE * g / np.sqrt(small_squares)
    return Model(weights.astype(np.float32), float(small[0]), small[1:].reshape(2, 2), np.zeros(4))


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, lightly held back."""
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge @ beta)
        beta -= np.clip(step, -5, 5)
    return beta


def learn(values: list[bytes], toxic: np.ndarray, share: float) -> Model:
    """A model from texts and their 0/1 labels; ``share`` of label 1 among all labelled rows.

    The chain learns from every other document, the regression from the rest.
    """
    model = _learn_chain(values[::2], toxic[::2])
    rest, y = values[1::2], toxic[1::2]
    x = np.concatenate(
        [np.zeros((0, 4))] + [_features_of(model, part) for part in _batches(rest)]
    )
    n1, n = int(y.sum()), len(y)
    prior = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    model.regression = np.array([prior, 0.0, 0.0, 0.0])
    if 0 < n1 < n:
        weight = np.where(y == 1, share * n / n1, (1 - share) * n / (n - n1))
        model.regression = _regression(x, y, weight)
    return model


def _batches(values: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts of bounded size together; a larger text comes alone."""
    part, size = [], 0
    for value in values:
        if part and size + len(value) > BATCH_BYTES:
            yield part
            part, size = [], 0
        part.append(value)
        size += len(value)
    if part:
        yield part


def sentences(data: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` bytes that end where a chain ends: behind a break, or after whole
    chains of a sentence that is longer. What is read from them is what is read from all at once."""
    size = size or BATCH_BYTES
    start, end = 0, size
    while start < len(data):
        if end < len(data):
            breaks = np.flatnonzero(_BREAK[data[start:end]])
            if len(breaks):
                end = start + int(breaks[-1]) + 1
            else:
                begins, _ = spans(data[start:end], LETTERS)
                whole = (len(begins) - 1) // CHAIN * CHAIN
                if whole <= 0:
                    end += end - start
                    continue
                end = start + int(begins[whole])
        yield start, min(end, len(data))
        start, end = end, end + size


def _judged(model: Model, values: list[bytes]) -> Iterator[tuple[Words, np.ndarray, int]]:
    """Words and marginals of a batch, piece by piece if it is one long text, with byte offsets."""
    if len(values) > 1 or len(values[0]) <= BATCH_BYTES:
        words = read_words(values)
        yield words, model.word_marginals(words), 0
        return
    for a, b in sentences(lower(values[0])):
        words = read_words([values[0][a:b]])
        yield words, model.word_marginals(words), a


def _features_of(model: Model, values: list[bytes]) -> np.ndarray:
    judged = list(_judged(model, values))
    p = np.concatenate([x[1] for x in judged])
    doc = np.concatenate([x[0].doc for x in judged])
    return document_features(p, doc, len(values))


def _score(model: Model, values: list[bytes]) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of a batch, and the spans of words above one half in code points."""
    judged = list(_judged(model, values))
    p = np.concatenate([x[1] for x in judged])
    doc = np.concatenate([x[0].doc for x in judged])
    x = document_features(p, doc, len(values))
    score = 1 / (1 + np.exp(-np.clip(x @ model.regression, -30, 30)))
    found: list[list[dict]] = [[] for _ in values]
    offsets = np.cumsum([0] + [len(v) + 1 for v in values])
    starts = np.concatenate([w.starts + a for w, _, a in judged])
    ends = np.concatenate([w.ends + a for w, _, a in judged])
    high = np.flatnonzero(p > 0.5)
    for d in np.unique(doc[high]):
        own = high[doc[high] == d]
        data = np.frombuffer(values[d], np.uint8)
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        low, up = points[starts[own] - offsets[d]], points[ends[own] - offsets[d]]
        found[d] = [{"start": int(a), "end": int(b)} for a, b in zip(low, up, strict=True)]
    return score, found


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from."""
    text = F.col(id_col).cast("string").cast("binary")
    return F.coalesce(F.pmod(F.crc32(text), F.lit(5)) == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    train_docs: int = TRAIN_DOCS,
    train_bytes: int = TRAIN_BYTES,
    train_total: int = TRAIN_TOTAL,
) -> Model:
    """A model from at most ``train_docs`` labelled documents of each label, ``train_total`` bytes of each.

    Those with the smallest hash of the id are taken; held-out rows, rows without id or label and
    texts above ``train_bytes`` are left out. An id labelled twice counts with its larger label.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    counts = dict(known.groupBy("label").count().collect())  # two rows
    key = F.md5(F.col("id").cast("string"))
    sample = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(key, "id").limit(train_docs)
        sample = part if sample is None else sample.unionByName(part)
    named = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(
        F.octet_length("text") <= train_bytes
    )
    found = (
        named.join(F.broadcast(sample), "id")  # 2 * train_docs rows at most
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
    )
    upto = W.partitionBy("label").orderBy(key, "id").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumn("bytes", F.sum(F.octet_length("text")).over(upto))
    rows = found.where(F.col("bytes") <= train_total).orderBy(key, "id").select("text", "label").toArrow()
    toxic = rows.column("label").to_numpy().astype(np.int64)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return learn(texts(rows.column("text").combine_chunks()), toxic, share)


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``_score`` and ``_spans``, one row per row.

    Null and empty texts have the score of a text without toxic words. The model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            names = batch.schema.names
            scores, found = [np.zeros(0)], []
            for part in _batches(texts(batch.column(names.index(text)))):
                score, spans_of = _score(model, part)
                scores.append(score)
                found += spans_of
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in keep]
                + [pa.array(np.concatenate(scores)), pa.array(found, kind)],
                [*keep, "_score", "_spans"],
            )

    fields = [docs.schema[c] for c in keep]
    added = [T.StructField("_score", T.DoubleType()), T.StructField("_spans", SPANS)]
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(judge, T.StructType(fields + added))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, table(spark, sf_dir, "labels"))
    spans_text = F.array_join(
        F.transform("_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return scored(docs, model, ["doc_id"]).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        spans_text.alias("spans"),
    )
