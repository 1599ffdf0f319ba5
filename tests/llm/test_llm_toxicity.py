import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinion_spark.llm import toxicity
from opinion_spark.llm.toxicity import fit, held_out, marginals, read_words, scored

SF = "/root/testdata/sf0.1"


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 4, 3, 6])
    starts = np.append(0, np.cumsum(lengths)[:-1])
    u, a = rng.normal(size=lengths.sum()) * 2, rng.normal(size=(2, 2))
    p, expected = marginals(u, starts, lengths, a)
    want, pairs = np.zeros(len(u)), np.zeros((2, 2))
    for s, n in zip(starts, lengths, strict=True):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.array(
            [np.exp(sum(u[s + t] * y[t] for t in range(n)) + sum(a[y[t], y[t + 1]] for t in range(n - 1))) for y in paths]
        )
        weight /= weight.sum()
        for w, y in zip(weight, paths, strict=True):
            want[s : s + n] += w * np.array(y)
            for t in range(n - 1):
                pairs[y[t], y[t + 1]] += w
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def test_chains_are_sentences_and_never_too_long():
    words = read_words([b"One two. Three\nfour", b"", b"x " * 300])
    assert words.doc.tolist() == [0] * 4 + [2] * 300
    assert words.chain_lengths.tolist()[:3] == [2, 1, 1]
    assert words.chain_lengths.max() <= toxicity.CHAIN and words.chain_lengths.sum() == 304


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return fit(docs, labels)


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = scored(docs, model, ["doc_id"]).where(held_out("doc_id")).join(labels, "doc_id")
    rows = judged.select("toxic", (F.col("_score") >= 0.5).cast("int").alias("p")).collect()
    toxic = [r.p for r in rows if r.toxic == 1]
    clean = [r.p for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_spans_scores_and_edge_cases(table, model):
    rows = [
        (1, "You idiot, you stupid moron. É a fine day."), (2, None), (3, ""), (4, "Such a fine day"),
        (None, "idiot moron scum"), (1, "You idiot, you stupid moron. É a fine day."), (5, "fine " * 500_000),
        (6, "É é. pathetic loser! worthless trash"),
    ]
    df = table([(*r, 1, "x") for r in rows], "doc_id long, text string, toxic int, score string")
    got = scored(df, model, ["doc_id", "text", "score"]).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert all(0 <= r._score <= 1 for r in got) and got[0]._score == got[5]._score > 0.5
    assert got[1]._score == got[2]._score < 0.5 and got[3]._score < 0.5 and got[6]._score < 0.5
    assert {got[7].text[s.start : s.end] for s in got[7]._spans} >= {"pathetic", "loser"}
    assert scored(df.where("doc_id > 99"), model, ["doc_id"]).count() == 0


def test_without_labels_or_with_one_kind(table):
    docs = table([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    for labels in ([], [(i, 0) for i in range(30)], [(None, 1), (3, None)]):
        model = fit(docs, table(labels, "doc_id long, toxic int"))
        assert all(r._score < 0.5 for r in scored(docs, model, []).collect())


def test_fit_is_repeatable_and_ignores_held_out_rows(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = fit(docs.repartition(5), turned.repartition(3))
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.regression, model.regression)


def test_long_texts_are_cut_between_chains(monkeypatch):
    """Any size of pieces gives the words and chains of the whole text."""
    text = (b"One two three. " * 40 + b"word " * 700 + b"! last\nline " + b"x" * 900 + b" y") * 2
    whole = read_words([text])
    for size in (64, 500, 4096):
        starts, lengths, words, at = [], [], 0, 0
        for a, b in toxicity.sentences(np.frombuffer(text, np.uint8), size):
            part = read_words([text[a:b]])
            assert a == at
            starts += (part.chain_starts + words).tolist()
            lengths += part.chain_lengths.tolist()
            words, at = words + len(part.starts), b
        assert at == len(text) and starts == whole.chain_starts.tolist() and lengths == whole.chain_lengths.tolist()


def plain_scores(model, text):
    """Document score and spans, a word at a time."""
    words = read_words([text])
    u = [model.bias + sum(float(model.weights[f]) for f in words.features[:, i]) for i in range(len(words.starts))]
    a, p = model.transitions, []
    for start, length in zip(words.chain_starts, words.chain_lengths, strict=True):
        own = u[start : start + length]
        forward, backward = [[0.0, own[0]]], [[0.0, 0.0]]
        for x in own[1:]:
            last = forward[-1]
            forward.append([np.logaddexp(last[0] + a[0, k], last[1] + a[1, k]) + k * x for k in (0, 1)])
        for x in reversed(own[1:]):
            last = backward[-1]
            backward.append([np.logaddexp(a[k, 0] + last[0], a[k, 1] + x + last[1]) for k in (0, 1)])
        for f, b in zip(forward, reversed(backward), strict=True):
            p.append(1 / (1 + np.exp(f[0] + b[0] - f[1] - b[1])))
    sure = [x for x in p if x >= toxicity.DOUBT]
    features = [1.0, max(p, default=0.0), np.log1p(sum(sure)), sum(sure) / max(1, len(p))]
    score = 1 / (1 + np.exp(-np.dot(features, model.regression)))
    spans = [(len(text[:s].decode()), len(text[:e].decode())) for s, e, x in zip(words.starts, words.ends, p) if x > 0.5]
    return score, spans


def test_scores_and_spans_against_a_plain_version(table, model, monkeypatch):
    texts = ["You idiot, you stupid moron. É a fine day.", "É é. pathetic loser! worthless trash", "fine", "", "a. b. scum " * 60]
    for size in (1 << 18, 32):
        monkeypatch.setattr(toxicity, "BATCH_BYTES", size)
        got = toxicity.scored(table(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]).collect()
        for r in got:
            score, spans = plain_scores(model, texts[r.doc_id].encode())
            assert r._score == pytest.approx(score, abs=1e-9)
            assert [(s.start, s.end) for s in r._spans] == spans


def test_training_sample_is_bounded_in_bytes(table):
    docs = table([(i, ("idiot scum " if i % 2 else "fine day ") * 20) for i in range(400)], "doc_id long, text string")
    labels = table([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    seen = []
    learn, toxicity.learn = toxicity.learn, lambda values, toxic, share: seen.append((values, toxic)) or learn(values, toxic, share)
    try:
        fit(docs, labels, train_total=5_000)
    finally:
        toxicity.learn = learn
    values, toxic = seen[0]
    for label in (0, 1):
        assert 4_000 < sum(len(v) for v, y in zip(values, toxic) if y == label) <= 5_000
