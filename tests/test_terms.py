"""The automaton against plain substring search."""

import random

import pytest

from opinion_spark.operators import keywords, terms
from util import rows

TEXTS = "digest string, text string"


def brute(texts, names):
    return sorted({(k, t) for k, text in texts for t in names if t and text is not None and t in text})


def found(table, texts, names, **options):
    df = terms.find_terms(table(texts, TEXTS), table([(t,) for t in names], "term string"), **options)
    return rows(df, "digest", "term")


def sample(seed):
    rng = random.Random(seed)
    names = ["he", "she", "hers", "his", "é", "éé", "日本", "本", "a", "aa", "aaa", "abab", "\n", "", None, "zz" * 40]
    names += ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = [(f"t{i}", "".join(rng.choice("abéhers 日本\n") for _ in range(rng.randrange(0, 300)))) for i in range(80)]
    return texts + [("null", None), ("empty", ""), ("ushers", "ushers"), ("zz", "z" * 100)], names


@pytest.mark.parametrize("block", [40, 1 << 17])
def test_matches_substring_search(table, block):
    texts, names = sample(1)
    assert found(table, texts, names, block_bytes=block) == brute(texts, names)


def test_texts_longer_than_a_stretch(table, monkeypatch):
    monkeypatch.setattr(terms, "STRETCH", 7)
    monkeypatch.setattr(terms, "BATCH", 100)
    texts, names = sample(2)
    automaton = terms.automaton([t.encode() for t in dict.fromkeys(names) if t])
    listed = [t for t in dict.fromkeys(names) if t]
    for key, text in texts:
        own, number = automaton.found([(text or "").encode()])
        assert set(own) <= {0}
        assert sorted((key, listed[n]) for n in number) == brute([(key, text)], names)


def test_one_long_text(table):
    text = "x" * 300_000 + "needle" + "y" * 300_000 + "end"
    assert found(table, [("long", text)], ["needle", "end", "xneedley", "absent"]) == [
        ("long", "end"), ("long", "needle"), ("long", "xneedley"),
    ]


def test_no_terms_and_no_texts(table):
    assert found(table, [("a", "b")], []) == []
    assert found(table, [], ["a"]) == []


POSTS = "tweet_id long, key long, text string"


def posts():
    texts, _ = sample(3)
    found = [(i, i % 4, text) for i, (_, text) in enumerate(texts)] * 2
    return found + [(None, 1, "he"), (900, None, "he"), (901, 1, "same he")] + [(i, 1, "hot he she") for i in range(1000, 1060)]


def test_filter_and_buzz_agree_with_the_plain_jobs(table):
    df = table(posts(), POSTS)
    names = ["he", "éé", "本", "abab", "nowhere"]
    by_table = table([(t,) for t in names] + [("",), (None,), ("he",)], "term string")
    assert rows(keywords.keyword_filter_by_table(df, by_table)) == rows(keywords.keyword_filter(df, names))
    assert rows(keywords.term_buzz_by_table(df, by_table)) == rows(keywords.term_buzz(df, names))


def test_many_terms_are_two_passes(table):
    names = [f"term{i:05d}x" for i in range(10_000)]
    df = terms.find_terms(table([("a", "xx term00042x term09999x")], TEXTS), table([(t,) for t in names], "term string"))
    assert rows(df, "term") == [("term00042x",), ("term09999x",)]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") <= 1 and "Generate" not in plan  # staged before the last pass
