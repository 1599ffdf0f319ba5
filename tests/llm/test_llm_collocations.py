"""Collocations against a plain version and SQL."""

import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from opinion_spark.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, w1 string, n int"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(text):
    return re.sub("[A-Z]", lambda x: x.group().lower(), text)


def brute(records, min_count, top, percent=100):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in records:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(5, len(words) - i) + 1):
                    counts[lang, words[i : i + m]] += 1
    frequent = {(lang, p): a for (lang, p), a in counts.items() if len(p) > 1 and a >= min_count}
    covered = set()
    for (lang, p), a in frequent.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                part = (lang, p[i : i + m])
                if 100 * a >= percent * counts[part]:
                    covered.add(part)
    out = []
    for lang in totals:
        rows = []
        for (other, p), a in frequent.items():
            if other == lang and (lang, p) not in covered:
                cuts = [
                    (1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))
                ]
                score, k = min(cuts)
                rows.append((" ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def rows(seed=0):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "é", "straße", "a-b", "x\x0ey", "\x00", "日本", "in"]
    found = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " , "]) for w in words)
        found.append((i, text + "once upon a time there was", rng.choice(["en", "de", None, "und", ""]), "x", 1))
    found += [(500, None, "en", "x", 1), (501, "", "en", "x", 1), (502, "one", "fr", "x", 1), (503, "...", "it", "x", 1)]
    found += [(600, "hot copy " * 30, "en", "x", 1)] * 5 + [(None, "no id here " * 20, "en", "x", 1)]
    return found


def result(df, **options):
    return sorted(tuple(r) for r in co.collocations(df, **options).select(*COLUMNS).collect())


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_matches_plain_version(table, size):
    df = table(rows(), SCHEMA).repartition(3)
    want = brute(rows(), 5, 40)
    assert len(want) > 100
    assert result(df, min_count=5, top=40, size=size) == want


def test_share_of_the_longer_phrase(table):
    assert result(table(rows(1), SCHEMA), min_count=4, top=500, percent=60) == brute(rows(1), 4, 500, 60)


def test_matches_sql(table):
    con = duckdb.connect()
    con.register("docs", pd.DataFrame([r[:3] for r in rows(2)], columns=["doc_id", "text", "lang"]))
    want = con.execute(co.collocations_sql("docs", 5, 40)).fetchall()
    assert result(table(rows(2), SCHEMA), min_count=5, top=40) == sorted(want)


def test_one_long_text_without_a_break(table):
    text = "alpha beta gamma delta epsilon zeta " * 20_000
    want = brute([(1, text, "en")], 100, 2000)
    assert result(table([(1, text, "en", "x", 1)], SCHEMA), size=1 << 12) == want


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    phrases = spark.createDataFrame(
        [("en", ["a", "b"], "a b", 2, big), ("en", ["a"], "a", 1, big), ("en", ["b"], "b", 1, big + 1), ("en", [], "", 0, 7 * big)],
        "lang string, words array<string>, phrase string, m int, a long",
    )
    assert [r.score for r in co._scored(phrases).collect()] == [1000 * big * 7 * big // (big * (big + 1))]


def test_empty_table_and_no_phrases(table):
    assert co.collocations(table([], SCHEMA)).count() == 0
    assert co.collocations(table([(1, "a b c", "en", "x", 1)], SCHEMA)).count() == 0
