import random
import re

import numpy as np
import pytest

from opinion_spark.llm.decontaminate import contamination, joined

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = []
    for name, text in items:
        w = words(text)
        n = min(13, len(w))
        if name is not None and n:
            windows += [(str(name), w[i : i + n]) for i in range(len(w) - n + 1)]
    out = []
    for d, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    names.add(name)
        out.append((d, len(w), len(hit), tuple(sorted(names))))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r._n_words, r._n_hit, tuple(r._items)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_matches_brute_force(table, block_words):
    rng = random.Random(4)
    vocabulary = ["the", "of", "a", "to"] * 5 + [f"v{i}" for i in range(30)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(prose(rng.choice([3, 12, 13, 14, 30])))) for i in range(12)]
    items += [(12, "One"), (13, ""), (14, None), (None, "the of a"), (3, "again the same id")]
    docs = []
    for i in range(80):
        parts = prose(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 3)):
            quoted = (rng.choice(items)[1] or "").upper().split()
            start = rng.randrange(0, max(1, len(quoted) - 12))
            parts += quoted[start : start + rng.choice([13, 14, 99])] + prose(rng.randrange(0, 5))
        docs.append((i, ", ".join(parts)))
    docs += [(80, None), (81, ""), (81, "one"), (81, "one"), (None, "One! two"), (82, "x" * 300_000 + " one")]
    df = table([(*d, 7, "n") for d in docs], "doc_id long, text string, n_words int, runs string")
    bench = table([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = contamination(df, bench, ["doc_id"], block_words=block_words)
    assert result(got) == brute(docs, items)


def test_kept_columns_and_empty_tables(table):
    docs = table([(1, "a b", "x")], "doc_id long, text string, lang string")
    none = table([], "item_id long, text string")
    kept = contamination(docs, none, ["lang", "text", "doc_id"]).collect()
    assert [tuple(r) for r in kept] == [("x", "a b", 1, 2, 0, [])]
    items = table([(1, "b")], "item_id long, text string")
    assert contamination(docs.where("doc_id > 5"), items, ["doc_id"]).count() == 0


def test_joined_runs():
    runs = np.array([[5, 8], [0, 3], [3, 4], [7, 9], [20, 21]])
    assert joined(runs).tolist() == [[0, 4], [5, 9], [20, 21]]
