import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinion_spark.llm import ngram_join, signature_tree
from opinion_spark.llm.ngram_join import class_bounds, ngram_components, part_signatures

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            linked = rows[i][0] is not None and rows[j][0] is not None and a and b
            if linked and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(
        ((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr
    )


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []

    def add(ws):
        rows.append((len(rows), " ".join(ws)))

    for n in [1, 2, 3, 4, 5, 9, 10, 11, 12, 20, 25, 40, 90, 150, 300]:
        base = [rng.choice(words) for _ in range(n)]
        add(base)
        for edits in (0, 1, 1, 2, 3, 6):
            copy = list(base)
            for _ in range(edits):
                k = rng.randrange(len(copy) + 1)
                action = rng.random()
                if action < 0.4 and k < len(copy):
                    copy[k] = rng.choice(words)
                elif action < 0.7:
                    copy.insert(k, rng.choice(words))
                elif k < len(copy) and len(copy) > 1:
                    del copy[k]
            add(copy)
    for _ in range(12):  # a shared passage makes no near copies
        add([rng.choice(words) for _ in range(80)] + passage)
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(40):  # a group of near copies
        copy = list(base)
        copy[rng.randrange(len(copy))] = rng.choice(words)
        add(copy)
    return rows


@pytest.mark.parametrize(("size", "percent", "weight"), [(3, 90, 512_000), (5, 80, 6_000), (2, 60, 1)])
def test_components_match_brute_force(table, monkeypatch, size, percent, weight):
    monkeypatch.setattr(ngram_join, "SAMPLE", 2)
    rows = corpus()
    df = ngram_components(table(rows, "doc_id long, text string"), size=size, percent=percent, unit_weight=weight)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute(rows, size, percent)


def test_nulls_empties_repeats_case_long_texts_and_other_columns(table):
    long = " ".join(f"x{i}" for i in range(40_000))
    rows = [
        (1, "a b c d"), (2, "A  B\tc\nd"), (2, "A  B\tc\nd"), (3, None), (4, ""), (5, " \t "), (None, "a b c d"),
        (6, "É b c"), (7, "é b c"), (8, long), (9, long + " y"), (10, "one"), (10, "a b c d"), (11, "x" * 300_000),
    ]
    df = table([(*r, 0, "k") for r in rows], "doc_id long, text string, component_id int, dig string")
    got = ngram_components(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows, 3, 90)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert ngram_components(df.where("doc_id > 99")).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for percent in (60, 80, 90):
        for n in list(range(1, 60)) + [100, 173, 250]:
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            for drop in range(0, len(a)):
                for extra in range(0, len(a)):
                    common, union = len(a) - drop, len(a) + extra
                    if 100 * common < percent * union or rng.random() > 0.2:
                        continue
                    kept = rng.permutation(a)[drop:]
                    b = np.unique(np.append(kept, rng.integers(0, 1 << 63, extra, dtype=np.uint64)))
                    if len(b):
                        for common in (a[:0], a[: len(a) // 7], np.union1d(a, b)):
                            x, y = (part_signatures(s, percent, common) for s in (a, b))
                            assert len(np.intersect1d(x, y)), (percent, n, drop, extra)


def test_class_bounds_rise():
    assert (np.diff(class_bounds(10_000)) > 0).all()


def test_traversal_keeps_every_similar_pair():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.uint64) * np.uint64(2)
        for _ in range(4):
            sets.append(np.unique(base[rng.random(len(base)) > 0.04]))
    sets = sorted((s for s in sets if len(s)), key=len)
    levels = signature_tree.tree(sets, signature_tree.width_for(max(map(len, sets))))
    i, j = signature_tree.candidates(levels, None, 80)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    pairs = [(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets))]
    similar = {p for p in pairs if signature_tree.similar(sets[p[0]], sets[p[1]], 80)}
    assert similar <= kept and len(kept) < len(pairs) / 4
    half = len(sets) // 2
    a, b = signature_tree.tree(sets[:half], 256), signature_tree.tree(sets[half:], 256)
    i, j = signature_tree.candidates(a, b, 80)
    assert {p for p in similar if p[0] < half <= p[1]} <= set(zip(i.tolist(), (j + half).tolist(), strict=True))


def test_counts_by_hand():
    rows = [(0, "a b c d e"), (1, "a b c d e")]
    assert Counter(shingle_set("a b c a b c", 3)) and defaultdict(int) == {}
    assert brute(rows, 3, 90) == [(0, 3, 0), (1, 3, 0)]


def linked_by_brute_force(rows, size, percent):
    """Links between different sets, by their smallest ids, and the links of each document."""
    ids = defaultdict(set)
    for d, t in rows:
        if d is not None and shingle_set(t, size):
            ids[shingle_set(t, size)].add(d)
    links, n_links = set(), {s: len(i) - 1 for s, i in ids.items()}
    for a in ids:
        for b in ids:
            if a != b and 100 * len(a & b) >= percent * len(a | b):
                n_links[a] += len(ids[b])
                links.add(tuple(sorted((min(ids[a]), min(ids[b])))))
    per_row = [(d, 0 if d is None else n_links.get(shingle_set(t, size), 0)) for d, t in rows]
    return links, sorted(per_row, key=repr)


@pytest.mark.parametrize(("size", "percent", "weight"), [(3, 90, 512_000), (5, 80, 6_000), (2, 60, 1)])
def test_every_link_is_returned_and_counted(table, size, percent, weight):
    rows = corpus(4)
    rows += [(len(rows) + k, t) for k, (_, t) in enumerate(rows[::7])] + [rows[3], (None, rows[0][1]), (9_999, None)]
    df = table(rows, "doc_id long, text string")
    links, counts = linked_by_brute_force(rows, size, percent)
    got = ngram_join.ngram_links(df, size=size, percent=percent, unit_weight=weight).collect()
    assert len(got) == len(links) and {(r.a, r.b) for r in got} == links
    got = ngram_join.linked_documents(df, size=size, percent=percent, unit_weight=weight)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    got = got.collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == counts
    assert sorted((tuple(r)[:3] for r in got), key=repr) == brute(rows, size, percent)


def test_op1_has_the_number_of_links(spark, tmp_path):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(4)] + [(4, " ".join([*base, "end0"]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ngram_join.op1_ngram_jaccard_join(spark, str(tmp_path)).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 4)}


def test_texts_under_one_id_meet_their_own_set_alone(table):
    rows = [(7, " ".join(f"t{i}w{k}" for k in range(9))) for i in range(60)]
    rows += [(7, rows[0][1])] * 50 + [(3, "a b c d")] * 40 + [(9, None), (None, "a b c d")]
    docs = table(rows, "doc_id long, text string")
    keyed = ngram_join._rows(docs, "doc_id", "text")
    sets = keyed.where("id IS NOT NULL AND text IS NOT NULL").distinct()
    found = ngram_join._placed_texts(keyed, sets.select("id", "h", F.xxhash64("text").alias("dig")))
    assert sorted((r["id"], r["text"]) for r in found.collect()) == sorted({r for r in rows if r[0] and r[1]})
    got = ngram_join.linked_documents(docs)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == brute(rows, 3, 90)


def test_signatures_meet_in_passes(spark, table, monkeypatch):
    """A pass shuffles its share of the signatures, and all of them together give the components."""
    rows = [(i, f"{corpus()[i % 40][1]} {i // 40}") for i in range(120)]
    met = []

    def seen(signatures):
        met.append({r["sig"] for r in signatures.select("sig").collect()})
        return one_pass(signatures)

    one_pass = ngram_join._met
    monkeypatch.setattr(ngram_join, "_met", seen)
    monkeypatch.setattr(ngram_join, "PASSES", 3)
    found = ngram_components(table(rows, "doc_id long, text string"), size=2, percent=80)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, 2, 80)
    every = set().union(*met)
    assert len(met) == 3 and len(every) == sum(map(len, met))
    assert max(map(len, met)) < len(every) / 2
