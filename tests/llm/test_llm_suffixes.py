import hashlib
import random

import numpy as np
import pytest

from opinion_spark.llm import suffixes
from opinion_spark.llm.suffixes import without_repeats


def brute(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        if d is not None:
            for i in range(len(b) - 49):
                s = b[i : i + 50]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    cut = without_repeats(df, ["doc_id"]).collect()
    return sorted(
        (
            (r.doc_id, r._n_bytes, r._n_bytes - len(r._kept), len(r._runs) // 16, hashlib.sha256(r._kept).hexdigest())
            for r in cut
        ),
        key=repr,
    )


def corpus():
    rng = random.Random(11)

    def prose(n):
        return "".join(rng.choice("etaoin shrdlu ") for _ in range(n))

    line, passage = prose(49), prose(300)
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 200))]
        if i % 3 == 0:
            parts += [line + rng.choice("ab"), prose(20)]
        if i % 4 == 0:
            parts += [passage[rng.randrange(100) : 200 + rng.randrange(100)], prose(5)]
        if i % 7 == 0:
            parts += ["ab" * 90, prose(3), "x" * rng.randrange(48, 60)]
        rows.append((i * 3 % 61, "".join(parts)))
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200, rows[8][1][20:] + "é" * 40), (201, "é" * 60)]
    return rows


@pytest.mark.parametrize(("hot", "held", "parts"), [(50, 200_000, 8), (2, 3, 31)])
def test_matches_brute_force(table, conf, monkeypatch, hot, held, parts):
    monkeypatch.setattr(suffixes, "HOT_RUNS", hot)
    monkeypatch.setattr(suffixes, "SAMPLE", 2)
    monkeypatch.setattr(suffixes, "HELD", held)
    conf("spark.sql.shuffle.partitions", str(parts))
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = corpus()
    assert result(table(rows, "doc_id long, text string")) == brute(rows)


def test_nulls_short_equal_and_repeated_rows(table):
    text = "0123456789" * 6
    rows = [
        (1, text), (1, text), (1, text + "!"), (2, text), (3, text[:50]), (4, text[:49]), (5, None), (6, ""),
        (None, text), (0, "z" * 70_000), (7, "z" * 51), (8, "y" + "z" * 50),
    ]
    df = table([(*r, b"", "s") for r in rows], "doc_id long, text string, _kept binary, source string")
    got = without_repeats(df, ["doc_id", "source"])
    assert got.columns == ["doc_id", "source", "_n_bytes", "_kept", "_runs"]
    assert result(df) == brute(rows)
    assert without_repeats(df.where("doc_id > 99"), ["doc_id"]).count() == 0


def test_every_string_has_one_run():
    data = np.frombuffer(("abcdefghij" * 30 + "q" * 80).encode(), np.uint8)
    _, _, first, count = suffixes.runs(data)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all()
    assert first[-1] + count[-1] == len(data) - suffixes.LENGTH + 1
