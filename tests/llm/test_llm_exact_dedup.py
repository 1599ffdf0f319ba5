"""Exact dedup against a plain version, and its split of heavy digests."""

import hashlib
import re

import duckdb
import pandas as pd
import pytest

from opinion_spark.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, keep_id string, row int"
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def rows():
    found = [(i, f"text  {i % 40}\n", "x", 1) for i in range(100, 300)]
    found += [(i, "hot\tcopy" if i % 2 else "hot copy", None, 2) for i in range(300, 500)]
    found += [(7, "same row", "k", 3), (7, "same row", "k", 3), (7, "same  row", "k", 4), (9, "same row", "k", 3)]
    found += [(None, "no id", "a", 1), (None, "no id", "a", 1), (None, "hot copy", "a", 1), (12, None, "a", 1)]
    found += [(11, "", "a", 1), (13, " ", "a", 1), (14, " ", "a", 1), (15, "long " * 100_000, "a", 1)]
    return found


def brute(records):
    groups = {}
    for doc_id, text, *_ in records:
        normal = re.sub(r"[\x20\x09-\x0d]+", " ", text or "")
        groups.setdefault(hashlib.sha256(normal.encode()).hexdigest(), []).append(doc_id)
    out = []
    for digest, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


def result(df, **options):
    return sorted((tuple(r) for r in ed.exact_dedup(df, **options).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("share, tracked", [(2, 8), (20, 64), (1024, 8192)])
def test_matches_plain_version_whatever_is_heavy(table, share, tracked):
    df = table(rows(), SCHEMA).repartition(6)
    assert result(df, share=share, tracked=tracked) == brute(rows())


def test_matches_sql(table):
    con = duckdb.connect()
    con.register("docs", pd.DataFrame(rows(), columns=["doc_id", "text", "a", "b"]).astype({"doc_id": "Int64"}))
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ed.exact_dedup_sql('docs')})").fetchall()
    assert result(table(rows(), SCHEMA)) == sorted(want, key=repr)


def test_heavy_digests_are_found_counted_and_bounded(table):
    records = [(i, "a" if i % 3 == 0 else f"t{i}", None, 1) for i in range(3000)]
    digests = table(records, SCHEMA).selectExpr("doc_id AS row", "doc_id AS id", "sha2(text, 256) AS digest").cache()
    found = ed.winners(digests, share=100, tracked=800).collect()
    assert [(r.digest, r["size"], r["first"].id) for r in found] == [(hashlib.sha256(b"a").hexdigest(), 1000, 0)]
    assert ed.frequent(digests, 800).count() <= 800


def test_heavy_rows_are_not_shuffled(table):
    plan = ed.exact_dedup(table(rows(), SCHEMA))._jdf.queryExecution().explainString(
        plan_mode(table)
    )
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan


def plan_mode(table):
    session = table([(1,)], "x int").sparkSession
    return session._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")


def test_one_row_of_each_group_stays_with_all_its_columns(table):
    kept = ed.deduplicated(table(rows(), SCHEMA))
    assert kept.columns == ["doc_id", "text", "keep_id", "row"]
    got = sorted((tuple(r) for r in kept.collect()), key=repr)
    assert len(got) == sum(r[3] for r in brute(rows()))
    assert set(got) <= set(rows())
    assert [r for r in got if r[1] and r[1].split() == ["same", "row"]][0][0] == 7


def test_empty_table(table):
    assert ed.exact_dedup(table([], SCHEMA)).count() == 0
    assert ed.deduplicated(table([], SCHEMA)).count() == 0
