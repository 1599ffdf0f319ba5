"""Registered queries of the package against their SQL, and what they return."""

import duckdb
import pytest

import __spark_entry__ as entry
from opinion_spark.llm import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")

COLUMNS = {
    "op1_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_quotation_linking": ["conv_id", "turn", "role", "own_text"],
    "pipeline": ["doc_id", "source", "size", "source_size", "target", "taken"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n in registry.QUERIES]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_its_columns(spark, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert df.count() > 0
