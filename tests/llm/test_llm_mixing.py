import duckdb
import pandas as pd
import pytest

from opinion_spark.llm.mixing import mix, mixing_sql, targets

SCHEMA = "doc_id long, text string, source string"
COLUMNS = ["doc_id", "source", "size", "source_size", "target", "taken"]


def rows():
    found = [(i, "w " * (i % 17), ["b", "a", "é", None, "zz"][i % 5]) for i in range(200)]
    found += [(500 + i, "x\ty\nz\x0bq  é", "hot") for i in range(400)] + [(900, None, "empty"), (901, "", "empty")]
    found += [(7, "w " * 7, "a"), (None, "one two", "a"), (None, "one", "a"), (950, "w " * 50_000, "long")]
    return found


def result(df):
    return sorted((tuple(r) for r in mix(df).select(*COLUMNS).collect()), key=repr)


def test_matches_sql_and_repeats(table, conf):
    conf("spark.sql.shuffle.partitions", "5")
    df = table([(*r, 1, "k") for r in rows()], SCHEMA + ", size int, key string")
    got = result(df)
    docs = pd.DataFrame(rows(), columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("docs", docs)
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({mixing_sql('docs')})").fetchall()
    assert got == sorted(want, key=repr)
    assert result(df.repartition(7)) == got


def test_budgets_are_met_exactly(table):
    got = result(table(rows(), SCHEMA))
    taken, target = {}, {}
    for _, source, size, source_size, goal, words in got:
        taken[source] = taken.get(source, 0) + words
        target[source] = goal
        assert words <= 3 * size and goal <= 3 * source_size
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sum(target.values()) == pytest.approx(sum(r[2] for r in got))


def test_targets_by_hand(table):
    sizes = table([("a", 10), ("b", 1000), (None, 10), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 0 and got[None] == 30
    assert got["b"] == 1020 - 60
    assert targets(sizes.where("source = 'x'")).count() == 0


def test_empty_table_and_sizes_of_zero(table):
    assert mix(table([], SCHEMA)).count() == 0
    assert [tuple(r) for r in mix(table([(1, None, "a")], SCHEMA)).select(*COLUMNS).collect()] == [(1, "a", 0, 0, 0.0, 0)]
