import random

from opinion_spark.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_random_chains_stars_nulls_and_repeats(spark, table):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    edges += [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2060)]
    edges += [(5, 5), (None, 3), (4, None), edges[0], (-7, 9_000_000_000)]
    got = {r.node: r.component for r in components(table(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_no_edges(table):
    assert components(table([], "a long, b long")).count() == 0
