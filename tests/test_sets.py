import random
from collections import Counter, defaultdict

from opinion_spark.operators import item_sets, reshares
from util import rows

EDGES = "item string, user_id bigint"


def test_item_sets_keep_repeats_and_sort(table):
    edges = table([("a", 3), ("a", 1), ("a", 3), ('"q', 1), ("b", 2), (None, 1)], EDGES)
    got = rows(item_sets.item_sets(edges), "item", "n", "part", "users")
    assert got == [('"q', 1, 0, [1]), ("a", 3, 0, [1, 3, 3]), ("b", 1, 0, [2])]
    plain = item_sets.item_sets(edges, drop_quoted=True)
    assert [r[0] for r in rows(plain, "item")] == ["a", "b"]
    assert rows(item_sets.threshold_item_sets(plain, 3), "item") == [("a",)]


def test_large_lists_are_split_and_whole(table):
    rng = random.Random(3)
    data = [("hot", rng.randrange(200)) for _ in range(5000)] + [("cold", 1), ("cold", 2)]
    data += [("hot", 7)] * 3000
    sets = item_sets.item_sets(table(data, EDGES), part_bytes=800).collect()
    parts, got = defaultdict(list), defaultdict(Counter)
    for r in sets:
        parts[r.item].append(len(r.users))
        got[r.item].update(r.users)
        assert list(r.users) == sorted(r.users)
        assert r.n == (8000 if r.item == "hot" else 2)
    want = defaultdict(Counter)
    for item, user in data:
        want[item][user] += 1
    assert got == want
    assert parts["cold"] == [2]
    # 80 parts of 100 on average; the value that repeats 3000 times must not sit in one part.
    assert len(parts["hot"]) > 40 and max(parts["hot"]) < 600


def test_unpack_reverses_pack(table):
    edges = table([("a", 1), ("a", 2), ("b", 9)], EDGES)
    sets = item_sets.pack(edges, "item", "user_id", "users", unique=True)
    assert rows(item_sets.unpack(sets, "item", "users", "user_id")) == rows(edges)


def test_later_lists_replace_earlier_ones_whole(table):
    first = item_sets.item_sets(table([("a", i) for i in range(50)] + [("b", 5)], EDGES), part_bytes=80)
    second = item_sets.item_sets(table([("a", i) for i in range(9, 20)], EDGES), part_bytes=80)
    got = item_sets.unpack(item_sets.latest_sets(first, second), "item", "users", "user_id")
    assert sorted(rows(got)) == [("a", i) for i in range(9, 20)] + [("b", 5)]


def test_at_least(table):
    edges = table([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1)], EDGES)
    assert rows(item_sets.at_least(edges, "item", 2)) == [("a", 1, 2), ("a", 2, 2)]


POSTS = (
    "tweet_id bigint, user_id bigint, is_retweet boolean, retweeted_text string, "
    "text string, retweet_count bigint"
)


def test_retweets(table):
    posts = table(
        [
            (1, 1, True, "hello", "RT hello", 5),
            (2, 2, True, "hello", "RT hello", 5),
            (3, 2, True, "hello", "RT hello", 5),
            (4, 3, False, None, "hello", 2),
            (5, 4, False, None, "hello", 0),
            (6, 5, True, None, "RT", 1),
            (None, 6, True, "hello", None, None),
            (7, 1, True, "bye", "RT bye", 1),
            (8, 2, True, "bye", "RT bye", 1),
        ],
        POSTS,
    )
    sets = reshares.retweet_sets(posts, th=2)
    assert rows(sets, "item", "n", "users") == [("Ynll", 2, [1, 2]), ("aGVsbG8=", 3, [1, 2, 3])]
    edges = reshares.with_texts(reshares.retweet_edges(posts, th=2), posts)
    assert rows(reshares.user_rt_freq(edges, 2)) == [(1, 2), (2, 2)]
    assert rows(reshares.user_rt_list(edges), "user_id", "items") == [
        (1, ["Ynll", "aGVsbG8="]),
        (2, ["Ynll", "aGVsbG8="]),
        (3, ["aGVsbG8="]),
    ]
    top = reshares.retweet_edges(posts, th=3)
    assert rows(reshares.with_texts(top, posts)) == [("aGVsbG8=", u, 3) for u in (1, 2, 3)]
