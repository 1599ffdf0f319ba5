import json

import pytest
from pyspark.sql import functions as F

from opinion_spark.operators import network
from opinion_spark.operators.opinion import user_opinion
from opinion_spark.schemas import RAW_NETWORK
from opinion_spark.sources.files import side_list
from opinion_spark.sources.network import parse_network
from util import rows


def profile(uid, lang="ja", friends=10):
    return json.dumps({"id": uid, "lang": lang, "friends_count": friends})


@pytest.fixture
def net(table):
    return parse_network(
        table(
            [
                (profile(1), "1,2,3,11,12,2,3,4"),
                (profile(2, "JA", 1999), "2,0,1,1"),
                (profile(3, "en", 2000), "3,1,1,9,1"),
                (profile(4), "4,-1,-1"),
                (profile(5, "en"), "5,1,0,1"),
                (profile(6), "6,1,2,8,x7, 9"),
                (profile(7), "7,5,5,1,2"),
                ("{bad", "8,0,1,1"),
                (json.dumps({"id": 9, "friends_count": 1}), "9,0,1,1"),
                (json.dumps({"id": 10, "lang": "ja"}), "10,0,1,1"),
            ],
            RAW_NETWORK,
        )
    )


@pytest.fixture
def listed(table):
    return table([(1, 5), (2, 7), (3, 1), (4, 0)], "user_id bigint, value int")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_record_filters(net, listed):
    assert ids(network.filter_network_by_profile(net)) == [1, 2, 4, 6, 7, 10]
    assert ids(network.filter_network_by_list(net, listed)) == [1, 2, 4]
    assert rows(network.drop_profile_and_filter(net, listed)) == [
        (1, "1,2,3,11,12,2,3,4"), (2, "2,0,1,1"), (4, "4,-1,-1"),
    ]
    assert ids(network.simplify_network(net)) == [1, 2, 4, 5, 6, 7, 9, 10]


def test_following_lists(net):
    all_lists = {
        (1, "2,3,4"), (2, "1"), (3, "1"), (5, ""), (6, "x7, 9"), (9, "1"), (10, "1"),
    }
    kept = network.following_only(net)
    assert sorted(f for _, f in rows(kept)) == sorted([f for _, f in all_lists] + ["1"])
    assert set(rows(network.simplify_all(net))) == {r for r in all_lists if r[0] != 3}


def test_follow_rows(net):
    got = rows(network.follow_rows(network.simplify_all(net)))
    assert got == sorted(
        [(1, 2), (1, 3), (1, 4), (2, 1), (5, None), (6, None), (6, None), (9, 1), (10, 1)], key=repr
    )


def test_neighbours(table, listed):
    follows = table(
        [(1, 2), (1, 3), (1, 99), (1, None), (2, None), (3, 98), (50, 1), (4, 4)],
        "user_id bigint, followee bigint",
    )
    assert rows(network.vocal_rate(follows, listed)) == [
        (1, 5, 0.5), (2, 7, 0.0), (3, 1, 0.0), (4, 0, 1.0),
    ]
    assert rows(network.vocal_avg(follows, listed)) == [
        (1, 5, 4.0, 2.0), (2, 7, 0.0, 0.0), (3, 1, 0.0, 0.0), (4, 0, 0.0, 0.0),
    ]
    assert rows(network.neighbor_opinion(follows, listed)) == [
        (1, 5, 4.0, 2), (2, 7, 0.0, 0), (3, 1, 0.0, 0), (4, 0, 0.0, 1),
    ]
    same = table([(1, 3), (2, 3)], "user_id bigint, value int")
    assert rows(network.vocal_rate_avg(follows, same)) == [(3, 0.125)]


def test_degrees(table, listed):
    accounts = table(
        [(1, 3), (2, 3), (3, -1), (8, 3), (9, 0), (10, None)], "id bigint, n_followers int"
    )
    opinions = table([(1, 1), (2, 0)], "user_id bigint, value int")
    assert rows(network.degree_hist_by_opinion(accounts, opinions)) == [
        (-1, 0, 1), (-1, 3, 1), (0, 3, 1), (1, 3, 1),
    ]
    assert rows(network.degree_hist(accounts)) == [(1, 0, 1), (1, 3, 3)]


def test_follower_counts(table):
    records = table([(1, "1,2,3,9,9"), (2, "2,-1,-1"), (3, "3"), (4, "4,x,1")], "id bigint, csv string")
    assert rows(network.follower_counts(records)) == [(1, 2), (2, -1), (3, None), (4, None)]


def test_annotate(net, listed):
    annotated = network.annotate_following(net, listed)
    got = {json.loads(r.profile)["id"]: r.csv for r in annotated.collect()}
    assert got == {
        1: "1 5,2,3,11,12,2;7,3;1,4;0",
        2: "2 7,0,1,1;5",
        4: "4 0,-1,-1",
        6: "6 0,1,2,8",
        7: "7 0,5,5,1,2",
        10: "10 0,0,1,1;5",
    }


def test_side_list_keeps_one_value_per_user(table):
    pairs = table([(1, 2), (1, 5), (2, 0)], "user_id bigint, value int")
    assert rows(side_list(pairs)) == [(1, 5), (2, 0)]


def test_user_opinion(table):
    # a, b, c, d in base64
    a, b, c, d = "YQ==", "Yg==", "Yw==", "ZA=="
    items = table(
        [(1, a), (1, b), (1, c), (2, b), (3, a), (3, b), (4, d), (5, "Zg==")],
        "user_id bigint, item string",
    )
    plain = table([("a", 0), ("b", 1), ("c", 0), ("d", 2)], "rt string, opinion int")
    want = [(1, 0), (2, 1)]
    assert rows(user_opinion(items, plain, digests=False)) == want
    digests = items.withColumn("item", F.sha2(F.unbase64("item"), 256))
    assert rows(user_opinion(digests, plain)) == want
    coded = table([(a, 0), (b, 1), (c, 0), (d, 2)], "rt string, opinion int")
    assert rows(user_opinion(items, coded, key="base64", digests=False)) == want
    assert rows(user_opinion(items, plain, digests=False, normalise=True)) == want
    assert rows(user_opinion(items, coded, key="base64", digests=False, normalise=True)) == want
    with pytest.raises(ValueError):
        user_opinion(items, plain, key="other")
    with pytest.raises(ValueError):
        user_opinion(items, plain, normalise=True)


def test_user_opinion_normalises_both_sides(table):
    items = table([(1, "eCwgCSB5")], "user_id bigint, item string")  # "x, \t y"
    listed = table([("x， y", 1)], "rt string, opinion int")
    assert rows(user_opinion(items, listed, digests=False)) == []
    assert rows(user_opinion(items, listed, digests=False, normalise=True)) == [(1, 1)]
