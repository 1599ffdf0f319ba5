"""Records in parts against the jobs on whole records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from opinion_spark.operators import hubs, network
from opinion_spark.schemas import RAW_NETWORK
from opinion_spark.sources.network import parse_network
from util import rows


def records(seed=1):
    rng = random.Random(seed)
    found = []
    for uid in range(1, 40):
        followers = [rng.choice([str(rng.randrange(50)), "x7", " 9"]) if rng.random() < 0.05 else str(rng.randrange(50)) for _ in range(rng.randrange(12))]
        following = [str(rng.randrange(50)) for _ in range(rng.randrange(12))]
        profile = json.dumps({"id": uid, "lang": rng.choice(["ja", "JA", "en"]), "friends_count": rng.choice([5, 1999, 2000])})
        found.append((profile, ",".join([str(uid), str(len(followers)), str(len(following)), *followers, *following])))
    hub = [str(i) for i in range(1000, 1100)]
    found.append((json.dumps({"id": 77, "lang": "ja", "friends_count": 3}), ",".join(["77", "100", "100", *hub, *hub[::-1]])))
    found += [
        (json.dumps({"id": 90, "lang": "ja"}), "90,-1,-1"), (json.dumps({"id": 91, "lang": "ja"}), "91,5,5,1,2"),
        ("{bad", "8,0,1,1"), (json.dumps({"id": 92, "lang": "ja"}), "92,0,2,5,6,,,"), (json.dumps({"id": 93, "lang": "ja"}), "93,2"),
        (json.dumps({"id": 94, "lang": "ja"}), "94,1,0,3"), (json.dumps({"id": 95, "lang": "ja"}), ""),
    ]
    return found


def joined(df, key, value):
    """Parts of each key in order, as one list."""
    found = {}
    for r in sorted(df.collect(), key=lambda r: r.part):
        found.setdefault(r[key], []).append(r[value])
    return sorted(((k, ",".join(v)) for k, v in found.items()), key=repr)


@pytest.fixture
def listed(table):
    return table([(i, i % 7) for i in range(0, 50, 3)] + [(1003, 4), (1004, 0), (77, 2)], "user_id bigint, value int")


@pytest.mark.parametrize("size", [3, 5, 41, 1000])
def test_parts_give_the_whole_record(table, listed, size):
    raw = table(records(), RAW_NETWORK)
    parts, net = hubs.split_records(raw, size), parse_network(raw)
    assert joined(hubs.following_parts(parts), "profile", "following") == rows(network.following_only(net))
    for limit in (2000, None):
        assert joined(hubs.simplify_parts(parts, limit), "id", "following") == rows(network.simplify_all(net, limit))
    whole = rows(network.follow_rows(network.simplify_all(net)))
    assert rows(network.follow_rows(hubs.simplify_parts(parts))) == whole
    got = joined(hubs.annotate_parts(parts, listed), "profile", "csv")
    assert got == rows(network.annotate_following(net, listed))


def test_a_hub_in_five_parts(table):
    raw = table(records(), RAW_NETWORK).where("profile LIKE '%77%'")
    parts = hubs.split_records(raw, 41)
    assert parts.count() == 5
    placed = hubs.following_parts(parts)
    assert sorted(r.part for r in placed.collect()) == [2, 3, 4]
    assert placed.agg(F.max(F.size(F.split("following", ",")))).head()[0] <= 41


def test_empty_table_and_bad_size(table, listed):
    none = hubs.split_records(table([], RAW_NETWORK))
    assert hubs.following_parts(none).count() == 0 and hubs.annotate_parts(none, listed).count() == 0
    with pytest.raises(ValueError):
        hubs.split_records(none, 2)
