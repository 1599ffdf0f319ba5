import pytest
from pyspark.sql import functions as F

from opinion_spark.functions.urls import is_malformed, trim_url
from opinion_spark.operators import links
from opinion_spark.operators.redirects import expand_once, resolve_redirects
from util import rows


@pytest.mark.parametrize(
    "url,expected",
    [
        ("http://a.jp/x#top", "http://a.jp/x"),
        ("http://a.jp/x#", "http://a.jp/x"),
        ("http://a.jp/x?id=12", "http://a.jp/x?id=12"),
        ("http://a.jp/x?id=12#top", "http://a.jp/x?id=12"),
        ("http://a.jp/x?q=abc", "http://a.jp/x"),
        ("http://a.jp/x?q=abc&id=3", "http://a.jp/x?q=abc&id=3"),
        ("http://a.jp/x?id=3b", "http://a.jp/x"),
        ("http://a.jp/x?12", "http://a.jp/x"),
        ("http://a.jp/x?", "http://a.jp/x"),
        ("http://a.jp/null/x", "http://a.jp/null/x"),
        ("http://a.jp/top#top", "http://a.jp/top"),
        ("no url?q=a#b", "no url?q=a#b"),
        ("http://t.co/Abc123", "http://t.co/Abc123"),
    ],
)
def test_trim_url(table, url, expected):
    assert table([(url,)], "u string").select(trim_url(F.col("u"))).first()[0] == expected


def test_is_malformed(table):
    urls = ["http://a.jp", "HTTPS://a.jp:80/x", "a.jp/x", "http://a.jp:x1/", "http://u:p@a.jp/", ""]
    got = table([(u,) for u in urls], "u string").select(is_malformed(F.col("u"))).collect()
    assert [r[0] for r in got] == [False, False, True, True, False, True]


def chain(name, hops):
    return [(f"http://{name}/{i}", f"http://{name}/{i + 1}") for i in range(hops)]


def test_redirect_chains(table):
    steps = chain("one", 1) + chain("eight", 8) + chain("nine", 9)
    steps += [("http://x/a", "http://x/b"), ("http://x/b", "http://x/a")]
    steps += [("http://m/0", "http://m/1"), ("http://m/1", "nowhere")]
    steps += [("http://d/0", "http://d/1")]
    redirects = table(steps, "src string, dst string")
    starts = ["one/0", "eight/0", "eight/8", "nine/0", "nine/1", "x/a", "m/0", "d/0", "plain"]
    urls = table([(f"http://{s}",) for s in starts] + [("bad start",)], "url string")
    dead = table([("http://d/1",)], "url string")
    kept = {
        "http://one/0": "http://one/1",
        "http://eight/0": "http://eight/8",
        "http://eight/8": "http://eight/8",
        "http://nine/0": "http://nine/0",
        "http://nine/1": "http://nine/9",
        "http://x/a": "http://x/a",
        "http://d/0": "http://d/0",
        "http://plain": "http://plain",
    }
    drop = resolve_redirects(urls, redirects, on_malformed="drop", unreachable=dead)
    assert dict(rows(drop, "url", "final")) == kept
    keep = resolve_redirects(urls, redirects, on_malformed="keep", unreachable=dead)
    assert dict(rows(keep, "url", "final")) == kept | {
        "http://m/0": "http://m/0",
        "bad start": "bad start",
    }
    with pytest.raises(ValueError):
        resolve_redirects(urls, redirects, on_malformed="maybe")


def test_redirect_duplicates_do_not_multiply_rows(table):
    redirects = table([("http://a", "http://b"), ("http://a", "http://c")], "src string, dst string")
    urls = table([("http://a",)], "url string")
    assert rows(resolve_redirects(urls, redirects), "url", "final") == [("http://a", "http://c")]


def test_expand_once_sums_equal_targets(table):
    url_counts = table(
        [("http://a", 2), ("http://b", 3), ("http://dead", 5), ("24", 7), ("http://c", 1)],
        "url string, n bigint",
    )
    redirects = table(
        [("http://a", "http://z"), ("http://b", "http://z"), ("http://z", "http://y")],
        "src string, dst string",
    )
    dead = table([("http://dead",)], "url string")
    got = rows(expand_once(url_counts, redirects, dead))
    assert got == [("http://c", 1), ("http://z", 5)]


def test_buzz(table):
    url_counts = table(
        [("b", 101), ("a", 101), ("c", 100), ("withURL", 900), ("noURL", 900), ("d", 300)],
        "url string, n bigint",
    )
    buzz = links.buzz_extract(url_counts)
    assert rows(buzz) == [(101, 0, "a b"), (300, 0, "d")]
    parts = links.buzz_extract(url_counts.withColumn("n", F.lit(500).cast("bigint")), 1, part_bytes=1)
    joined = [u for r in parts.collect() for u in r.urls.split(" ")]
    assert sorted(joined) == ["a", "b", "c", "d"]


URLS = "array<struct<url:string,expanded_url:string>>"


def shared(table, pairs):
    return table(
        [(i, u, [(url, None)]) for i, (url, u) in enumerate(pairs)],
        f"tweet_id bigint, user_id bigint, urls {URLS}",
    )


def test_url_refer(table):
    pairs = [("http://a#1", 1), ("http://a#2", 2), ("http://a", 2), ("http://b", 1), ("http://c", 3)]
    pairs += [("http://c", 2), ("http://m", 1), ("http://m", 2)]
    redirects = table([("http://a", "http://c"), ("http://m", "nowhere")], "src string, dst string")
    got = links.url_refer(shared(table, pairs), redirects, th=2)
    # a has two users and moves to c, c has two of its own, b has one, m ends nowhere.
    assert rows(got) == [("http://c", 1), ("http://c", 2), ("http://c", 2), ("http://c", 3)]


def test_url_expand(table):
    url_counts = table([("http://a", 2), ("http://c", 3), ("bad", 4)], "url string, n bigint")
    redirects = table([("http://a", "http://c")], "src string, dst string")
    assert rows(links.url_expand(url_counts, redirects)) == [("bad", 4), ("http://c", 5)]


def test_topic_url_title(table):
    url_counts = table([("u1", 10), ("u2", 10), ("u3", 9), ("u4", 50)], "url string, n bigint")
    pages = table(
        [
            ("u1", "<title>T</title>"),
            ("u1", "<title>T</title>"),
            ("u2", "<title>T</title>"),
            ("u3", "<title>T</title>"),
            ("u4", "no title"),
        ],
        "url string, html string",
    )
    assert rows(links.topic_url_title(url_counts, pages)) == [("T", 2)]


def test_only_open_chains_are_joined_again(table, monkeypatch):
    """Rows per round, and the same ends as walking each chain."""
    from opinion_spark.operators import redirects as red

    seen = []
    then = red._then
    monkeypatch.setattr(red, "_then", lambda a, b: seen.append(a.where("_on").count()) or then(a, b))
    pairs = [(f"http://a/{i}", f"http://end/{i}") for i in range(50)]
    pairs += [(f"http://b/{i}", f"http://b/{i + 1}") for i in range(3)] + [("http://l/0", "http://l/1"), ("http://l/1", "http://l/0")]
    pairs += [(f"http://long/{i}", f"http://long/{i + 1}") for i in range(20)]
    step = dict(pairs)
    urls = sorted({u for p in pairs for u in p})

    def walked(url):
        chain = [url]
        while chain[-1] in step and len(chain) < 10:
            chain.append(step[chain[-1]])
        return url if chain[-1] in step or len(chain) >= 10 else chain[-1]

    got = red.resolve_redirects(table([(u,) for u in urls], "url string"), table(pairs, "src string, dst string"))
    assert rows(got, "url", "final") == sorted((u, walked(u)) for u in urls)
    assert seen == sorted(seen, reverse=True) and seen[0] == 2 + 2 + 19 and len(seen) == 3
    seen.clear()
    short = table(pairs[:53], "src string, dst string")
    red.resolve_redirects(table([(u,) for u in urls], "url string"), short).collect()
    assert seen == [2, 1]
