import json

from pyspark.sql import functions as F

from opinion_spark.functions.text import from_base64, html_title, one_line, strict_long, to_base64
from opinion_spark.functions.times import readable
from opinion_spark.operators import counts, keywords, links
from opinion_spark.schemas import RAW_POST
from opinion_spark.sources.posts import parse_posts
from util import rows


def post(pid, user=1, text="x", urls=(), reshared=None, created="Sat Jul 27 00:00:00 +0000 2013"):
    return json.dumps(
        {
            "id": pid,
            "created_at": created,
            "text": text,
            "retweet_count": 0,
            "user": None if user is None else {"id": user},
            "retweeted_status": reshared,
            "entities": {"urls": [{"url": u, "expanded_url": e} for u, e in urls]},
        }
    )


def test_parse_keeps_failures_with_null_id(table):
    raw = table(
        [
            (1, post(10, urls=[("s1", "long1"), ("s2", None)])),
            (0, ""),
            (2, "{bad"),
            (3, None),
            (4, post(11, user=None)),
            (5, post(12, reshared={"id": 9, "text": "orig"})),
        ],
        RAW_POST,
    )
    parsed = {r.key: r for r in parse_posts(raw).collect()}
    assert len(parsed) == 6
    assert [parsed[k].tweet_id for k in (1, 0, 2, 3, 4, 5)] == [10, None, None, None, 11, 12]
    assert parsed[1].created_ms == 1374883200000
    assert [(u.url, u.expanded_url) for u in parsed[1].urls] == [("s1", "long1"), ("s2", None)]
    assert parsed[4].user_id is None
    assert not parsed[1].is_retweet and parsed[5].is_retweet
    assert (parsed[5].retweeted_id, parsed[5].retweeted_text) == (9, "orig")
    assert parsed[2].urls == []


def test_parse_reads_the_json_once(table):
    raw = table([(1, post(1))], RAW_POST)
    daily = counts.daily_freq(parse_posts(raw), 0, originals_only=True)
    for df in (counts.user_tweet_count(parse_posts(raw)), daily):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1


def test_counts(table):
    raw = table(
        [(1, post(1)), (1, post(2)), (2, post(3, user=2)), (0, ""), (0, "x"), (5, "{bad")], RAW_POST
    )
    assert rows(counts.tweet_count(raw)) == [("errorNum", 2), ("tweetNum", 4)]
    per_user = counts.user_tweet_count(parse_posts(raw))
    assert rows(per_user) == [(1, 2), (2, 1)]
    assert rows(counts.user_count(per_user)) == [("1", 1), ("2", 1), ("userNum", 2)]
    assert rows(counts.histogram(per_user)) == [(1, 1), (2, 1)]


def test_tweet_count_leaves_out_zero_rows(table):
    assert rows(counts.tweet_count(table([(1, "{}")], RAW_POST))) == [("tweetNum", 1)]


def test_user_count_threshold_is_strict(table):
    per_user = table([(1, 10), (2, 11)], "user_id bigint, n bigint")
    assert rows(counts.filter_user_counts(per_user, 10)) == [(2, 11)]


def test_daily_buckets(table):
    day, anchor = 86_400_000, 1_374_850_800_000
    times = [anchor, anchor + day - 1, anchor + day, anchor - 30 * day, anchor - 30 * day - 1]
    posts = table(
        [(i, t, i == 0) for i, t in enumerate(times)],
        "tweet_id bigint, created_ms bigint, is_retweet boolean",
    )
    got = counts.daily_freq(posts, anchor, tz="Asia/Tokyo", label="JST")
    assert rows(got, "day_ms", "n") == [(0, 2), (anchor - 30 * day, 1), (anchor, 2)]
    names = {r.day_ms: r.day for r in got.collect()}
    assert names[anchor] == "Sat Jul 27 00:00:00 JST 2013"
    originals = counts.daily_freq(posts, anchor, originals_only=True)
    assert rows(originals, "day_ms", "n") == [(0, 2), (anchor - 30 * day, 1), (anchor, 1)]


def test_readable_does_not_depend_on_the_session_zone(table, conf):
    conf("spark.sql.session.timeZone", "America/New_York")
    df = table([(1374883200000,)], "ms bigint").select(readable(F.col("ms")).alias("t"))
    assert rows(df) == [("Sat Jul 27 00:00:00 UTC 2013",)]


def test_retweet_count(table):
    posts = table(
        [(1, True, 7), (2, True, 7), (3, False, None), (4, True, None), (None, True, 7)],
        "tweet_id bigint, is_retweet boolean, retweeted_id bigint",
    )
    assert rows(counts.retweet_count(posts)) == [(7, 2)]


def test_keywords(table):
    posts = parse_posts(
        table(
            [
                (1, post(1, text="a 自民党 b 民主党 自民党")),
                (0, post(2, text="民主党")),
                (3, post(3, text="none")),
                (4, "{bad"),
            ],
            RAW_POST,
        )
    )
    assert rows(keywords.keyword_filter(posts, ["自民党", "民主党"]), "tweet_id") == [(1,)]
    assert rows(keywords.topic_posts(posts, ["民主党"]), "tweet_id") == [(1,), (2,)]
    assert rows(keywords.keyword_filter(posts, []), "tweet_id") == []
    assert rows(keywords.term_buzz(posts)) == [("民主党", 2), ("自民党", 1)]


def test_topic_links_keep_repeats(table):
    posts = parse_posts(
        table(
            [
                (8, post(1, text="topic", urls=[("u", None), ("u", None), ("v", "w")])),
                (9, post(2, text="other", urls=[("u", None)])),
            ],
            RAW_POST,
        )
    )
    assert rows(keywords.topic_url_user(posts, ["topic"])) == [("u", 8), ("u", 8), ("w", 8)]
    assert rows(keywords.topic_url_count(posts, ["topic"])) == [("u", 2), ("w", 1)]


def test_url_count_markers(table):
    posts = parse_posts(
        table(
            [
                (1, post(1, urls=[("u", None), ("u", None)])),
                (2, post(2)),
                (3, "{bad"),
                (0, post(4, urls=[("u", None)])),
            ],
            RAW_POST,
        )
    )
    assert rows(links.url_count(posts)) == [("noURL", 2), ("u", 2), ("withURL", 1)]
    assert rows(links.url_count(posts, markers=False)) == [("u", 2)]


def test_text_functions(table):
    long = "日本語, tab\tand\nnewline " * 20
    df = table([(long,)], "t string")
    encoded = to_base64(F.col("t"))
    got = df.select(encoded, from_base64(encoded), one_line(F.col("t"))).first()
    assert "\r" not in got[0] and "\n" not in got[0] and got[1] == long
    assert got[2] == "日本語， tab and newline " * 20
    tokens = table([("7",), (" 7",), ("+7",), ("7x",), ("",), ("9" * 30,)], "t string")
    assert [r[0] for r in tokens.select(strict_long(F.col("t"))).collect()] == [
        7, None, 7, None, None, None,
    ]


def test_html_title(table):
    pages = [
        ("<html><TITLE lang='x'>\n A &amp; B\t C </TITLE><title>no</title>",),
        ("<p>none</p>",),
        ("<title></title>",),
        (None,),
    ]
    got = table(pages, "h string").select(html_title(F.col("h"))).collect()
    assert [r[0] for r in got] == ["A & B C", None, "", None]
