"""Posts made from odd events: few reshared texts, events of no type, most posts without a link."""

import random

import pytest
from pyspark.sql import functions as F

from opinion_spark import fixtures as fx
from opinion_spark.operators import reshares


@pytest.fixture
def small(table, tmp_path):
    kinds = ["click", "view", "purchase", "error", "signup", None]
    events = [(i, i % 5, kinds[i % 6], f'{{"k": {i % 4}}}') for i in range(600)]
    # texts that do not compress, so that the whole table is far larger than the four reshared rows
    texts = [(i, f"text {i} {random.Random(i).randbytes(1000).hex()}") for i in range(400)]
    frames = {
        "events": table(events, "event_id bigint, user_id bigint, event_type string, props string").withColumn(
            "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        ),
        "documents": table(texts, "doc_id bigint, text string"),
        "pages": table([(i, f"http://h/{i}") for i in range(30)], "page_id bigint, url string"),
    }
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_every_event_is_a_post_with_its_texts_and_links(spark, small):
    posts = fx.posts(spark, small, texts=True, reshared=True, urls=True).collect()
    got = {p["tweet_id"]: p for p in posts}
    assert len(posts) == 600 and fx.raw_posts(spark, small).count() == 600
    untyped = [p for p in posts if p["is_retweet"] is None]
    assert len(untyped) == 100 and not any(p["urls"] or p["retweeted_text"] for p in untyped)
    assert got[6]["retweeted_text"].startswith("text 2 ") and got[406]["text"].startswith("text 6 ")
    assert [u["url"] for u in got[32]["urls"]] == ["http://h/2", "http://h/15"]
    assert [u["url"] for u in got[31]["urls"]] == ["http://h/1"] and got[30]["urls"] == []


def test_reshared_texts_come_to_the_rows(spark, small, conf):
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "100000")
    for posts in (fx.raw_posts(spark, small), fx.posts(spark, small, texts=True, reshared=True)):
        plan = posts._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(own_id#" in plan and "hashpartitioning(k#" not in plan


def test_lists_of_texts_are_those_packed_from_whole_texts(table):
    from opinion_spark.operators import reshares

    posts = table(
        [(i, i % 4, False, 1, "abc"[i % 3] * (1 + i % 3), None) for i in range(24)],
        "tweet_id bigint, user_id bigint, is_retweet boolean, retweet_count bigint, text string, retweeted_text string",
    )
    edges = reshares.retweet_edges(posts, th=2)
    want = reshares.user_rt_list(reshares.with_texts(edges, posts)).collect()
    got = reshares.user_text_list(edges, posts)
    assert sorted(got.collect()) == sorted(want) and len(want) == 4
    cut = reshares.user_text_list(edges, posts, part_bytes=4).select("user_id", "part", F.explode("items")).collect()
    assert len(cut) == 12 and len({r["part"] for r in cut}) > 1


def test_votes_meet_by_digest(table, conf):
    from opinion_spark.operators.opinion import user_opinion

    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    items = table([(1, "YQ=="), (2, "Yg==")], "user_id bigint, item string")
    votes = user_opinion(items, table([("a", 1), ("b", 0)], "rt string, opinion int"), digests=False)
    assert sorted(map(tuple, votes.collect())) == [(1, 1), (2, 0)]
    assert "sha2(" in votes._jdf.queryExecution().optimizedPlan().toString()


def test_sequence_files_are_compressed(table, tmp_path):
    from opinion_spark.sources import files

    files.write_sequence(table([(i, "the same text " * 50) for i in range(200)], "key bigint, raw string"), f"{tmp_path}/q")
    assert sum(f.stat().st_size for f in (tmp_path / "q").glob("part-*")) < 200 * 700 / 4


def test_pages_crawled_twice(spark, table, tmp_path):
    import __spark_entry__ as entry

    urls = ["http://a/1.html", "http://a/1.html", "http://a/2", "http://a/3.html"]
    pages = table([(i, u, f"<title>T</title>{i}") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["resolve_redirects"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("url", "final").collect())) == [
        ("http://a/1.html", "http://a/1.html"), ("http://a/2", "http://a/3.html"), ("http://a/3.html", "http://a/3.html")
    ]


def test_titles_of_every_crawl(table):
    from opinion_spark.operators import links

    counts = table([("u", 10), ("v", 10)], "url string, n bigint")
    pages = table(
        [("u", "<title>A</title>"), ("u", "<title>B</title>"), ("v", "<title>B</title>"), ("v", "none")],
        "url string, html string",
    )
    got = links.topic_url_title(counts, pages, every_crawl=True)
    assert sorted(map(tuple, got.collect())) == [("", 1), ("A", 1), ("B", 2)]


def test_posts_without_a_link_are_spread(spark, small, conf):
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    posts = fx.posts(spark, small, urls=True)
    sizes = posts.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert max(r["count"] for r in sizes) < 200


def test_posts_are_not_sorted_for_their_links(spark, small, conf):
    """The page addresses are hashed, so a task's memory does not follow its share of the posts."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = fx.posts(spark, small, urls=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


def test_reshares_of_digested_posts_are_those_of_texts(spark, small):
    """Posts with digests in place of texts give the same edges, and carry no text."""
    posts = fx.posts(spark, small, texts=True, reshared=True)
    digested = fx.posts(spark, small, texts=True, reshared=True, digests=True)
    longest = F.greatest(F.max(F.length("digest")), F.max(F.length("retweeted_digest")))
    assert digested.agg(longest).first()[0] == 64 and "text" not in digested.columns
    for th in (1, 3):
        want, got = (sorted(map(tuple, reshares.retweet_edges(x, th).collect())) for x in (posts, digested))
        assert want and got == want
