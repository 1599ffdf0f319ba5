
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from opinion_spark import fixtures as fx  # noqa: E402
from opinion_spark.functions.urls import trim_url  # noqa: E402
from opinion_spark.operators import audiences, counts, item_sets, keywords, links  # noqa: E402
from opinion_spark.operators import hubs, network, opinion, reshares, similarity, top_links  # noqa: E402
from opinion_spark.operators.redirects import resolve_redirects  # noqa: E402
from opinion_spark.plans import chains, handover  # noqa: E402
from opinion_spark.sources.files import side_list  # noqa: E402
from opinion_spark.sources.network import parse_network  # noqa: E402
from opinion_spark.sources.posts import linked_urls, parse_posts  # noqa: E402
from opinion_spark.staging import fresh_path  # noqa: E402

try:
    import opinion_spark.llm.registry as llm  # noqa: E402
except ModuleNotFoundError as error:
    if not (error.name or "").startswith(("opinion_spark.llm", "corpus_pipeline")):
        raise
    llm = None


class Params:
    """Thresholds of the registered queries, chosen so that each keeps some rows and drops some."""

    MIN_POSTS = 50
    BUZZ = 24
    URL_USERS = 20
    LIST_USERS = 40
    URL_JACCARD = 0.15
    RT_USERS = 10
    RT_JACCARD = 0.15
    PART_JACCARD = 0.3
    TOP_LINKS = 5
    USER_TEXTS = 10
    TITLE_MENTIONS = 8
    FOLLOW_LIMIT = 1200
    PART_TOKENS = 8


P = Params


def entry(spark: SparkSession) -> DataFrame:
    """Which texts are reshared by the same users."""
    posts = _shared_posts(spark, "/root/testdata/sf0.001")
    return chains.reshare_network(posts, th=2, jaccard=0.2)


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return fx.posts(spark, d)


def _text_posts(spark: SparkSession, d: str) -> DataFrame:
    return fx.posts(spark, d, texts=True)


def _shared_posts(spark: SparkSession, d: str) -> DataFrame:
    return fx.posts(spark, d, texts=True, reshared=True)


def _url_posts(spark: SparkSession, d: str) -> DataFrame:
    return fx.posts(spark, d, urls=True)


def _topic_posts(spark: SparkSession, d: str) -> DataFrame:
    return fx.posts(spark, d, texts=True, urls=True)


def _user_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.user_tweet_count(_posts(spark, d))


def _url_counts(spark: SparkSession, d: str) -> DataFrame:
    return links.url_count(_url_posts(spark, d))


def _plain_url_counts(spark: SparkSession, d: str) -> DataFrame:
    return links.url_count(_url_posts(spark, d), markers=False)


def _daily(spark: SparkSession, d: str, originals_only: bool) -> DataFrame:
    return counts.daily_freq(
        _posts(spark, d), fx.ANCHOR_MS, 31, originals_only, tz="Asia/Tokyo", label="JST"
    )


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    posts = parse_posts(fx.raw_posts(spark, d)).drop("raw")
    urls = F.transform("urls", lambda u: F.coalesce(u["expanded_url"], u["url"]))
    return posts.withColumn("urls", F.array_join(urls, " "))


def _buzz(spark: SparkSession, d: str) -> DataFrame:
    return links.buzz_extract(_url_counts(spark, d), P.BUZZ)


def _url_refer(spark: SparkSession, d: str) -> DataFrame:
    redirects = fx.redirects(spark, d, trimmed=True)
    return links.url_refer(_url_posts(spark, d), redirects, P.URL_USERS)


def _url_edges(spark: SparkSession, d: str) -> DataFrame:
    return linked_urls(_url_posts(spark, d), "user_id").withColumnRenamed("url", "item").where("user_id IS NOT NULL")


def _numbered_url_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = _url_edges(spark, d)
    return edges, audiences.user_numbers(edges)


def _host(url: str) -> Column:
    return F.coalesce(F.get(F.split(url, "/"), 2), F.lit(""))


def _url_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    return audiences.audience_bitmaps(*_numbered_url_edges(spark, d))


def _url_sets(spark: SparkSession, d: str) -> DataFrame:
    return item_sets.item_sets(_url_refer(spark, d).withColumnRenamed("url", "item"))


def _topic_url_user(spark: SparkSession, d: str) -> DataFrame:
    return keywords.topic_url_user(_topic_posts(spark, d), fx.TOPICS)


def _topic_url_title(spark: SparkSession, d: str) -> DataFrame:
    mentions = keywords.topic_url_count(_topic_posts(spark, d), fx.TOPICS)
    return links.topic_url_title(mentions, fx.pages(spark, d), P.TITLE_MENTIONS, every_crawl=True)


def _filter_url(spark: SparkSession, d: str) -> DataFrame:
    edges = _topic_url_user(spark, d).select(F.col("url").alias("item"), F.col("key").alias("user_id"))
    return _joined_users(item_sets.item_sets(edges, drop_quoted=True))


def _joined_users(sets: DataFrame) -> DataFrame:
    return sets.select("item", "n", "part", F.array_join("users", ",").alias("users"))


def _seq_to_text(spark: SparkSession, d: str) -> DataFrame:
    urls = _url_counts(spark, d).select(F.col("url").alias("key"), F.col("n").alias("value"))
    reshared = counts.retweet_count(_posts(spark, d)).select(
        F.col("retweeted_id").cast("string").alias("key"), F.col("n").alias("value")
    )
    crawled = fx.pages(spark, d).select(
        F.col("url").alias("key"), F.lit(1).cast("bigint").alias("value")
    )
    return counts.sum_by_key(urls.unionByName(reshared).unionByName(crawled))


def _paired_url(spark: SparkSession, d: str) -> DataFrame:
    posts = _url_posts(spark, d)

    def lists(n_links: int) -> DataFrame:
        rows = posts.where(F.size("urls") == n_links)
        return item_sets.item_sets(linked_urls(rows, "user_id").withColumnRenamed("url", "item"))

    sets = item_sets.latest_sets(lists(1), lists(2))
    return similarity.item_pairs(
        item_sets.unpack(sets, "item", "users", "user_id"), P.URL_JACCARD
    )


def _digested_posts(spark: SparkSession, d: str) -> DataFrame:
    return fx.posts(spark, d, texts=True, reshared=True, digests=True)


def _rt_edges(spark: SparkSession, d: str) -> DataFrame:
    return reshares.retweet_edges(_digested_posts(spark, d), P.RT_USERS)


def _rt_texts(spark: SparkSession, d: str) -> DataFrame:
    return reshares.with_texts(_rt_edges(spark, d), _shared_posts(spark, d))


def _text_lists(spark: SparkSession, d: str) -> DataFrame:
    return reshares.user_text_list(_rt_edges(spark, d), _shared_posts(spark, d))


def _rt_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.item_pairs(_rt_edges(spark, d), P.RT_JACCARD)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _net(spark: SparkSession, d: str) -> DataFrame:
    return parse_network(fx.raw_network(spark, d))


def _uf(spark: SparkSession, d: str) -> DataFrame:
    return side_list(fx.uf_list(spark, d))


def _uo(spark: SparkSession, d: str) -> DataFrame:
    return side_list(fx.uo_list(spark, d))


def _exposure(spark: SparkSession, d: str) -> DataFrame:
    return chains.opinion_exposure(
        _digested_posts(spark, d), fx.rt_opinions(spark, d), fx.follows(spark, d), P.RT_USERS
    )


def _count_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _url_counts(spark, d).select(F.col("url").alias("key"), F.col("n").alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per job; each takes ``(spark, sf_dir)``."""
    return _jobs() | (llm.QUERIES if llm else {})


def _jobs() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # counts and time
        "tweet_count": lambda s, d: counts.tweet_count(fx.raw_posts(s, d)),
        "parse_posts": _parsed,
        "user_tweet_count": _user_counts,
        "filter_user_counts": lambda s, d: counts.filter_user_counts(
            _user_counts(s, d), P.MIN_POSTS
        ),
        "user_count": lambda s, d: counts.user_count(_user_counts(s, d)),
        "activity_histogram": lambda s, d: chains.activity_histogram(_posts(s, d), P.MIN_POSTS),
        "time_series": lambda s, d: counts.time_series(_posts(s, d)),
        "time_stamp": lambda s, d: counts.time_stamp(_posts(s, d)),
        "daily_freq": lambda s, d: _daily(s, d, originals_only=False),
        "original_daily_freq": lambda s, d: _daily(s, d, originals_only=True),
        "retweet_count": lambda s, d: counts.retweet_count(_posts(s, d)),
        "retweet_freq": lambda s, d: counts.histogram(counts.retweet_count(_posts(s, d))),
        # words and links
        "keyword_filter": lambda s, d: keywords.keyword_filter(
            _text_posts(s, d), fx.KEYWORDS
        ).select("key", "tweet_id", "text"),
        "keyword_filter_by_table": lambda s, d: keywords.keyword_filter_by_table(
            _text_posts(s, d), fx.term_table(s, d)
        ).select("key", "tweet_id", "text"),
        "term_buzz_by_table": lambda s, d: keywords.term_buzz_by_table(
            _text_posts(s, d), fx.term_table(s, d)
        ),
        "term_buzz": lambda s, d: keywords.term_buzz(_text_posts(s, d), fx.BUZZ_TERMS),
        "url_count": _url_counts,
        "url_freq": lambda s, d: counts.histogram(_url_counts(s, d)),
        "buzz_extract": _buzz,
        "buzz_url_expand": lambda s, d: links.buzz_url_expand(
            _buzz(s, d), fx.redirects(s, d), fx.unreachable(s, d)
        ),
        "trim_url": lambda s, d: fx.pages(s, d).select(
            "url", trim_url(F.col("url")).alias("trimmed")
        ),
        "resolve_redirects": lambda s, d: resolve_redirects(
            fx.pages(s, d).select("url").distinct(), fx.redirects(s, d)
        ),
        "url_refer": _url_refer,
        "url_refer_list": lambda s, d: _joined_users(_url_sets(s, d)),
        "threshold_item_sets": lambda s, d: _joined_users(
            item_sets.threshold_item_sets(_url_sets(s, d), P.LIST_USERS)
        ),
        "url_expand": lambda s, d: links.url_expand(_plain_url_counts(s, d), fx.redirects(s, d)),
        "topic_url_count": lambda s, d: keywords.topic_url_count(_topic_posts(s, d), fx.TOPICS),
        "topic_url_user": _topic_url_user,
        "topic_url_title": _topic_url_title,
        "filter_url": _filter_url,
        "seq_to_text": _seq_to_text,
        # audiences
        "paired_url": _paired_url,
        "item_pairs": _rt_pairs,
        "jaccard_of_pairs": lambda s, d: _rounded(
            similarity.jaccard_of_pairs(_rt_pairs(s, d), P.RT_JACCARD), "jaccard"
        ),
        "jaccard_links": lambda s, d: _rounded(
            similarity.jaccard_links(fx.part_sets(s, d), P.PART_JACCARD), "jaccard"
        ),
        "jaccard_top_links": lambda s, d: _rounded(
            top_links.top_links(fx.part_sets(s, d), P.TOP_LINKS), "jaccard"
        ),
        "jaccard_links_dec": lambda s, d: _rounded(
            chains.reshare_network(_shared_posts(s, d), P.RT_USERS, P.RT_JACCARD), "jaccard"
        ),
        "link_network": lambda s, d: _rounded(
            chains.link_network(
                _url_posts(s, d), fx.redirects(s, d, trimmed=True), P.URL_USERS, P.URL_JACCARD
            ),
            "jaccard",
        ),
        "audience_sizes": lambda s, d: audiences.audience_sizes(_url_bitmaps(s, d)),
        "audience_sizes_by_host": lambda s, d: audiences.audience_sizes(
            audiences.rolled_up(_url_bitmaps(s, d).withColumn("host", _host("item")), ["host"]), ["host"]
        ),
        "items_at_least": lambda s, d: audiences.items_at_least(
            *_numbered_url_edges(s, d), P.URL_USERS
        ),
        "frequent_edges": lambda s, d: item_sets.at_least(
            item_sets.may_reach(_url_edges(s, d), "item", P.URL_USERS), "item", P.URL_USERS
        ),
        # reshares and opinions
        "retweet_sets": lambda s, d: _joined_users(
            reshares.retweet_sets(_shared_posts(s, d), P.RT_USERS)
        ),
        "user_rt_freq": lambda s, d: reshares.user_rt_freq(_rt_edges(s, d), P.USER_TEXTS),
        "user_rt_list": lambda s, d: _text_lists(s, d).select(
            "user_id", "n", "part", F.array_join("items", ",").alias("items")
        ),
        "user_opinion": lambda s, d: opinion.user_opinion(
            _rt_edges(s, d), fx.rt_opinions(s, d)
        ),
        "user_opinion_base64": lambda s, d: opinion.user_opinion(
            _rt_texts(s, d), fx.rt_opinions(s, d, encoded=True), key="base64", digests=False
        ),
        "user_opinion_normalised": lambda s, d: opinion.user_opinion(
            _rt_texts(s, d), fx.rt_opinions(s, d), digests=False, normalise=True
        ),
        "opinion_exposure": lambda s, d: _rounded(_exposure(s, d), "avg_opinion"),
        # follow network
        "filter_network_by_profile": lambda s, d: network.filter_network_by_profile(
            _net(s, d), follow_limit=P.FOLLOW_LIMIT
        ).select("profile", "csv"),
        "filter_network_by_list": lambda s, d: network.filter_network_by_list(
            _net(s, d), _uf(s, d), P.FOLLOW_LIMIT
        ).select("profile", "csv"),
        "drop_profile_and_filter": lambda s, d: network.drop_profile_and_filter(
            _net(s, d), _uf(s, d), P.FOLLOW_LIMIT
        ),
        "following_only": lambda s, d: network.following_only(_net(s, d)),
        "simplify_network": lambda s, d: network.simplify_network(_net(s, d), P.FOLLOW_LIMIT),
        "simplify_all": lambda s, d: network.simplify_all(_net(s, d), P.FOLLOW_LIMIT),
        "follow_rows": lambda s, d: network.follow_rows(
            network.simplify_all(_net(s, d), follow_limit=None)
        ),
        "follow_rows_of_parts": lambda s, d: network.follow_rows(
            hubs.simplify_parts(fx.raw_network_parts(s, d, P.PART_TOKENS), follow_limit=None)
        ),
        "annotate_following": lambda s, d: network.annotate_following(
            _net(s, d), _uf(s, d), follow_limit=P.FOLLOW_LIMIT
        ),
        "vocal_rate": lambda s, d: _rounded(
            network.vocal_rate(fx.follows(s, d), _uf(s, d)), "vocal_rate"
        ),
        "vocal_rate_avg": lambda s, d: _rounded(
            network.vocal_rate_avg(fx.follows(s, d), _uf(s, d)), "vocal_rate"
        ),
        "vocal_avg": lambda s, d: _rounded(
            network.vocal_avg(fx.follows(s, d), _uf(s, d)), "vocal_avg", "total_avg"
        ),
        "neighbor_opinion": lambda s, d: _rounded(
            network.neighbor_opinion(fx.follows(s, d), _uo(s, d)), "avg_opinion"
        ),
        "degree_hist_by_opinion": lambda s, d: network.degree_hist_by_opinion(
            fx.accounts(s, d), _uo(s, d)
        ),
        "degree_hist": lambda s, d: network.degree_hist(
            network.follower_counts(network.simplify_network(_net(s, d), None))
        ),
        # chains through files
        "sequence_posts": lambda s, d: handover.posts_per_user(
            fx.raw_posts(s, d), fresh_path(s, "posts")
        ),
        "sequence_counts": lambda s, d: handover.counts_as_text(
            _count_pairs(s, d), fresh_path(s, "counts")
        ),
        "sequence_network": lambda s, d: handover.listed_network(
            fx.raw_network(s, d), fx.uf_list(s, d), fresh_path(s, "network"), P.FOLLOW_LIMIT
        ),
        "sequence_user_items": lambda s, d: handover.user_items(
            _text_lists(s, d), fresh_path(s, "items")
        ),
        "text_item_sets": lambda s, d: handover.item_users(_url_sets(s, d), fresh_path(s, "sets")),
        "text_terms": lambda s, d: handover.keyword_buzz(
            _text_posts(s, d), fx.term_table(s, d), fresh_path(s, "terms")
        ),
        "text_opinions": lambda s, d: handover.opinion_by_file(
            _rt_texts(s, d), fx.rt_opinions(s, d, encoded=True), fresh_path(s, "opinions")
        ),
        "sorted_lines": lambda s, d: handover.ranked_lines(_count_pairs(s, d), fresh_path(s, "sorted")),
    }


def oracle_sql() -> dict[str, str]:
    """The same queries as SQL over the driver tables."""
    return oracles.sql(Params) | (llm.ORACLES if llm else {})
