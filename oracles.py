"""The registered queries as plain SQL over the driver tables."""

from __future__ import annotations

from opinion_spark import fixtures as fx

# --- the fixture rules of opinion_spark.fixtures, once more in SQL ---

POSTS = """
ev AS (
  SELECT *, event_type = 'error' AS failed, user_id + 1 AS author,
         CAST(props->>'$.k' AS BIGINT) AS k,
         epoch_us(ts) // 1000000 * 1000 AS ms
  FROM events),
posts AS (
  SELECT event_id, event_type,
         CASE WHEN failed AND event_id % 2 = 1 THEN 0 ELSE author END AS key,
         CASE WHEN NOT failed THEN event_id END AS tweet_id,
         CASE WHEN NOT failed THEN author END AS user_id,
         CASE WHEN NOT failed THEN ms END AS created_ms,
         CASE WHEN NOT failed THEN event_id % 3 END AS retweet_count,
         event_type = 'click' AS is_retweet,
         CASE WHEN event_type = 'click' THEN k END AS retweeted_id
  FROM ev)"""

TEXTS = """
texts AS (
  SELECT p.*, CASE WHEN p.tweet_id IS NOT NULL THEN o.text END AS text, s.text AS retweeted_text
  FROM posts p
  LEFT JOIN documents o ON o.doc_id = p.event_id % (SELECT count(*) FROM documents)
  LEFT JOIN documents s ON s.doc_id = p.retweeted_id)"""

URLS = """
urls AS (
  SELECT p.event_id, p.event_type, p.key, p.tweet_id, p.user_id, 1 AS pos, g.url
  FROM posts p JOIN pages g ON g.page_id = p.event_id % (SELECT count(*) FROM pages)
  WHERE p.event_type IN ('view', 'purchase')
  UNION ALL
  SELECT p.event_id, p.event_type, p.key, p.tweet_id, p.user_id, 2, g.url
  FROM posts p JOIN pages g ON g.page_id = (p.event_id * 7 + 1) % (SELECT count(*) FROM pages)
  WHERE p.event_type = 'purchase')"""


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _trim(url: str) -> str:
    body = f"regexp_replace({url}, '#.*$', '')"
    numeric = f"regexp_matches(regexp_extract({body}, '\\?(.*)$', 1), '(^|&)[^=&]*=[0-9]+(=|&|$)')"
    return f"CASE WHEN {numeric} THEN {body} ELSE regexp_replace({body}, '\\?.*$', '') END"


def _redirects(trimmed: bool) -> str:
    src, dst = (_trim("a.url"), _trim("b.url")) if trimmed else ("a.url", "b.url")
    return f"""
steps AS (
  SELECT {src} AS src,
         CASE WHEN a.url LIKE '%#top' THEN regexp_replace({dst}, '^https?://', '')
              ELSE {dst} END AS dst
  FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.url NOT LIKE '%.html'),
red AS (SELECT src, max(dst) AS dst FROM steps GROUP BY src)"""


MALFORMED = r"NOT regexp_matches(cur, '(?i)^\s*(url:)?(https?|ftp|file|jar|mailto):')"


def _resolved(start: str, keep_malformed: bool) -> str:
    """CTEs that end in resolved(url, final) for the ``url`` column of ``start``."""
    looped = "cur IN (SELECT src FROM red)"
    if keep_malformed:
        final, rule = f"CASE WHEN {looped} OR {MALFORMED} THEN url ELSE cur END", "true"
    else:
        final, rule = f"CASE WHEN {looped} THEN url ELSE cur END", f"{looped} OR NOT ({MALFORMED})"
    return f"""
walk AS (
  SELECT DISTINCT url, url AS cur, 0 AS hop FROM {start}
  UNION ALL
  SELECT w.url, r.dst, w.hop + 1 FROM walk w JOIN red r ON r.src = w.cur WHERE w.hop < 8),
ends AS (SELECT url, arg_max(cur, hop) AS cur FROM walk GROUP BY url),
resolved AS (SELECT url, {final} AS final FROM ends WHERE {rule})"""


URL_COUNT = f"""{POSTS}, {URLS},
url_count AS (
  SELECT url, count(*) AS n FROM (
    SELECT url FROM urls WHERE key <> 0
    UNION ALL
    SELECT CASE WHEN event_type IN ('view', 'purchase') THEN 'withURL' ELSE 'noURL' END
    FROM posts WHERE key <> 0)
  GROUP BY url)"""

PLAIN_COUNT = "plain AS (SELECT url, n FROM url_count WHERE url NOT IN ('withURL', 'noURL'))"

UNREACHABLE = "dead AS (SELECT url FROM pages WHERE contains(url, '//m.'))"


def _url_refer(th: int) -> str:
    return f"""{POSTS}, {URLS}, {_redirects(True)},
shared AS (SELECT DISTINCT {_trim('url')} AS url, user_id FROM urls WHERE user_id IS NOT NULL),
kept AS (SELECT url FROM shared GROUP BY url HAVING count(*) >= {th}),
{_resolved('kept', False)},
url_refer AS (SELECT r.final AS url, s.user_id FROM shared s JOIN resolved r USING (url))"""


def _retweets(th: int) -> str:
    return f"""{POSTS}, {TEXTS},
shares AS (
  SELECT DISTINCT CASE WHEN is_retweet THEN retweeted_text
                       WHEN retweet_count > 0 THEN text END AS text, user_id
  FROM texts WHERE user_id IS NOT NULL),
kept AS (
  SELECT text FROM shares WHERE text IS NOT NULL GROUP BY text HAVING count(*) >= {th}),
edges AS (SELECT sha256(encode(text)) AS item, text, user_id FROM shares JOIN kept USING (text)),
encoded AS (SELECT base64(encode(text)) AS item, user_id FROM edges)"""


def _kept_edges(th: int) -> str:
    return f"""WITH {POSTS}, {URLS},
pairs AS (SELECT DISTINCT url AS item, user_id FROM urls WHERE user_id IS NOT NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM pairs)
SELECT item, user_id, n FROM sized WHERE n >= {th}"""


def _links(th: float) -> str:
    """CTEs that end in links(item1, item2, jaccard) for edges(item, user_id)."""
    return f"""
e AS (SELECT DISTINCT item, user_id FROM edges),
sizes AS (SELECT item, count(*) AS n FROM e GROUP BY item),
common AS (
  SELECT x.item AS item1, y.item AS item2, count(*) AS c
  FROM e x JOIN e y ON x.user_id = y.user_id AND x.item < y.item GROUP BY ALL),
links AS (
  SELECT item1, item2, c / (r1.n + r2.n - c) AS jaccard
  FROM common JOIN sizes r1 ON r1.item = item1 JOIN sizes r2 ON r2.item = item2
  WHERE c / (r1.n + r2.n - c) >= {th})"""


PAIRS = """
SELECT item1, item2, user_id, bool_or(in1) AS in1, bool_or(in2) AS in2 FROM (
  SELECT item1, item2, user_id, true AS in1, false AS in2 FROM links JOIN e ON item = item1
  UNION ALL
  SELECT item1, item2, user_id, false, true FROM links JOIN e ON item = item2)
GROUP BY ALL"""

ROUNDED = "SELECT item1, item2, round(jaccard, 9) AS jaccard FROM links"

PART_EDGES = """
edges AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS item, l_suppkey AS user_id FROM lineitem)"""


def _csv(column: str) -> str:
    return f"array_to_string(list_sort(list({column})), ',')"


def _sets(edges: str, having: str = "") -> str:
    return f"""SELECT item, count(*) AS n, CAST(0 AS INTEGER) AS part, {_csv('user_id')} AS users
FROM {edges} GROUP BY item {having}"""


FOLLOWS = """
fe AS (
  SELECT DISTINCT o_custkey AS user_id, o_orderkey * o_custkey % (SELECT count(*) FROM customer) AS followee
  FROM orders),
follows AS (
  SELECT c_custkey AS user_id, followee FROM customer LEFT JOIN fe ON fe.user_id = c_custkey
  WHERE c_acctbal >= 0),
accounts AS (
  SELECT c_custkey AS id,
         CASE WHEN c_acctbal < 0 THEN -1
              ELSE (SELECT count(*) FROM fe WHERE followee = c_custkey) END AS n_followers
  FROM customer)"""

UF = f"""
uf AS (
  SELECT o_custkey AS user_id, count(*) AS value FROM orders
  GROUP BY 1 HAVING count(*) >= {fx.UF_ORDERS})"""

UO = """
uo AS (
  SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS value
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"""

NETWORK = f"""{FOLLOWS}, {UF},
following AS (
  SELECT user_id AS id, count(*) AS n, {_csv('followee')} AS ids FROM fe GROUP BY 1),
followers AS (
  SELECT followee AS id, count(*) AS n, {_csv('user_id')} AS ids FROM fe GROUP BY 1),
rows AS (
  SELECT c_custkey AS id, c_acctbal < 0 AS protected,
         CASE WHEN c_nationkey % 2 = 0 THEN 'ja' WHEN c_nationkey % 3 = 0 THEN 'JA'
              ELSE 'en' END AS lang,
         coalesce(o.n, 0) AS n_following, coalesce(i.n, 0) AS n_followers,
         coalesce(o.ids, '') AS following, i.ids AS followers,
         coalesce(o.n, 0) * 100 AS friends_count
  FROM customer LEFT JOIN following o ON o.id = c_custkey LEFT JOIN followers i ON i.id = c_custkey),
net AS (
  SELECT *,
         '{{"id":' || id || ',"lang":"' || lang || '","friends_count":' || friends_count || '}}'
           AS profile,
         CASE WHEN protected THEN id || ',-1,-1'
              ELSE concat_ws(',', id, n_followers, n_following, followers, nullif(following, ''))
         END AS csv
  FROM rows)"""


def _neighbours(listed: str) -> str:
    return f"""
stats AS (
  SELECT f.user_id, own.value AS own, count(*) AS n_following, count(v.value) AS n_vocal,
         coalesce(sum(v.value), 0) AS total
  FROM follows f JOIN {listed} own ON own.user_id = f.user_id
  LEFT JOIN {listed} v ON v.user_id = f.followee
  GROUP BY ALL)"""


MEAN = "round(CASE WHEN n_vocal > 0 THEN total / n_vocal ELSE 0.0 END, 9)"

OPINIONS = """
opinions AS (
  SELECT text, max(quality) AS opinion FROM documents JOIN labels USING (doc_id) GROUP BY 1),
user_opinion AS (
  SELECT user_id, CAST(CASE WHEN zeros > ones THEN 0 ELSE 1 END AS INTEGER) AS value FROM (
    SELECT user_id, count(*) FILTER (opinion = 0) AS zeros, count(*) FILTER (opinion = 1) AS ones
    FROM edges JOIN opinions USING (text) GROUP BY user_id)
  WHERE zeros <> ones)"""


def _daily(extra: str = "") -> str:
    anchor = fx.ANCHOR_MS
    return f"""WITH {POSTS},
d AS (
  SELECT CAST(floor((created_ms - {anchor}) / 86400000) AS BIGINT) AS day
  FROM posts WHERE tweet_id IS NOT NULL {extra}),
b AS (
  SELECT CASE WHEN day BETWEEN -30 AND 0 THEN {anchor} + day * 86400000 ELSE 0 END AS day_ms,
         count(*) AS n
  FROM d GROUP BY 1)
SELECT day_ms, n,
       strftime(make_timestamp(day_ms * 1000) + INTERVAL 9 HOUR, '%a %b %d %H:%M:%S JST %Y') AS day
FROM b"""


USER_COUNTS = f"""{POSTS},
counts AS (
  SELECT user_id, count(*) AS n FROM posts WHERE user_id IS NOT NULL GROUP BY 1)"""


def _user_count(source: str) -> str:
    return f"""
SELECT CAST(n AS VARCHAR) AS metric, count(*) AS n FROM {source} GROUP BY counts.n
UNION ALL SELECT 'userNum', count(*) FROM {source} HAVING count(*) > 0"""


def _buzz(th: int) -> str:
    return f"""
buzz AS (
  SELECT n, CAST(0 AS INTEGER) AS part, array_to_string(list_sort(list(url)), ' ') AS urls
  FROM plain WHERE n > {th} GROUP BY n)"""


def _one_line(text: str) -> str:
    return f"replace(regexp_replace({text}, '\\s+', ' ', 'g'), ',', '，')"


def _title(html: str) -> str:
    title = f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"),
    ):
        title = f"replace({title}, '{entity}', '{char}')"
    return f"trim(regexp_replace({title}, '\\s+', ' ', 'g'))"


def sql(params) -> dict[str, str]:
    p = params
    topic_rows = f"""{POSTS}, {TEXTS}, {URLS},
topic_rows AS (
  SELECT u.url, u.key FROM urls u JOIN texts t USING (event_id)
  WHERE t.tweet_id IS NOT NULL AND {_any('t.text', fx.TOPICS)})"""
    queries = {
        "tweet_count": f"""WITH {POSTS}
SELECT 'tweetNum' AS metric, count(*) AS n FROM posts WHERE key <> 0
UNION ALL SELECT 'errorNum', count(*) FROM posts WHERE key = 0""",
        "parse_posts": f"""WITH {POSTS}, {TEXTS}, {URLS},
lists AS (
  SELECT event_id, array_to_string(list(url ORDER BY pos), ' ') AS urls FROM urls GROUP BY 1)
SELECT key, tweet_id, user_id, created_ms, text, retweet_count, is_retweet, retweeted_id,
       retweeted_text, coalesce(urls, '') AS urls
FROM texts LEFT JOIN lists USING (event_id)""",
        "user_tweet_count": f"WITH {USER_COUNTS} SELECT user_id, n FROM counts",
        "filter_user_counts":
            f"WITH {USER_COUNTS} SELECT user_id, n FROM counts WHERE n > {p.MIN_POSTS}",
        "user_count": f"WITH {USER_COUNTS} {_user_count('counts')}",
        "activity_histogram": f"""WITH {USER_COUNTS.replace('counts AS', 'all_counts AS')},
counts AS (SELECT * FROM all_counts WHERE n > {p.MIN_POSTS}) {_user_count('counts')}""",
        "time_series": f"""WITH {POSTS}
SELECT created_ms, count(*) AS n FROM posts WHERE tweet_id IS NOT NULL GROUP BY 1""",
        "time_stamp": f"""WITH {POSTS}
SELECT created_ms, count(*) AS n,
       strftime(make_timestamp(created_ms * 1000), '%a %b %d %H:%M:%S UTC %Y') AS created
FROM posts WHERE tweet_id IS NOT NULL GROUP BY 1""",
        "daily_freq": _daily(),
        "original_daily_freq": _daily("AND NOT is_retweet"),
        "retweet_count": f"""WITH {POSTS}
SELECT retweeted_id, count(*) AS n FROM posts WHERE is_retweet GROUP BY 1""",
        "retweet_freq": f"""WITH {POSTS},
c AS (SELECT retweeted_id, count(*) AS n FROM posts WHERE is_retweet GROUP BY 1)
SELECT n AS value, count(*) AS freq FROM c GROUP BY 1""",
        "keyword_filter": f"""WITH {POSTS}, {TEXTS}
SELECT key, tweet_id, text FROM texts
WHERE tweet_id IS NOT NULL AND key <> 0 AND {_any('text', fx.KEYWORDS)}""",
        "keyword_filter_by_table": f"""WITH {POSTS}, {TEXTS},
terms AS (
  SELECT DISTINCT term FROM (SELECT unnest(string_split(text, ' ')) AS term FROM benchmark)
  WHERE length(term) >= {fx.TERM_LENGTH}),
named AS (
  SELECT DISTINCT text FROM (SELECT DISTINCT text FROM texts) JOIN terms ON contains(text, term))
SELECT key, tweet_id, text FROM texts SEMI JOIN named USING (text)
WHERE tweet_id IS NOT NULL AND key <> 0""",
        "term_buzz_by_table": f"""WITH {POSTS}, {TEXTS},
terms AS (
  SELECT DISTINCT term FROM (SELECT unnest(string_split(text, ' ')) AS term FROM benchmark)
  WHERE length(term) >= {fx.TERM_LENGTH}),
counted AS (SELECT text, count(*) AS n FROM texts WHERE tweet_id IS NOT NULL GROUP BY text)
SELECT term, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN terms ON contains(text, term) GROUP BY term""",
        "term_buzz": f"WITH {POSTS}, {TEXTS} " + " UNION ALL ".join(
            f"SELECT '{t}' AS term, count(*) AS n FROM texts WHERE contains(text, '{t}') "
            "HAVING count(*) > 0"
            for t in dict.fromkeys(fx.BUZZ_TERMS)
        ),
        "url_count": f"WITH {URL_COUNT} SELECT url, n FROM url_count",
        "url_freq":
            f"WITH {URL_COUNT} SELECT n AS value, count(*) AS freq FROM url_count GROUP BY 1",
        "buzz_extract": f"""WITH {URL_COUNT}, {PLAIN_COUNT}, {_buzz(p.BUZZ)}
SELECT n, part, urls FROM buzz""",
        "buzz_url_expand": f"""WITH {URL_COUNT}, {PLAIN_COUNT}, {_redirects(False)}, {UNREACHABLE}
SELECT coalesce(dst, url) AS url, CAST(sum(n) AS BIGINT) AS n
FROM plain LEFT JOIN red ON src = url
WHERE n > {p.BUZZ} AND url NOT IN (SELECT url FROM dead) GROUP BY 1""",
        "trim_url": f"SELECT url, {_trim('url')} AS trimmed FROM pages",
        "resolve_redirects": f"""WITH RECURSIVE {_redirects(False)}, {_resolved('pages', False)}
SELECT url, final FROM resolved""",
        "url_refer": f"WITH RECURSIVE {_url_refer(p.URL_USERS)} SELECT url, user_id FROM url_refer",
        "url_refer_list": f"""WITH RECURSIVE {_url_refer(p.URL_USERS)},
edges AS (SELECT url AS item, user_id FROM url_refer) {_sets('edges')}""",
        "threshold_item_sets": f"""WITH RECURSIVE {_url_refer(p.URL_USERS)},
edges AS (SELECT url AS item, user_id FROM url_refer)
{_sets('edges', f'HAVING count(*) >= {p.LIST_USERS}')}""",
        "url_expand": f"""WITH RECURSIVE {URL_COUNT}, {PLAIN_COUNT}, {_redirects(False)},
{_resolved('plain', True)}
SELECT final AS url, CAST(sum(n) AS BIGINT) AS n FROM plain JOIN resolved USING (url) GROUP BY 1""",
        "topic_url_count":
            f"WITH {topic_rows} SELECT url, count(*) AS n FROM topic_rows GROUP BY 1",
        "topic_url_user": f"WITH {topic_rows} SELECT url, key FROM topic_rows",
        "topic_url_title": f"""WITH {topic_rows},
popular AS (SELECT url FROM topic_rows GROUP BY 1 HAVING count(*) >= {p.TITLE_MENTIONS})
SELECT {_title('html')} AS title, count(*) AS n FROM popular JOIN pages USING (url) GROUP BY 1""",
        "filter_url": f"""WITH {topic_rows},
edges AS (SELECT url AS item, key AS user_id FROM topic_rows WHERE url NOT LIKE '"%')
{_sets('edges')}""",
        "seq_to_text": f"""WITH {URL_COUNT}
SELECT key, CAST(sum(value) AS BIGINT) AS value FROM (
  SELECT url AS key, n AS value FROM url_count
  UNION ALL SELECT retweeted_id || '', count(*) FROM posts WHERE is_retweet GROUP BY 1
  UNION ALL SELECT url, 1 FROM pages)
GROUP BY 1""",
        "paired_url": f"""WITH {POSTS}, {URLS},
twice AS (SELECT DISTINCT url FROM urls WHERE event_type = 'purchase'),
edges AS (
  SELECT url AS item, user_id FROM urls
  WHERE event_type = 'purchase' OR url NOT IN (SELECT url FROM twice)), {_links(p.URL_JACCARD)} {PAIRS}""",
        "item_pairs": f"""WITH {_retweets(p.RT_USERS)}, {_links(p.RT_JACCARD)} {PAIRS}""",
        "jaccard_of_pairs":
            f"WITH {_retweets(p.RT_USERS)}, {_links(p.RT_JACCARD)} {ROUNDED}",
        "jaccard_links": f"WITH {PART_EDGES}, {_links(p.PART_JACCARD)} {ROUNDED}",
        "jaccard_top_links": f"""WITH {PART_EDGES}, {_links(0)},
directed AS (
  SELECT item1 AS item, item2 AS other, jaccard FROM links
  UNION ALL SELECT item2, item1, jaccard FROM links),
ranked AS (
  SELECT item, row_number() OVER (PARTITION BY item ORDER BY jaccard DESC, other) AS rank, other, jaccard
  FROM directed)
SELECT item, rank, other, round(jaccard, 9) AS jaccard FROM ranked WHERE rank <= {p.TOP_LINKS}""",
        "jaccard_links_dec": f"""WITH {_retweets(p.RT_USERS)}, {_links(p.RT_JACCARD)},
names AS (SELECT DISTINCT item, text FROM edges),
plain AS (
  SELECT least(x.text, y.text) AS text1, greatest(x.text, y.text) AS text2, jaccard
  FROM links JOIN names x ON x.item = item1 JOIN names y ON y.item = item2)
SELECT {_one_line('text1')} AS item1, {_one_line('text2')} AS item2, round(jaccard, 9) AS jaccard
FROM plain""",
        "link_network": f"""WITH RECURSIVE {_url_refer(p.URL_USERS)},
edges AS (SELECT url AS item, user_id FROM url_refer), {_links(p.URL_JACCARD)} {ROUNDED}""",
        "audience_sizes": f"""WITH {POSTS}, {URLS}
SELECT url AS item, count(DISTINCT user_id) AS n FROM urls WHERE user_id IS NOT NULL GROUP BY url""",
        "audience_sizes_by_host": f"""WITH {POSTS}, {URLS}
SELECT split_part(url, '/', 3) AS host, count(DISTINCT user_id) AS n
FROM urls WHERE user_id IS NOT NULL GROUP BY 1""",
        "items_at_least": _kept_edges(p.URL_USERS),
        "frequent_edges": _kept_edges(p.URL_USERS),
        "retweet_sets": f"WITH {_retweets(p.RT_USERS)} {_sets('encoded')}",
        "user_rt_freq": f"""WITH {_retweets(p.RT_USERS)}
SELECT user_id, count(*) AS value FROM edges GROUP BY 1 HAVING count(*) >= {p.USER_TEXTS}""",
        "user_rt_list": f"""WITH {_retweets(p.RT_USERS)}
SELECT user_id, count(*) AS n, CAST(0 AS INTEGER) AS part, {_csv('item')} AS items
FROM encoded GROUP BY 1""",
        "user_opinion":
            f"WITH {_retweets(p.RT_USERS)}, {OPINIONS} SELECT user_id, value FROM user_opinion",
        "user_opinion_base64":
            f"WITH {_retweets(p.RT_USERS)}, {OPINIONS} SELECT user_id, value FROM user_opinion",
        "user_opinion_normalised": f"""WITH {_retweets(p.RT_USERS)},
opinions AS (
  SELECT {_one_line('text')} AS text, max(quality) AS opinion
  FROM documents JOIN labels USING (doc_id) GROUP BY 1),
votes AS (
  SELECT user_id, count(*) FILTER (opinion = 0) AS zeros, count(*) FILTER (opinion = 1) AS ones
  FROM edges e JOIN opinions o ON o.text = {_one_line('e.text')} GROUP BY user_id)
SELECT user_id, CAST(CASE WHEN zeros > ones THEN 0 ELSE 1 END AS INTEGER) AS value
FROM votes WHERE zeros <> ones""",
        "opinion_exposure": f"""WITH {_retweets(p.RT_USERS)}, {OPINIONS}, {FOLLOWS},
{_neighbours('user_opinion')}
SELECT user_id, own AS opinion, {MEAN} AS avg_opinion, n_vocal FROM stats""",
        "filter_network_by_profile": f"""WITH {NETWORK} SELECT profile, csv FROM net
WHERE lower(lang) = 'ja' AND friends_count < {p.FOLLOW_LIMIT}""",
        "filter_network_by_list": f"""WITH {NETWORK} SELECT profile, csv FROM net
WHERE friends_count < {p.FOLLOW_LIMIT} AND id IN (SELECT user_id FROM uf)""",
        "drop_profile_and_filter": f"""WITH {NETWORK} SELECT id, csv FROM net
WHERE friends_count < {p.FOLLOW_LIMIT} AND id IN (SELECT user_id FROM uf)""",
        "following_only":
            f"WITH {NETWORK} SELECT profile, following FROM net WHERE NOT protected",
        "simplify_network":
            f"WITH {NETWORK} SELECT id, csv FROM net WHERE friends_count < {p.FOLLOW_LIMIT}",
        "simplify_all": f"""WITH {NETWORK} SELECT id, following FROM net
WHERE NOT protected AND friends_count < {p.FOLLOW_LIMIT}""",
        "follow_rows": f"""WITH {NETWORK}
SELECT id AS user_id, followee FROM net LEFT JOIN fe ON fe.user_id = id WHERE NOT protected""",
        "follow_rows_of_parts": f"""WITH {NETWORK}
SELECT id AS user_id, followee FROM net LEFT JOIN fe ON fe.user_id = id WHERE NOT protected""",
        "annotate_following": f"""WITH {NETWORK},
marked AS (
  SELECT fe.user_id AS id,
         string_agg(followee || ';' || coalesce(value, 0), ',' ORDER BY followee) AS ids
  FROM fe LEFT JOIN uf ON uf.user_id = followee GROUP BY 1)
SELECT profile,
       CASE WHEN protected THEN n.id || ' ' || coalesce(value, 0) || ',-1,-1'
            WHEN n_following = 0
            THEN n.id || ' ' || coalesce(value, 0) || ',' || n_followers || ',0'
            ELSE concat_ws(',', n.id || ' ' || coalesce(value, 0), n_followers, n_following,
                           followers, ids) END AS csv
FROM net n LEFT JOIN uf ON uf.user_id = n.id LEFT JOIN marked m ON m.id = n.id
WHERE friends_count < {p.FOLLOW_LIMIT} AND (lower(lang) = 'ja' OR value IS NOT NULL)""",
        "vocal_rate": f"""WITH {FOLLOWS}, {UF}, {_neighbours('uf')}
SELECT user_id, own AS freq, round(n_vocal / n_following, 9) AS vocal_rate FROM stats""",
        "vocal_rate_avg": f"""WITH {FOLLOWS}, {UF}, {_neighbours('uf')}
SELECT own AS freq, round(avg(n_vocal / n_following), 9) AS vocal_rate FROM stats GROUP BY 1""",
        "vocal_avg": f"""WITH {FOLLOWS}, {UF}, {_neighbours('uf')}
SELECT user_id, own AS freq, {MEAN} AS vocal_avg, round(total / n_following, 9) AS total_avg
FROM stats""",
        "neighbor_opinion": f"""WITH {FOLLOWS}, {UO}, {_neighbours('uo')}
SELECT user_id, CAST(own AS INTEGER) AS opinion, {MEAN} AS avg_opinion, n_vocal FROM stats""",
        "degree_hist_by_opinion": f"""WITH {FOLLOWS}, {UO}
SELECT CAST(coalesce(value, -1) AS INTEGER) AS opinion, CAST(n_followers AS INTEGER) AS degree,
       count(*) AS freq
FROM accounts LEFT JOIN uo ON user_id = id WHERE n_followers >= 0 GROUP BY 1, 2""",
        "degree_hist": f"""WITH {FOLLOWS}
SELECT CAST(1 AS INTEGER) AS key, CAST(n_followers AS INTEGER) AS degree, count(*) AS freq
FROM accounts WHERE n_followers >= 0 GROUP BY 2""",
    }
    # what comes back from files is what went into them
    return queries | {
        "sequence_posts": queries["user_tweet_count"],
        "sequence_counts": f"WITH {URL_COUNT} SELECT url AS key, n AS value FROM url_count",
        "sequence_network": queries["filter_network_by_list"],
        "sequence_user_items": f"WITH {_retweets(p.RT_USERS)} SELECT user_id, item FROM encoded",
        "text_item_sets": f"WITH RECURSIVE {_url_refer(p.URL_USERS)} SELECT url AS item, user_id FROM url_refer",
        # a term with a line break is several lines of a keyword file
        "text_terms": queries["term_buzz_by_table"].replace(
            "counted AS", r"""lines AS (
  SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(term, '[\r\n]+')) AS term FROM terms) WHERE term <> ''),
counted AS"""
        ).replace("JOIN terms ON", "JOIN lines ON"),
        "text_opinions": queries["user_opinion_base64"],
        "sorted_lines": f"""WITH {URL_COUNT}
SELECT row_number() OVER (ORDER BY encode(url)) AS line, url || chr(9) || n AS value FROM url_count""",
    }
