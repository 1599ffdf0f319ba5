"""Schemas of the records the jobs read."""

RAW_POST = "key bigint, raw string"

URL_ENTITIES = "array<struct<url:string,expanded_url:string>>"

POST_JSON = (
    "id bigint, created_at string, text string, retweet_count bigint, "
    "user struct<id:bigint>, "
    "retweeted_status struct<id:bigint,text:string>, "
    f"entities struct<urls:{URL_ENTITIES}>"
)

RAW_NETWORK = "profile string, csv string"

PROFILE_JSON = "id bigint, lang string, friends_count int"

COUNTED_KEY = "key string, value int"

ITEM_CSV = "item string, csv string"

USER_ITEMS_CSV = "user_id bigint, csv string"

SIDE_LIST = "user_id bigint, value int"

ITEM_OPINIONS = "rt string, opinion int"
