"""Declared schemas of the inputs, as DDL."""

MESSAGE = (
    "type string, blockId bigint, driverId bigint, clientId bigint, latitude double, longitude double, gender string, "
    "gender_preference string, rating double, user_rating double, salary double, status string, seq bigint"
)
TWEET_WRITE = (
    "id bigint, created_at string, text string, favorite_count bigint, retweet_count bigint, user struct<id: bigint, screen_name: string>"
)
TWEET_ARRAYS = (
    "tid array<bigint>, ts array<bigint>, tw array<string>, ct array<string>, nw array<int>, `is` array<bigint>"
)
TAG_ROW = "keyword string, counts string, hashtags string, users string"
TWEET_ROW = "tweetid bigint, created_at string, uuid bigint, username string, text string, favorite_count bigint, retweet_count bigint"
NAMESPACES = "query struct<namespaces: map<string, map<string, string>>>"
STORE_EVENT = ("Records array<struct<s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>")
NOTICE = ("Records array<struct<Sns: struct<Message: string>>>")
