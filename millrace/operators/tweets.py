"""Hashtag recommendation, topic words and ranges of tweets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import censor, words
from millrace.sources import schemas

#: Most keywords a lookup may name; a fixed value of the service's interface.
MOST_KEYWORDS = 10


def tag_rows(rows: DataFrame) -> DataFrame:
    """``row_no``, ``keyword``, ``tag``, ``n``, ``users`` of rows of parallel lists.

    Empty elements at a list's end are dropped, as the loader does.  Rows whose
    lists then differ in length, or with a null list of tags or counts, are left
    out; users missing at the end are none.  Counts that are no number are null.
    """
    cut = lambda c, sep: F.split(F.regexp_replace(c, f"{sep}+$", ""), sep, -1)
    lists = rows.select("row_no", "keyword", cut(F.col("hashtags"), ",").alias("t"), cut(F.col("counts"), ",").alias("c"), F.coalesce(F.split("users", ":", -1), F.array().cast("array<string>")).alias("u")).where("size(t) = size(c)")
    zipped = lists.select("row_no", "keyword", F.explode(F.transform("t", lambda x, i: F.struct(x.alias("tag"), F.get("c", i).try_cast("bigint").alias("n"), F.get("u", i).alias("u")))).alias("z"))
    users = F.when(F.coalesce(F.col("z.u"), F.lit("")) != "", F.split("z.u", ",", -1)).otherwise(F.array().cast("array<string>"))
    return zipped.select("row_no", "keyword", "z.tag", "z.n", users.alias("users"))


def recommend_hashtags(entries: DataFrame, keywords: Sequence[str] | DataFrame, user: int | Column, n: int, merge: bool = False, most: int = MOST_KEYWORDS) -> DataFrame:
    """The ``n`` tags of some keywords with the greatest count, one more where ``user`` is among a tag's users.

    ``entries`` is what :func:`tag_rows` gives; ``keywords`` a list of at most
    ``most``, more are refused, or a frame of distinct ``keyword``s.  Equal
    counts go by tag.  ``merge`` adds up equal tags of several keywords; without
    it they stand apart.  Result: ``hashtag``, ``score``.
    """
    if n < 1:
        raise ValueError("at least one tag is needed")
    if isinstance(keywords, DataFrame):
        some = entries.join(keywords.select("keyword"), "keyword", "left_semi")
    else:
        if not 0 < len(keywords) <= most:
            raise ValueError(f"from 1 to {most} keywords are needed")
        some = entries.where(F.col("keyword").isin(list(keywords)))
    some = some.where("n IS NOT NULL AND tag <> ''")
    who = user.cast("string") if isinstance(user, Column) else F.lit(str(user))
    scored = some.select(F.concat(F.lit("#"), F.col("tag")).alias("hashtag"), (F.col("n") + F.coalesce(F.array_contains("users", who), F.lit(False)).cast("bigint")).alias("score"))
    if merge:
        scored = scored.groupBy("hashtag").agg(F.sum("score").alias("score"))
    return scored.orderBy(F.desc("score"), "hashtag").limit(n)


def pack_arrays(tweets: DataFrame) -> DataFrame:
    """Tweets as rows of the store: ``uuid`` and ``attributes``, JSON of six parallel arrays.

    ``tweets`` has ``uuid``, ``tid``, ``ts`` (seconds), ``tw``, ``ct``, ``impact``.
    Every tweet is a row of its own; readers take any number of rows a user, and
    no user's tweets are gathered.
    """
    one = F.struct(F.array("tid").alias("tid"), F.array("ts").alias("ts"), F.array("tw").alias("tw"), F.array("ct").alias("ct"), F.array(F.size(words(F.col("tw")))).alias("nw"), F.array("impact").alias("is"))
    return tweets.select("uuid", F.to_json(one, {"ignoreNullFields": "false"}).alias("attributes"))


def unpack_arrays(rows: DataFrame) -> DataFrame:
    """One row a tweet of users stored with JSON of six parallel arrays: ``uuid``, ``i``, ``tid``, ``ts``, ``tw``, ``ct``, ``nw``, ``impact``."""
    j = rows.select("uuid", F.from_json("attributes", schemas.TWEET_ARRAYS).alias("j"))
    zipped = F.arrays_zip("j.tid", "j.ts", "j.tw", "j.ct", "j.nw", "j.is")
    return j.select("uuid", F.posexplode(zipped).alias("i", "z")).select("uuid", "i", "z.tid", "z.ts", "z.tw", "z.ct", "z.nw", F.col("z.is").alias("impact"))


def tweet_words(tweets: DataFrame) -> DataFrame:
    """``tweet``, ``word``, ``impact``, ``n_words``: each word of each tweet; ``tweets`` has ``tweet``, ``text``, ``impact``."""
    w = tweets.select("tweet", "impact", words(F.lower("text")).alias("w")).where(F.size("w") > 0)
    return w.select("tweet", "impact", F.size("w").alias("n_words"), F.explode("w").alias("word"))


def topic_words(tweets: DataFrame, n: int) -> DataFrame:
    """The ``n`` words with the greatest score: ``word``, ``score``.

    The score is the sum of ln(1 + impact) / words of the tweet over all
    occurrences, times ln(tweets / tweets with the word).  A word repeated in a
    tweet adds to the sum each time and to the tweets once.  Equal scores go by
    word.
    """
    total = tweets.where(F.size(words(F.col("text"))) > 0).agg(F.count(F.lit(1)).cast("double")).scalar()  # read when the query runs
    once = tweet_words(tweets).groupBy("word", "tweet").agg(F.sum(F.log1p("impact") / F.col("n_words")).alias("s"))
    by_word = once.groupBy("word").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("df"))
    scored = by_word.select("word", (F.col("s") * F.log(total / F.col("df"))).alias("score"))
    return scored.orderBy(F.desc("score"), "word").limit(n)


def tweets_with(tweets: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """The ``n`` tweets of greatest impact that hold any word of ``some``; equal impacts by falling tweet key.  ``some`` is a top list."""
    hit = tweet_words(tweets).select("tweet", "impact", "word").join(some.select("word"), "word", "left_semi").select("tweet", "impact").distinct()
    return hit.orderBy(F.desc("impact"), F.desc(F.col("tweet").cast("string"))).limit(n)


def stored_topics(rows: DataFrame, users: tuple[int, int], times: tuple[int, int], n: int) -> DataFrame:
    """:func:`topic_words` of stored rows (:func:`unpack_arrays`) of users and times in two ranges, ends included."""
    return topic_words(stored_tweets(rows, users, times), n)


def stored_tweets(rows: DataFrame, users: tuple[int, int], times: tuple[int, int]) -> DataFrame:
    """``tweet``, ``text``, ``impact`` of stored rows of users and times in two ranges, ends included.

    Rows are chosen by user before their JSON is read.  A range that ends before
    it begins is refused.
    """
    if users[1] < users[0] or times[1] < times[0]:
        raise ValueError("a range ends before it begins")
    some = unpack_arrays(rows.where(F.col("uuid").between(*users))).where(F.col("ts").between(*times))
    return some.select(F.col("tid").alias("tweet"), F.col("tw").alias("text"), "impact")


def censored(tweets: DataFrame, banned: Sequence[str]) -> DataFrame:
    """``tweet`` and ``text`` with banned words starred; blanks are single afterwards."""
    return tweets.select("tweet", F.array_join(F.transform(words(F.col("text")), lambda w: censor(w, banned)), " ").alias("text"))


def engagement() -> Column:
    """Favourites and retweets together, nulls as 0."""
    return F.coalesce("favorite_count", F.lit(0)) + F.coalesce("retweet_count", F.lit(0))


def range_top(tweets: DataFrame, low: int, high: int, n: int) -> DataFrame:
    """The ``n`` tweets of users ``low`` to ``high`` with the greatest engagement, equal ones by tweet id.

    ``tweets`` has a row a tweet.
    """
    if high < low:
        raise ValueError("the range ends before it begins")
    return tweets.where(F.col("uuid").between(low, high)).select("tweetid", "uuid", engagement().alias("engagement")).orderBy(F.desc("engagement"), "tweetid").limit(n)
