"""Applying a feed of writes, sets and deletes to a table of tweets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import percent_decode
from millrace.sources import schemas

#: Fields a set may change.
FIELDS = ("text", "favorite_count", "retweet_count")
REQUIRED = ("id", "created_at", "text", "favorite_count", "retweet_count", "user")


def valid_actions(actions: DataFrame) -> DataFrame:
    """The valid deliveries of a request log, decoded.

    Result: ``delivery_id``, ``uuid``, ``seq``, ``op``, ``tweetid``,
    ``field_name`` (of a set), ``value`` (decoded, of a set), ``doc`` (of a
    write).  Valid are rows with ``uuid`` and ``seq`` whose ``op`` is exactly
    write, set or delete: a delete with ``tid``; a set with ``tid``, one of the
    three fields and a payload, of digits only for a count; a write whose
    payload is a complete JSON object with all required keys and a numeric id.
    Reads and everything else are left out.  Extra columns are ignored.
    """
    raw = actions.where("uuid IS NOT NULL AND seq IS NOT NULL AND op IN ('write', 'set', 'delete')").where(
        "(op = 'delete' AND tid IS NOT NULL) OR (op = 'set' AND tid IS NOT NULL AND payload IS NOT NULL AND field_name IN ('text', 'favorite_count', 'retweet_count')) OR (op = 'write' AND payload IS NOT NULL)")
    flat = raw.select("delivery_id", "uuid", "seq", "op", "tid", F.when(F.col("op") == "set", F.col("field_name")).alias("field_name"), F.when(F.col("op") != "delete", percent_decode(F.col("payload"))).alias("value"))
    # the parser stops after a first complete value; inside brackets anything behind it is an error
    alone = F.json_array_length(F.concat(F.lit("["), F.col("value"), F.lit("]"))) == 1
    whole = alone & (F.size(F.array_intersect(F.json_object_keys("value"), F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED))
    doc = F.when((F.col("op") == "write") & whole, F.from_json("value", schemas.TWEET_WRITE))
    shaped = flat.select("delivery_id", "uuid", "seq", "op", "tid", "field_name", F.when(F.col("op") == "set", F.col("value")).alias("value"), doc.alias("doc"))
    kept = shaped.where("op = 'delete' OR (op = 'write' AND doc.id IS NOT NULL) OR (op = 'set' AND (field_name = 'text' OR value RLIKE '^[0-9]+\\\\z'))")
    return kept.select("delivery_id", "uuid", F.col("seq").cast("bigint").alias("seq"), "op", F.coalesce(F.col("doc.id"), F.when(F.col("op") != "write", F.col("tid"))).alias("tweetid"), "field_name", "value", "doc")


def latest_changes(valid: DataFrame) -> DataFrame:
    """Keys of the last write or delete of each tweet and of the last set of each of its fields.

    Result: ``tweetid``, ``slot``, ``uuid``, ``seq``, ``op``.  First one
    delivery of each (``uuid``, ``seq``) is kept, the one delivered first.  Then
    changes are ranked by ``seq`` within (tweet, slot), where a slot is a field,
    or 'row' for writes and deletes.  Both rankings keep one row, so Spark
    limits each group before its shuffle: a tweet or stream with a third of all
    actions sends one row a task.  Values stay behind; only keys are shuffled.
    """
    slot = F.when(F.col("op") == "set", F.col("field_name")).otherwise(F.lit("row"))
    keys = valid.select("delivery_id", "uuid", "seq", "op", "tweetid", slot.alias("slot"))
    # the first ranking is over names, which hardly repeat; delivery_id settles it
    once = Window.partitionBy("uuid", "seq").orderBy("delivery_id", "tweetid")
    named = keys.withColumn("_rank", F.row_number().over(once)).where("_rank = 1").drop("_rank")
    last = Window.partitionBy("tweetid", "slot").orderBy(F.desc("seq"), "uuid", "delivery_id")
    return named.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").select("tweetid", "slot", "uuid", "seq", "op")


CRAWLED = ("crawled_at", "favorite_count", "retweet_count", "text", "username", "uuid", "source", "created_at")


def current_rows(base: DataFrame) -> DataFrame:
    """One row a tweet of a crawl: the one crawled last.

    Ties go to the greater counts, then to the greater texts.  Rows without
    ``tweetid`` are left out.  Columns of ``CRAWLED`` are kept, others ignored.
    An aggregate, so that a query that only asks which tweets there are reads
    no values.
    """
    last = F.max(F.struct(*CRAWLED)).alias("r")
    return base.where("tweetid IS NOT NULL").groupBy("tweetid").agg(last).select("tweetid", *[F.col(f"r.{c}").alias(c) for c in CRAWLED])


def fold_actions(actions: DataFrame) -> DataFrame:
    """A row a tweet named by a valid action: what of the log still matters.

    ``tweetid``, ``row_seq`` and ``row_op`` of the last write or delete, its
    ``doc`` if a write, and of each field ``<field>_set`` and ``<field>_value``,
    the seq and value of its last set.  Values are joined to the keys that were
    left of the ranking, by (``uuid``, ``seq``); where nobody asks for them, Catalyst
    drops the join, as its right side has a row a name.
    """
    valid = valid_actions(actions)
    first = F.min_by(F.struct("value", "doc"), F.struct("delivery_id", "tweetid")).alias("v")
    values = valid.groupBy("uuid", "seq").agg(first).select("uuid", "seq", "v.value", "v.doc")
    latest = latest_changes(valid).join(values, ["uuid", "seq"], "left")
    of = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)))
    return latest.groupBy("tweetid").agg(
        of("row", "seq").alias("row_seq"), of("row", "op").alias("row_op"), F.any_value(F.when(F.col("slot") == "row", F.col("doc")), True).alias("doc"),
        *[x for f in FIELDS for x in (of(f, "seq").alias(f"{f}_set"), of(f, "value").alias(f"{f}_value"))],
    )


ALIVE = "row_op = 'write' OR (row_op IS NULL AND base_id IS NOT NULL)"


def _after(field: str):
    """Whether a field's last set comes after the last write or delete."""
    return F.col(f"{field}_set") > F.coalesce("row_seq", F.lit(-(2**62)))


def _origins() -> list:
    seq = lambda f: F.when(_after(f), F.col(f"{f}_set")).otherwise(F.coalesce("row_seq", F.lit(0))).cast("bigint")
    return [seq("text").alias("text_seq"), seq("favorite_count").alias("favorite_seq"), seq("retweet_count").alias("retweet_seq")]


def apply_changes(base: DataFrame, actions: DataFrame) -> DataFrame:
    """The tweets that exist after all valid actions, with the origin of their values.

    ``base`` is a crawl (:func:`current_rows` is applied), ``actions`` a request
    log.  Result: ``tweetid``, ``created_at``, ``uuid``, ``username``, ``text``,
    ``favorite_count``, ``retweet_count``, ``source``, ``text_seq``,
    ``favorite_seq``, ``retweet_seq`` (the seq that gave the value, 0 for the
    base), ``named`` (whether an action names the tweet).

    A write replaces the whole tweet, a later set one value, a delete removes
    it; a set on a tweet that does not exist does nothing.  Because a write or
    delete voids all before it, only the last of each and later sets matter.
    Empty inputs are fine; a count beyond 64 bits becomes null.
    """
    kept = current_rows(base).select(F.col("tweetid").alias("base_id"), *[F.col(c).alias(f"base_{c}") for c in ("created_at", "uuid", "username", "text", "favorite_count", "retweet_count", "source")])
    both = fold_actions(actions).join(kept, F.col("tweetid") == F.col("base_id"), "full_outer")
    written = F.col("row_op").isNotNull()
    start = lambda path, col: F.when(written, F.col(f"doc.{path}")).otherwise(F.col(f"base_{col}"))
    kinds = {"text": "string", "favorite_count": "bigint", "retweet_count": "bigint"}
    value = lambda f: F.when(_after(f), F.col(f"{f}_value").try_cast(kinds[f])).otherwise(start(f, f)).alias(f)
    return both.where(ALIVE).select(
        F.coalesce("tweetid", "base_id").alias("tweetid"), start("created_at", "created_at").alias("created_at"), start("user.id", "uuid").alias("uuid"), start("user.screen_name", "username").alias("username"),
        *[value(f) for f in FIELDS], F.when(~written, F.col("base_source")).alias("source"), *_origins(), F.col("tweetid").isNotNull().alias("named"),
    )
