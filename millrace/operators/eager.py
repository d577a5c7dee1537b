"""Per-key totals under heavy key skew, by eager aggregation through joins.

Instead of joining rows and aggregating the result, both inputs are first
aggregated by the join key.  A key then has one compact state on each side
however many rows it had, the states are joined, counts are multiplied and sums
scaled, and the states are rolled up to the wanted keys.  A key that holds a
third of all rows costs each map task one row of shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_SPACE = r"^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """``c`` without white space at either end."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def compact(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column | str] | None = None, count: str = "n") -> DataFrame:
    """One row a key: the number of rows as ``count`` and the sum of each of ``sums``.

    Spark combines on the map side, so the shuffle carries at most one row a
    key from each task.  A null key is a key; an empty input gives no rows.
    """
    exprs = [F.count(F.lit(1)).alias(count)]
    exprs += [F.coalesce(F.sum(F.col(v) if isinstance(v, str) else v), F.lit(0)).alias(k) for k, v in (sums or {}).items()]
    return df.groupBy(*keys).agg(*exprs)


def eager_join(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str], left_sums: Sequence[str] = (), right_sums: Sequence[str] = (), left_count: str = "n_left", right_count: str = "n_right", how: str = "inner") -> DataFrame:
    """What ``left JOIN right ON on GROUP BY by`` gives, from compact states.

    ``left`` and ``right`` are states from :func:`compact`; each holds ``on``,
    its own columns of ``by``, its count and its sums.  The result has ``by``,
    ``n_rows`` (rows the full join would have), every sum as the full join
    would give it: a left sum times the right count and the reverse, and
    ``left_count`` and ``right_count`` (rows of either side that found a
    partner).

    Null keys join nothing, as in SQL.  With ``how="left"`` a key without a
    partner keeps its left count and has ``n_rows`` 0.  Names that occur on
    both sides outside ``on`` are refused.
    """
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    joined = left.join(right, list(on), how)
    zero = F.lit(0)
    lc, rc = F.coalesce(F.col(left_count), zero), F.coalesce(F.col(right_count), zero)
    aggs = [F.sum(lc * rc).alias("n_rows"), F.sum(lc).alias(left_count), F.sum(rc).alias(right_count)]
    aggs += [F.sum(F.col(c) * rc).alias(c) for c in left_sums] + [F.sum(F.coalesce(F.col(c), zero) * lc).alias(c) for c in right_sums]
    return joined.groupBy(*by).agg(*aggs)


def tag_entries(rows: DataFrame) -> DataFrame:
    """Non-blank elements of ``hashtags`` with their row's ``keyword``.

    ``tag`` is trimmed, in lower case and without one leading ``#``; ``key`` is
    the trimmed keyword in lower case, or null where it is blank or null.
    Elements that are nothing but white space or ``#`` are left out, as are
    rows with null ``hashtags``.
    """
    word = F.lower(trimmed(F.col("keyword")))
    exploded = rows.select(F.when(word != "", word).alias("key"), F.explode(F.split("hashtags", ",", -1)).alias("raw"))
    return exploded.select("key", trimmed(F.regexp_replace(F.lower(trimmed(F.col("raw"))), "^#", "")).alias("tag")).where("tag <> ''")


def field_totals(messages: DataFrame, tag_rows: DataFrame) -> DataFrame:
    """Entries of every key of three fields, with the field's total and the key's share.

    Result: ``field_name`` ('block_id', 'keyword' or 'hashtags'), ``key_value``,
    ``entries``, ``field_entries``, ``share``.  Entries of ``block_id`` are
    distinct ``msg_id``s with a block; those of the other two are the elements
    of :func:`tag_entries`, each counted for its tag and, where there is one,
    for its row's keyword.

    Messages are made distinct by (block, message), a key without skew, before
    they are counted.  Tags are first reduced to one state a (keyword, tag);
    both tag fields roll up from it.  The states of keys then meet the states of
    fields in :func:`eager_join`.
    """
    blocks = messages.where("block_id IS NOT NULL AND msg_id IS NOT NULL").select("block_id", "msg_id").distinct()
    pairs = compact(tag_entries(tag_rows), ["key", "tag"])
    both = pairs.select(F.explode(F.array(
        F.struct(F.lit("hashtags").alias("field_name"), F.col("tag").alias("key_value"), "n"),
        F.struct(F.lit("keyword").alias("field_name"), F.col("key").alias("key_value"), "n"),
    )).alias("s")).select("s.*").where("key_value IS NOT NULL")
    entries = compact(blocks, ["block_id"]).select(F.lit("block_id").alias("field_name"), F.col("block_id").cast("string").alias("key_value"), "n").unionByName(both)
    keys = entries.groupBy("field_name", "key_value").agg(F.sum("n").alias("entries"))
    fields = keys.groupBy("field_name").agg(F.sum("entries").alias("field_entries"))
    keyed = keys.withColumn("n_keys", F.lit(1).cast("bigint"))
    totals = F.broadcast(fields.withColumn("n_fields", F.lit(1).cast("bigint")))  # three rows; keys need not gather by field
    joined = eager_join(keyed, totals, ["field_name"], ["field_name", "key_value"], ["entries"], ["field_entries"], "n_keys", "n_fields")
    return joined.select("field_name", "key_value", "entries", "field_entries", (F.col("entries") / F.col("field_entries")).alias("share"))


def heavy_keys(totals: DataFrame, least_share: float = 0.02) -> DataFrame:
    """Keys of :func:`field_totals` with at least ``least_share`` of their field's entries, compared exactly.

    The share is taken as a whole number of millionths, so that a key with
    exactly the share is not lost to rounding.
    """
    millionths = round(least_share * 1_000_000)
    return totals.where(F.col("entries") * 1_000_000 >= F.col("field_entries") * F.lit(millionths))


def pair_totals(messages: DataFrame, left_type: str = "RIDE_REQUEST", right_types: Sequence[str] = ("DRIVER_LOCATION", "ENTERING_BLOCK")) -> DataFrame:
    """For each block the number of (request, driver) message pairs, without forming any.

    Result: ``block_id``, ``requests``, ``drivers``, ``pairs``, ``rating_sum``
    (the sum of the drivers' ratings over all pairs).  Messages are made
    distinct by ``msg_id`` first.  Blocks without requests are left out; those
    without drivers have ``pairs`` 0.
    """
    base = messages.where("block_id IS NOT NULL AND msg_id IS NOT NULL AND msg_type IS NOT NULL").select("block_id", "msg_id", "msg_type", "rating").groupBy("block_id", "msg_id", "msg_type").agg(F.max("rating").alias("rating"))
    # one state a (block, side), made in a single pass; ratings are kept in tenths so that sums are exact
    is_left, is_right = F.col("msg_type") == left_type, F.col("msg_type").isin(*right_types)
    states = base.where(is_left | is_right).groupBy("block_id", is_left.alias("is_left")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("rating") * 10).cast("bigint")).alias("tenths"))
    left = states.where("is_left").select("block_id", F.col("n").alias("requests"))
    right = states.where("NOT is_left").select("block_id", F.col("n").alias("drivers"), F.coalesce("tenths", F.lit(0)).alias("rating_tenths"))
    out = eager_join(left, right, ["block_id"], ["block_id"], [], ["rating_tenths"], "requests", "drivers", "left")
    return out.select("block_id", "requests", "drivers", F.col("n_rows").alias("pairs"), (F.coalesce("rating_tenths", F.lit(0)) / 10.0).alias("rating_sum"))
