"""The N best rows of every group, with partition lower bounds.

Each partition keeps its local N best of every group it sees.  Where it saw at
least N rows of a group, its N-th best is a lower bound of the group's true N-th
best.  The greatest bound of a group meets what the partitions kept of it in one
exchange by group and leaves little more than N rows a group to rank.  A group
with a third of all rows sends N rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT = "grp bigint, score bigint, tie bigint, bound_score bigint, bound_tie bigint"


def latest_tweets(tweets: DataFrame) -> DataFrame:
    """``tweetid``, ``uuid`` and ``engagement`` of each tweet's row crawled last.

    Engagement is ``favorite_count`` + ``retweet_count`` with null as 0.  Rows
    of equal ``crawled_at`` are settled by the greater engagement, then the
    greater ``uuid``.  Rows without ``tweetid`` are left out.
    """
    engagement = F.coalesce("favorite_count", F.lit(0)) + F.coalesce("retweet_count", F.lit(0))
    last = F.max(F.struct("crawled_at", engagement.alias("engagement"), "uuid")).alias("r")
    return tweets.where("tweetid IS NOT NULL").groupBy("tweetid").agg(last).select("tweetid", "r.uuid", "r.engagement")


def _best(grp: np.ndarray, score: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Rows of the n best of each group, in order of group, falling score and tie."""
    order = np.lexsort((tie, ~score, grp))
    g = grp[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[np.arange(len(g)) - first < n]


def _local_best(batches: Iterator[pa.RecordBatch], n: int, most: int, least: int = 65_536) -> Iterator[pa.RecordBatch]:
    """The n best of each group a partition saw, with its n-th best as the group's bound.

    Rows pile up unsorted until there are twice as many as the last sorting
    left, so every row is sorted a bounded number of times on average, however
    many groups there are.
    """
    held: list[list[np.ndarray]] = []
    waiting, limit = 0, least

    def compact() -> list[np.ndarray]:
        cols = [np.concatenate(c) for c in zip(*held)]
        rows = _best(*cols, n)
        return [c[rows] for c in cols]

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        grp, score, tie = cols
        new = np.concatenate([[True], grp[1:] != grp[:-1]])
        last = np.flatnonzero(np.concatenate([new[1:], [True]]))
        run = np.cumsum(new) - 1
        full = (np.diff(np.concatenate([[-1], last])) >= n)[run]
        at = last[run]
        whole = pa.RecordBatch.from_arrays([pa.array(grp), pa.array(score), pa.array(tie), pa.array(score[at], mask=~full), pa.array(tie[at], mask=~full)], names=["grp", "score", "tie", "bound_score", "bound_tie"])
        yield from (whole.slice(k, least) for k in range(0, whole.num_rows, least))

    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        waiting += b.num_rows
        if waiting >= limit:
            cols = compact()
            if len(cols[0]) > most:  # any part of the rows gives a valid bound, so memory stays bounded
                yield from out(cols)
                held, waiting, limit = [], 0, least
            else:
                held, waiting = [cols], len(cols[0])
                limit = max(2 * waiting, least)
    if waiting:
        yield from out(compact())


def top_n(rows: DataFrame, group: str, score: str, tie: str, n: int, most: int = 2_000_000) -> DataFrame:
    """The ``n`` rows of each group with the greatest ``score``, equal scores by smaller ``tie``.

    The three columns are BIGINT.  Result: ``grp``, ``score``, ``tie``,
    ``place`` from 1.  Rows with a null group or tie are left out, a null score
    counts as least.  Rows repeated exactly are rows each.  A group of fewer
    than ``n`` rows comes out whole; an empty input gives no rows.  Other
    columns, whatever their names, are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = rows.where(F.col(group).isNotNull() & F.col(tie).isNotNull()).select(F.col(group).cast("bigint").alias("grp"), F.coalesce(F.col(score).cast("bigint"), F.lit(-(2**63))).alias("score"), F.col(tie).cast("bigint").alias("tie"))
    kept = flat.mapInArrow(lambda batches: _local_best(batches, n, most), KEPT)
    # one exchange and one sort serve the bounds and the ranks
    ordered = kept.repartition(parts, "grp").sortWithinPartitions("grp", F.desc("score"), "tie")
    # the smaller tie is the better one: the bitwise complement turns the order without overflow
    bound = F.max(F.when(F.col("bound_score").isNotNull(), F.struct("bound_score", F.bitwise_not("bound_tie").alias("inv"))))
    bounded = ordered.withColumn("bound", bound.over(Window.partitionBy("grp")))
    survivors = bounded.where("bound IS NULL OR score > bound.bound_score OR (score = bound.bound_score AND ~tie >= bound.inv)")
    w = Window.partitionBy("grp").orderBy(F.desc("score"), "tie")
    return survivors.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("grp", "score", "tie", "place")


def top_tweets(tweets: DataFrame, n: int = 3) -> DataFrame:
    """Each user's ``n`` tweets with the greatest engagement: ``uuid``, ``place``, ``tweetid``, ``engagement``."""
    best = top_n(latest_tweets(tweets).where("uuid IS NOT NULL"), "uuid", "engagement", "tweetid", n)
    return best.select(F.col("grp").alias("uuid"), "place", F.col("tie").alias("tweetid"), F.col("score").alias("engagement"))
