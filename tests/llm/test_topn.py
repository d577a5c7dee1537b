import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.llm import topn

ROWS = "g bigint, s bigint, t bigint"
TWEET = "tweetid bigint, uuid bigint, favorite_count bigint, retweet_count bigint, crawled_at timestamp_ntz"


def brute(rows, n):
    out, by = [], {}
    for g, s, t in rows:
        if g is not None and t is not None:
            by.setdefault(g, []).append((-(s if s is not None else -(2**63)), t))
    for g, v in by.items():
        out += [(g, -a, t, k + 1) for k, (a, t) in enumerate(sorted(v)[:n])]
    return sorted(out)


@pytest.mark.parametrize("n, most", [(1, 2_000_000), (3, 2_000_000), (3, 10), (50, 5)])
def test_best_of_each_group(spark, n, most):
    rng = random.Random(n)
    rows = [(rng.choice([1] * 20 + list(range(2, 30))), rng.choice([None, 5, 2**40, -3, rng.randrange(50)]), rng.randrange(10_000)) for _ in range(3_000)] + [(None, 1, 1), (1, 99, None), (7, 2**62, 1), (7, 2**62, 1)]
    df = spark.createDataFrame(rows, ROWS).repartition(5).withColumn("grp", F.lit(1)).withColumn("bound", F.lit("x")).withColumn("place", F.lit(0))
    got = sorted(tuple(r) for r in topn.top_n(df, "g", "s", "t", n, most).collect())
    assert got == brute(rows, n)


def test_small_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 5, 1)], ROWS)
    assert topn.top_n(df, "g", "s", "t", 3).count() == 1 and topn.top_n(df.limit(0), "g", "s", "t", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "g", "s", "t", 0)


def test_tweets_count_once_by_their_last_crawl(spark):
    at = lambda d: datetime(2018, 3, d)
    rows = [(1, 9, 100, 0, at(1)), (1, 9, 1, None, at(2)), (2, 9, 2**33, 2**33, at(1)), (3, 9, 1, 0, at(1)), (4, 9, None, None, at(1)), (5, None, 9, 9, at(1)), (None, 9, 99, 9, at(3)), (2, 9, 2**33, 2**33, at(1)), (6, 8, 0, 0, None)]
    got = [(r.uuid, r.place, r.tweetid, r.engagement) for r in topn.top_tweets(spark.createDataFrame(rows, TWEET)).orderBy("uuid", "place").collect()]
    assert got == [(8, 1, 6, 0), (9, 1, 2, 2**34), (9, 2, 1, 1), (9, 3, 3, 1)]


def batches_of(rows, size=10_000):
    import pyarrow as pa

    return [pa.RecordBatch.from_arrays([pa.array(c[k:k + size]) for c in rows], names=["grp", "score", "tie"]) for k in range(0, len(rows[0]), size)]


def test_work_grows_with_the_rows_when_every_group_is_new():
    """Twice the rows of distinct groups take about twice the time."""
    import time

    import numpy as np

    rng = np.random.default_rng(0)
    took = []
    for n in (400_000, 800_000, 1_600_000):
        rows = [rng.permutation(n), rng.integers(0, 1_000, n), np.arange(n)]
        began = time.perf_counter()
        assert sum(b.num_rows for b in topn._local_best(iter(batches_of(rows)), 3, 2_000_000)) == n
        took.append(time.perf_counter() - began)
    assert took[2] < 8 * took[0] and took[2] < 15


def test_rows_that_wait_lose_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    n = 30_000
    grp, score, tie = rng.integers(0, 900, n), rng.integers(0, 50, n), np.arange(n)
    for most, least in ((10**6, 100), (500, 64), (10**6, 10**6)):
        got = [r for b in topn._local_best(iter(batches_of([grp, score, tie], 700)), 4, most, least) for r in zip(*(b.column(k).to_pylist() for k in range(5)))]
        assert brute([r[:3] for r in got], 4) == brute(list(zip(grp.tolist(), score.tolist(), tie.tolist())), 4)
        best = {(g, k): (s, t) for g, s, t, k in brute(list(zip(grp.tolist(), score.tolist(), tie.tolist())), 4)}
        assert all(b is None or (-b, c) >= (-best[g, 4][0], best[g, 4][1]) for g, _, _, b, c in got)
