"""Page views, n-grams, graphs, tweets, alarms, media, dispatch and streams on small rows worked out by hand."""

import json
import math
import os
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import alarms, dispatch, graph, media, ngrams, pageviews, tweets
from millrace.plans import workloads
from millrace.session import spread
from millrace.sources import tables
from millrace.streaming import matching

LINES = {
    "en Aqueduct 10 0": ("Aqueduct", 10), "en.m Aqueduct 5 0": ("Aqueduct", 5), "de Berlin 5 0": None, "en Foo 10": None, "enXm Foo 1 0": None, "en %41%42c 5 0": ("ABc", 5), "en A%42 5 0": ("AB", 5),
    "en Caf%C3%A9 7 0": ("Café", 7), "en %C3%A9t 7 0": ("ét", 7), "en %C3%A9 7 0": ("é", 7), "en File%3AFoo.png 3 0": None, "en User_talk:Bob 3 0": None, "en Media:x 1 0": None, "en Talk:x 1 0": None, "en Topic:Abc 5 0": None,
    "en iPod 4 0": None, "en Mercury_(disambiguation) 4 0": None, "en Foo.TXT 1 0": None, "en Main_Page 9 0": None, "en 404.php 9 0": None, "en - 9 0": None, "en 404Xphp 1 0": ("404Xphp", 1), "en A+B 2 0": ("A+B", 2),
    "en 100% 2 0": ("100%", 2), "en Foo x 0": ("Foo", 0), "en  5 0": None, "": None, "en a b c d": None, None: None,
}


def test_page_view_lines(spark):
    got = pageviews.clean_views(spark.createDataFrame([(k, 1) for k in LINES], "line string, day int"))
    assert sorted((r.title, r.views) for r in got.collect()) == sorted(v for v in LINES.values() if v)


def test_daily_vectors(spark):
    rows = [("A", 1, 60_000), ("A", 30, 40_001), ("A", 31, 5), ("A", 0, 5), ("A", None, 5), ("B", 2, 100_000), ("C", 3, 3_000_000_000 % 2**31), ("C", 3, 2**31 - 1)]
    got = {r.title: (r.total, r.daily) for r in pageviews.daily_vectors(spark.createDataFrame(rows, "title string, day int, views int")).collect()}
    assert got["A"][0] == 100_001 and got["A"][1][0] == 60_000 and got["A"][1][29] == 40_001 and sum(got["A"][1]) == 100_001
    assert "B" not in got and got["C"][0] == sum(got["C"][1]) and len(got["C"][1]) == 30
    assert pageviews.daily_vectors(spark.createDataFrame([("only", 1, 200_000)], "title string, day int, views int")).count() == 1


def test_order_of_counts_and_namespaces(spark):
    rows = spark.createDataFrame([("b", 1, 5), ("a", 1, 5), ("c", 2, 9)], "title string, day int, views int")
    assert [r.title for r in pageviews.ordered_counts(rows).collect()] == ["c", "a", "b"]
    doc = json.dumps({"query": {"namespaces": {"0": {"*": ""}, "1": {"*": "Talk", "canonical": "Talk"}, "3": {"*": "User talk"}}}})
    assert {r.prefix for r in pageviews.namespace_prefixes(spark.createDataFrame([(doc,)], "value string")).collect()} == {"talk:", "user_talk:"}


def test_counts_of_runs(spark):
    df = spark.createDataFrame([("a b a\nA b", 1), (None, 1), ("", 1), ("a b\r\n\r\n!!", 1)], "text string, line int")
    got = {r.phrase: r.n for r in ngrams.ngram_counts(df, text.letters_only, more_than=0).collect()}
    assert got == {"a": 4, "b": 3, "a b": 3, "b a": 1, "a b a": 1}
    assert {r.phrase for r in ngrams.ngram_counts(df, text.letters_only).collect()} == {"a", "b", "a b"}
    assert {r.word: r.n for r in ngrams.word_count(df).collect()} == {"a": 3, "b": 3, "A": 1, "!!": 1}


def test_spreading_keeps_rows(spark):
    one = spark.range(1000).coalesce(1)
    assert spread(one).count() == 1000 and spread(one)._jdf.queryExecution().toRdd().getNumPartitions() >= 4
    many = spark.range(0, 100, 1, 16)
    grouped = one.groupBy("id").count()
    assert spread(many) is many and spread(grouped) is grouped


def test_next_words_and_completions(spark):
    c = lambda d: spark.createDataFrame(list(d.items()), "phrase string, n bigint")
    got = [(r.prefix, r.suffix, round(r.prob, 6)) for r in ngrams.next_words(c({"a": 10, "a b": 6, "a c": 6, "a d": 1, "z z": 3}), 2).collect()]
    assert sorted(got) == [("a", "b", 0.6), ("a", "c", 0.6)]
    rows = ngrams.phrase_completions(c({"a": 100, "a b": 10, "a b c": 4, "a b c d": 2, "a b c d e": 1})).collect()
    assert {(r.prefix, r.suffix): round(r.prob, 6) for r in rows} == {
        ("a", "b"): 0.1, ("a", "b c"): 0.04, ("a", "b c d"): 0.02, ("a", "b c d e"): 0.01, ("a b", "c"): 0.4, ("a b", "c d"): 0.2, ("a b", "c d e"): 0.1, ("a b c", "d"): 0.5, ("a b c", "d e"): 0.25, ("a b c d", "e"): 0.5}
    assert ngrams.phrase_completions(c({"a": 20, "a b": 1})).count() == 0  # exactly the limit


EDGES = [("1", "2"), ("1", "3"), ("2", "3"), ("1", "2")]


def test_graphs(spark):
    e = spark.createDataFrame(EDGES, "u string, v string")
    assert [(r.followee, r["count"]) for r in graph.follower_top(e, 2).collect()] == [("2", 2), ("3", 2)]
    assert {r.node: (r.out_degree, r.in_degree) for r in graph.degrees(e).collect()} == {"1": (2, 0), "2": (1, 1), "3": (0, 2)}
    assert [r.node for r in graph.dangling(e).collect()] == ["3"] and [r.node for r in graph.unfollowed(e).collect()] == ["1"]
    assert {r.node: r.follows for r in graph.adjacency(e).collect()} == {"1": ["2", "3"], "2": ["3"]}
    got = {r.node: r["rank"] for r in graph.pagerank(e, 1).collect()}
    assert [round(got[k], 6) for k in "123"] == [0.144444, 0.286111, 0.569444]
    whole, spread = ({r.node: r["rank"] for r in graph.pagerank(e, most_edges=m).collect()} for m in (1_000_000, 1))
    assert math.isclose(sum(whole.values()), 1, abs_tol=1e-9) and all(math.isclose(whole[k], spread[k], abs_tol=1e-12) for k in whole)
    assert graph.pagerank(e.limit(0)).count() == 0


def test_hashtags(spark):
    rows = [(1, "k1", "5,6", "x,y", "1:2"), (2, "k2", "3", "x", None), (3, "k1", "1,2", "z", "1"), (4, "k1", "q", "bad", ""), (5, "k1", None, None, None), (6, "k1", "1,", "w,", "9:")]
    e = tweets.tag_rows(spark.createDataFrame(rows, "row_no bigint, keyword string, counts string, hashtags string, users string"))
    got = [(r.hashtag, r.score) for r in tweets.recommend_hashtags(e, ["k1", "k2"], 1, 4).collect()]
    assert got == [("#x", 6), ("#y", 6), ("#x", 3), ("#w", 1)]
    assert [(r.hashtag, r.score) for r in tweets.recommend_hashtags(e, ["k1", "k2"], 1, 1, merge=True).collect()] == [("#x", 9)]
    with pytest.raises(ValueError):
        tweets.recommend_hashtags(e, [], 1, 1)


def test_topics(spark):
    t = spark.createDataFrame([(1, "cat dog", 3), (2, "cat bird", 0), (3, None, 5), (4, " ", 5)], "tweet bigint, text string, impact bigint")
    got = [(r.word, round(r.score, 6)) for r in tweets.topic_words(t, 3).collect()]
    assert got == [("dog", 0.480453), ("bird", 0.0), ("cat", 0.0)]
    top = tweets.topic_words(t, 2)
    assert [(r.tweet, r.impact) for r in tweets.tweets_with(t, top, 2).collect()] == [(1, 3), (2, 0)]
    assert [r.text for r in tweets.censored(t, ["cat"]).orderBy("tweet").collect()][:2] == ["c*t dog", "c*t bird"]


def test_ranges_of_tweets(spark):
    t = spark.createDataFrame([(2, 1, 1, 1), (1, 1, 2, 0), (3, 1, 5, None), (4, 9, 50, 0)], "tweetid bigint, uuid bigint, favorite_count bigint, retweet_count bigint")
    assert [r.tweetid for r in tweets.range_top(t, 0, 5, 2).collect()] == [3, 1]
    with pytest.raises(ValueError):
        tweets.range_top(t, 5, 0, 1)
    doc = json.dumps({"tid": [7, 8], "ts": [1, 2], "tw": ["a", "b"], "ct": ["A", "B"], "nw": [1, 1], "is": [3, 4]})
    rows = tweets.unpack_arrays(spark.createDataFrame([(5, doc)], "uuid bigint, attributes string")).collect()
    assert [(r.uuid, r.i, r.tid, r.ct, r.impact) for r in rows] == [(5, 0, 7, "A", 3), (5, 1, 8, "B", 4)]


def test_alarms(spark):
    at = datetime(2024, 1, 1)
    s = spark.createDataFrame([("cpu", at + timedelta(minutes=5 * i), v) for i, v in enumerate([90.0, 10.0, 10.0, 10.0, 85.0, None])], "name string, ts timestamp_ntz, value double")
    st = alarms.period_statistics(s, "5 minutes")
    high = alarms.alarms(st, alarms.Rule("high", "avg", "5 minutes", True, 80.0)).collect()
    low = alarms.alarms(st, alarms.Rule("low", "max", "5 minutes", False, 20.0, 3, -1)).collect()
    assert [r.start.minute for r in high] == [0, 20] and [(r.start.minute, r.change) for r in low] == [(15, -1)]


def test_media(spark):
    s3 = lambda k: {"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": k}}}]}
    rows = [(json.dumps({"Records": [{"Sns": {"Message": json.dumps(s3("v/a.mp4"))}}]}),), (json.dumps(s3("c.png")),), ("no json",), (None,)]
    assert sorted(r.key for r in media.store_objects(spark.createDataFrame(rows, "value string")).collect()) == ["c.png", "v/a.mp4"]
    lab = spark.createDataFrame([("a.png", ["x", "y", "x"]), ("b.png", ["x", ""]), ("c.png", None)], "key string, labels array<string>")
    assert {r.label: (r["keys"], r.first_key, r.last_key) for r in media.label_index(lab, "key", F.col("labels")).collect()} == {"x": (2, "a.png", "b.png"), "y": (1, "a.png", "a.png")}
    assert media.label_documents(lab, "key", F.col("labels")).first().id == "a"
    ev = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, 0, 900_000), 7), (1, datetime(2024, 1, 1, 0, 0, 0, 100_000), 8), (1, datetime(2024, 1, 1, 0, 0, 1), 9), (1, None, 1)], "user int, ts timestamp_ntz, e int")
    assert sorted(r.e for r in media.sample_frames(ev, "user", "ts", "1 second").collect()) == [8, 9]


MSG = "arrival_id bigint, msg_type string, block_id int, driver_id int, client_id int, latitude double, longitude double, rating double, user_rating double, salary int, gender string, gender_preference string, status string"


def enter(n, d, rating=5.0, salary=10, gender="F", status="AVAILABLE", lat=0.0, block=1):
    return (n, "ENTERING_BLOCK", block, d, None, lat, 0.0, rating, None, salary, gender, None, status)


def ride(n, c, pref="N", block=1):
    return (n, "RIDE_REQUEST", block, None, c, 0.0, 0.0, None, None, None, None, pref, None)


def done(n, d, block=1):
    return (n, "RIDE_COMPLETE", block, d, None, 0.0, 0.0, 4.0, 5.0, 3, "F", None, None)


CASES = [
    ([enter(1, 1), enter(2, 2, 4.0, 0, "M"), ride(3, 7), ride(4, 8), ride(5, 9), done(6, 1), ride(7, 10)], [(1, 7), (2, 8)]),
    ([enter(1, 1, salary=120), enter(2, 2, 3.0, 50), ride(3, 7)], [(2, 7)]),
    ([enter(1, 1, 5.0, 120), enter(2, 2, 3.0, 150), ride(3, 7)], [(1, 7)]),
    ([enter(1, 1, gender=None), ride(2, 7)], []),
    ([enter(1, 1, status="BUSY"), ride(2, 7), done(3, 1), ride(4, 8)], [(1, 8)]),
    ([enter(1, 1), (2, "LEAVING_BLOCK", 1, 1, None, 0.0, 0.0, None, None, None, None, None, None), ride(3, 7)], []),
    ([enter(1, 2), enter(2, 1), ride(3, 7)], [(1, 7)]),
    ([enter(1, 1, lat=9.0), (2, "DRIVER_LOCATION", 1, 1, None, 0.0, 0.0, None, None, None, None, None, None), enter(3, 2, lat=1.0), ride(4, 7)], [(1, 7)]),
    ([enter(1, 1, gender="M"), enter(2, 2, rating=4.9), ride(3, 7, "F")], [(2, 7)]),
]


@pytest.mark.parametrize("rows, want", CASES)
def test_dispatch(spark, rows, want):
    rows = rows[::-1]  # order is that of arrival_id
    assert [(r.driver_id, r.client_id) for r in dispatch.replay(spark.createDataFrame(rows, MSG)).orderBy("arrival_id").collect()] == want


def test_a_matched_driver_may_be_readmitted(spark):
    rows = spark.createDataFrame([enter(1, 1), ride(2, 7), done(3, 1), ride(4, 8)], MSG)
    assert dispatch.replay(rows).count() == 1 and dispatch.replay(rows, readmit=True).count() == 2


def test_routing(spark):
    rows = spark.createDataFrame([enter(1, 1, block=-3), ride(2, 1), (3, None, 1, *[None] * 10), (4, "OTHER", 1, *[None] * 10), (5, "RIDE_REQUEST", None, *[None] * 10), (6, "DRIVER_LOCATION", 12, *[None] * 10)], MSG)
    assert [(r.arrival_id, r.topic, r.partition) for r in dispatch.route(rows).orderBy("arrival_id").collect()] == [(1, "events", 2), (2, "events", 1), (6, "driver-locations", 2)]
    assert sorted(r.arrival_id for r in dispatch.dead_letters(rows).collect()) == [3, 4, 5]


def test_best_drivers(spark):
    req = spark.createDataFrame([(1, 5, 0.0, 0.0, "N"), (2, 6, 0.0, 0.0, "F")], "request int, area int, lat double, lon double, preference string")
    drv = spark.createDataFrame([(1, 5, 0.0, 0.0, "M", 5.0, 120.0), (2, 5, 1.0, 0.0, "F", 3.0, 50.0), (3, 6, 0.0, 0.0, "M", 5.0, 0.0), (4, 6, 0.0, 0.0, "F", 5.0, 0.0)], "driver int, area int, driver_lat double, driver_lon double, gender string, rating double, salary double")
    assert sorted((r.request, r.driver) for r in dispatch.best_drivers(req, drv, "area").collect()) == [(1, 2), (2, 4)]


def plain_best(requests, drivers):
    """The best driver of each request over all pairs of an area."""
    out = {}
    for q, area, lat, lon, wish in requests:
        ranked = []
        for w, home, y, x, gender, rating, salary in drivers:
            if home == area and None not in (area, lat, lon, y, x, rating, salary):
                score = 0.4 * math.exp(-math.sqrt((lat - y) ** 2 + (lon - x) ** 2)) + 0.1 * (wish == "N" or (wish is not None and wish == gender)) + 0.3 * rating / 5 + 0.2 * (1 - salary / 100)
                ranked.append((salary >= 100, -round(score, 12), w))
        if ranked:
            out[q] = min(ranked)[2]
    return out


@pytest.mark.parametrize("most", [10**6, 7])
def test_best_drivers_are_those_of_all_pairs(spark, most):
    rng = random.Random(most)
    place = lambda: rng.choice([rng.uniform(0, 3), 1.0])
    requests = [(i, rng.choice([1, 1, 1, 2, 3, None]), place(), rng.choice([place(), place(), None]), rng.choice(["N", "F", "M", None])) for i in range(120)]
    drivers = [(1000 + i, rng.choice([1, 1, 2, 4]), place(), rng.choice([place(), place(), None]), rng.choice(["F", "M", None]), rng.choice([1.0, 3.5, 5.0, None]), rng.choice([0.0, 50.0, 99.0, 100.0, 140.0])) for i in range(90)]
    drivers += [(5000 + i, 3, 1.0, 1.0, "F", 4.0, 120.0) for i in range(5)]  # equal ones, none under 100
    req = spark.createDataFrame(requests, "request int, area int, lat double, lon double, preference string").withColumn("rank", F.lit("x"))
    drv = spark.createDataFrame(drivers, "driver int, area int, driver_lat double, driver_lon double, gender string, rating double, salary double").withColumn("kind", F.lit(1))
    got = {r.request: r.driver for r in dispatch.best_drivers(req, drv, "area", most, most).collect()}
    assert got == plain_best(requests, drivers)
    assert dispatch.best_drivers(req.limit(0), drv, "area").count() == dispatch.best_drivers(req, drv.limit(0), "area").count() == 0


def test_pools_match_as_a_look_at_all_drivers_would(spark):
    rng = random.Random(4)
    pool, all_of, n = dispatch.Pool(), {}, 0
    for _ in range(4_000):
        kind, who = rng.choice(["ENTERING_BLOCK", "ENTERING_BLOCK", "DRIVER_LOCATION", "LEAVING_BLOCK", "RIDE_COMPLETE", "RIDE_REQUEST"]), rng.randrange(60)
        m = {"msg_type": kind, "driver_id": who, "block_id": 1, "client_id": 7, "latitude": rng.choice([rng.uniform(0, 2), None if kind == "DRIVER_LOCATION" else 1.0]), "longitude": 0.5, "rating": rng.choice([1.0, 4.0, 5.0]), "user_rating": 3.0,
             "salary": rng.choice([0, 60, 99, 100, 150]), "gender": rng.choice("FM"), "gender_preference": rng.choice("NFM"), "status": rng.choice(["AVAILABLE", "AVAILABLE", "BUSY"])}
        if kind == "RIDE_REQUEST":
            free = [(w, 1, d["latitude"], d["longitude"], d["gender"], d["rating"], d["salary"]) for w, d in all_of.items() if d["status"] == "AVAILABLE"]
            want = plain_best([(0, 1, m["latitude"], m["longitude"], m["gender_preference"])], free).get(0)
            assert pool.handle(m) == ((want, 7) if want is not None else None)
            all_of.pop(want, None)
            n += want is not None
            continue
        assert pool.handle(m) is None
        if kind == "ENTERING_BLOCK":
            all_of[who] = {c: m[c] for c in dispatch.NEEDED}
        elif kind == "LEAVING_BLOCK":
            all_of.pop(who, None)
        elif who in all_of and kind == "DRIVER_LOCATION":
            all_of[who] |= {c: m[c] for c in ("latitude", "longitude")}
        elif who in all_of:
            all_of[who] |= {"status": "AVAILABLE", "salary": m["salary"] + 1, "rating": (m["rating"] + 3.0) / 2, **{c: m[c] for c in ("latitude", "longitude", "gender")}}
    assert n > 300


def test_stream_equals_replay_across_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for n in range(600):
        b, d = rng.randrange(4), rng.randrange(12)
        kind = rng.choice(["ENTERING_BLOCK", "ENTERING_BLOCK", "DRIVER_LOCATION", "LEAVING_BLOCK", "RIDE_REQUEST", "RIDE_COMPLETE"])
        rows.append({"ENTERING_BLOCK": enter(n, d, rng.choice([3.0, 4.5]), rng.randrange(150), rng.choice("FM"), block=b), "RIDE_REQUEST": ride(n, n, rng.choice("FMN"), b), "RIDE_COMPLETE": done(n, d, b)}.get(kind, (n, kind, b, d, None, rng.random(), 0.0, *[None] * 6)))
    df = spark.createDataFrame(rows, MSG)
    want = sorted(tuple(r) for r in dispatch.replay(df).collect())
    source = str(tmp_path / "in")
    for k in range(3):  # three runs, each with what came since
        df.where(f"arrival_id >= {k * 200} AND arrival_id < {(k + 1) * 200}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        out = matching.run_to_table(matching.match_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert want and sorted(tuple(r) for r in out.collect()) == want


def test_window_counts_drop_late_events(spark, tmp_path):
    source = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "ts timestamp_ntz, k string, v double").coalesce(1).write.mode("append").parquet(source)
    run = lambda: matching.run_to_table(matching.window_counts(spark.readStream.schema("ts timestamp_ntz, k string, v double").parquet(source), "ts", "k", "v"), str(tmp_path / "out"), str(tmp_path / "state"))
    put([(datetime(2024, 1, 1, 0, 10), "a", 1.0), (datetime(2024, 1, 1, 0, 20), "a", 2.0), (datetime(2024, 1, 1, 9), "a", 1.0)])
    run()
    put([(datetime(2024, 1, 1, 0, 30), "a", 100.0), (datetime(2024, 1, 1, 20), "a", 1.0)])
    got = {(r.window_start.hour, r.n, r.total) for r in run().collect()}
    assert (0, 2, 3.0) in got and (9, 1, 1.0) in got


def test_registered_window_counts_are_whole(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=i), "ab"[i % 2], float(i)) for i in range(24 * 7)] + [(None, "a", 1.0), (start, None, None)]
    schema = "ts timestamp_ntz, event_type string, value double"
    random.Random(3).shuffle(rows)
    for k in range(0, len(rows), 2):  # more parts than one trigger takes, in no order of time
        tables.write_parquet(spark.createDataFrame(rows[k:k + 2], schema).coalesce(1), str(tmp_path / "parts" / str(k)), single=True)
    (tmp_path / "events.parquet").mkdir()
    for n, f in enumerate(sorted((tmp_path / "parts").glob("*/*.parquet"))):
        f.rename(tmp_path / "events.parquet" / f"part-{n}.parquet")
    assert n + 1 > 64
    df = spark.createDataFrame(rows, schema)
    want = df.where("ts IS NOT NULL").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("w"), "event_type").agg(F.count(F.lit(1)), F.sum("value"))
    got = workloads.stream_window_counts(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and sum(r.n for r in got.collect()) == 24 * 7 + 1
    (tmp_path / "none" / "events.parquet").mkdir(parents=True)
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "events.parquet"))
    assert workloads.stream_window_counts(spark, str(tmp_path / "none")).count() == 0


def test_matches_of_many_parts_are_those_of_the_log(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for n in range(280):
        d = rng.randrange(30)
        rows.append(rng.choice([enter(n, d, rng.choice([3.0, 4.5]), rng.randrange(150)), ride(n, n), done(n, d)]))
    df = spark.createDataFrame(rows, MSG)
    (tmp_path / "driver_messages.parquet").mkdir()
    schema = df.limit(0).toArrow().schema
    for k in range(70):  # the latest messages are in the oldest files
        part = rows[len(rows) - 4 * k - 4:len(rows) - 4 * k]
        path = tmp_path / "driver_messages.parquet" / f"part-{k:02}.parquet"
        pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in part], schema), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    want = sorted(tuple(r) for r in dispatch.replay(df).collect())
    assert want and sorted(tuple(r) for r in workloads.stream_matches(spark, str(tmp_path)).collect()) == want


def test_sources_and_sinks(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "pageviews-20180307-110000").write_text("en A 1 0\n")
    assert [(r.line, r.day) for r in tables.read_pageviews(spark, p("pageviews-20180307-110000")).collect()] == [("en A 1 0", 7)]
    df = spark.createDataFrame([("a\"b", 1), ("é", 2)], "phrase string, n bigint")
    tables.write_tsv(df, p("tsv"), single=True)
    assert sorted(tuple(r) for r in tables.read_tsv(spark, p("tsv"), "phrase string, n bigint").collect()) == [("a\"b", 1), ("é", 2)]
    (tmp_path / "edges.tsv").write_text("1\t2\n2\t3\n")
    assert tables.read_edges(spark, p("edges.tsv")).count() == 2
    tables.write_parquet(df, p("pq"), sort_by="n")
    tables.write_parquet(df, p("pq1"), single=True)
    assert spark.read.parquet(p("pq")).count() == spark.read.parquet(p("pq1")).count() == 2
    tables.write_bucketed(df, "bucketed_counts", "phrase", 2)
    assert spark.table("bucketed_counts").count() == 2
    (tmp_path / "m.json").write_text('{"type": "RIDE_REQUEST", "blockId": 4}\nnot json\n')
    assert [r.type for r in tables.read_messages(spark, p("m.json")).collect()] == ["RIDE_REQUEST", None]
    assert tables.read_binary(spark, p("m.json")).first().length > 0
    (tmp_path / "doc.json").write_text('{"a":\n 1}')
    assert tables.read_json_document(spark, p("doc.json"), "a int").first().a == 1
    objects = spark.createDataFrame([("a/x.bin", b"12"), ("y.bin", b""), (None, b"z")], "key string, content binary")
    tables.write_objects(objects, p("store"))
    assert (tmp_path / "store/a/x.bin").read_bytes() == b"12" and (tmp_path / "store/y.bin").exists()
    assert [r.value for r in tables.as_lines(spark.createDataFrame([("a", None, 1)], "a string, b string, c int"), ",").collect()] == ["a,,1"]
    frame, seen = tables.observed(df)
    frame.collect()
    assert seen.get["rows"] == 2
    assert [r.x for r in spark.createDataFrame([(0.125,), (2.0,), (None,)], "x double").select(text.two_places(F.col("x")).alias("x")).collect()] == ["0.13", "2.00", None]


def test_ranges_of_a_database_table(spark):
    """Through Spark's own database, in memory."""
    url, driver = "jdbc:derby:memory:millrace;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = [(k, k % 7, f"t{k}") for k in range(200)] + [(1000, None, None)]
    try:
        spark.createDataFrame(rows, "tweetid bigint, uuid bigint, body string").write.jdbc(url, "q4", "overwrite", {"driver": driver})
    except Exception as e:  # a build of Spark without it
        pytest.skip(str(e)[:80])
    got = tables.jdbc_range(spark, url, "q4", "uuid", 2, 4, 3, driver=driver)
    assert got.rdd.getNumPartitions() == 3 and "PushedFilters" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted(r for r in rows if r[1] is not None and 2 <= r[1] <= 4)


def test_stored_arrays_and_their_ranges(spark):
    t = spark.createDataFrame([(1, 10, 100, "cat dog", "cat d*g", 3), (2, 11, 200, "cat bird", "cat bird", 0), (3, 12, 300, "cow", "cow", 9), (None, 13, 100, "ant", "ant", 1)], "uuid bigint, tid bigint, ts bigint, tw string, ct string, impact bigint")
    stored = tweets.pack_arrays(t)
    assert sorted((r.uuid or 0, r.tid, r.ts, r.tw, r.ct, r.nw, r.impact) for r in tweets.unpack_arrays(stored).collect()) == [(0, 13, 100, "ant", "ant", 1, 1), (1, 10, 100, "cat dog", "cat d*g", 2, 3), (2, 11, 200, "cat bird", "cat bird", 2, 0), (3, 12, 300, "cow", "cow", 1, 9)]
    got = [(r.word, round(r.score, 6)) for r in tweets.stored_topics(stored, (1, 2), (100, 200), 5).collect()]
    assert got == [("dog", 0.480453), ("bird", 0.0), ("cat", 0.0)]
    assert tweets.stored_tweets(stored, (1, 3), (200, 300)).count() == 2 and tweets.stored_topics(stored, (7, 9), (0, 1), 5).count() == 0
    for users, times in (((2, 1), (0, 1)), ((1, 2), (5, 4))):
        with pytest.raises(ValueError):
            tweets.stored_tweets(stored, users, times)


def test_hourly_files_give_back_lines_and_days(spark, tmp_path):
    rows = [("en A 1 0", 3), ("en B 2 0", 4), ("", 3), (None, 3), ("en C 3 0", None), ("en É 4 0", 31)]
    tables.write_pageviews(spark.createDataFrame(rows, "line string, day int").repartition(3), str(tmp_path / "pv"), "201803")
    assert sorted((r.day, r.line) for r in tables.read_pageviews(spark, str(tmp_path / "pv")).collect()) == [(3, ""), (3, "en A 1 0"), (4, "en B 2 0"), (31, "en É 4 0")]


def test_rows_as_json_and_labels_without_a_model(spark):
    df = spark.createDataFrame([(1, None, 'a "b"\n é')], "x int, y int, z string")
    assert [json.loads(r.value) for r in tables.as_json(df).collect()] == [{"x": 1, "y": None, "z": 'a "b"\n é'}]
    assert media.detected_labels(df).first().labels == []


def test_keywords_are_few_or_a_frame(spark):
    e = spark.createDataFrame([("k", "x", 5, ["1"]), ("l", "y", 6, None), ("m", "z", 9, ["1"])], "keyword string, tag string, n bigint, users array<string>")
    with pytest.raises(ValueError):
        tweets.recommend_hashtags(e, [str(k) for k in range(11)], 1, 3)
    want = [("#x", 6), ("#y", 6)]
    keys = spark.createDataFrame([("k",), ("l",)], "keyword string")
    for given, who in ((["k", "l"], 1), (keys, keys.agg(F.lit(1)).scalar())):
        assert [tuple(r) for r in tweets.recommend_hashtags(e, given, who, 3).collect()] == want
