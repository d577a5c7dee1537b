"""Totals under skew against plain joins and counts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import eager

TAGS = "row_no bigint, keyword string, hashtags string, counts string, users string, key string, tag string"
MESSAGES = "msg_id bigint, msg_type string, block_id int, rating double"


def test_join_of_states_is_the_full_join(spark):
    left = spark.createDataFrame([("a", 1, i) for i in range(300)] + [("b", 2, 7), (None, 1, 1), ("c", 1, None)], "k string, g int, x int")
    right = spark.createDataFrame([("a", i) for i in range(50)] + [("b", None), (None, 3), ("d", 1)], "k string, y int")
    plain = left.join(right, "k").groupBy("g").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    l, r = eager.compact(left, ["k", "g"], {"x": "x"}, "n_left"), eager.compact(right, ["k"], {"y": "y"}, "n_right")
    got = eager.eager_join(l, r, ["k"], ["g"], ["x"], ["y"]).select("g", "n_rows", "x", "y")
    fix = lambda df: sorted((row.g, row.n_rows, row.x or 0, row.y or 0) for row in df.collect())
    assert fix(got) == fix(plain)


def test_join_refuses_clashing_names_and_unknown_kinds(spark):
    s = eager.compact(spark.range(3), ["id"])
    with pytest.raises(ValueError):
        eager.eager_join(s, s, ["id"], ["id"])
    with pytest.raises(ValueError):
        eager.eager_join(s, s.withColumnRenamed("n", "m"), ["id"], ["id"], left_count="n", right_count="m", how="outer")


def test_keys_are_normalised_and_blank_ones_left_out(spark):
    rows = [(1, " Ab ", "#X,x , ,#, y#", None, None, "q", "q"), (1, " Ab ", "#X,x , ,#, y#", None, None, "q", "q"), (2, None, "x", "1", "2", "q", "q"), (3, "  ", "##z", "", "", "q", "q"), (4, "k", None, None, None, "q", "q"), (5, "k", "", None, None, "q", "q")]
    got = Counter(tuple(r) for r in eager.tag_entries(spark.createDataFrame(rows, TAGS)).collect())
    assert got == Counter({("ab", "x"): 4, ("ab", "y#"): 2, (None, "x"): 1, (None, "#z"): 1})


def test_totals_and_heavy_keys(spark):
    messages = [(i, "A", 7 if i < 40 else i, 1.0) for i in range(100)] + [(1, "A", 7, 1.0), (None, "A", 7, 1.0), (200, "A", None, 1.0)]
    tags = [(i, "Key", "a,b", "1,2", "", "", "") for i in range(60)] + [(100 + i, f"k{i}", f"t{i}", "1", "", "", "") for i in range(60)]
    totals = eager.field_totals(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(tags, TAGS))
    got = {(r.field_name, r.key_value): (r.entries, r.field_entries) for r in totals.collect()}
    assert got[("block_id", "7")] == (40, 100) and got[("hashtags", "a")] == (60, 180) and got[("keyword", "key")] == (120, 180)
    assert len(got) == 61 + 62 + 61
    heavy = {tuple(r) for r in eager.heavy_keys(totals).select("field_name", "key_value").collect()}
    assert heavy == {("block_id", "7"), ("hashtags", "a"), ("hashtags", "b"), ("keyword", "key")}


def test_a_share_of_exactly_the_limit_is_heavy(spark):
    t = spark.createDataFrame([("f", "a", 2, 100), ("f", "b", 1, 51), ("f", "c", 1, 50)], "field_name string, key_value string, entries bigint, field_entries bigint")
    assert {r.key_value for r in eager.heavy_keys(t).collect()} == {"a", "c"}


def test_pairs_of_a_block_without_forming_them(spark):
    rows = [(i, "RIDE_REQUEST", 1, None) for i in range(5)] + [(10 + i, "DRIVER_LOCATION", 1, None) for i in range(7)] + [(20, "ENTERING_BLOCK", 1, 4.5), (20, "ENTERING_BLOCK", 1, 4.5), (30, "RIDE_REQUEST", 2, None), (31, "DRIVER_LOCATION", 3, None), (32, None, 1, None)]
    got = {r.block_id: (r.requests, r.drivers, r.pairs, r.rating_sum) for r in eager.pair_totals(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == {1: (5, 8, 40, 22.5), 2: (1, 0, 0, 0.0)}


def test_empty_tables(spark):
    m, t = spark.createDataFrame([], MESSAGES), spark.createDataFrame([], TAGS)
    assert eager.field_totals(m, t).count() == 0 and eager.pair_totals(m).count() == 0
