"""Strips and sweep against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import near

POINT = "id bigint, grp bigint, latitude double, longitude double"
MESSAGE = "msg_id bigint, msg_type string, block_id int, latitude double, longitude double, sent_at timestamp_ntz"


def brute(left, right, radius):
    ok = lambda p: None not in p and -90 <= p[2] <= 90 and -180 <= p[3] <= 180 and not (p[2] == 0 and p[3] == 0)
    out = set()
    for a in set(left):
        for b in set(right):
            if ok(a) and ok(b) and a[1] == b[1] and near.great_circle_m(a[2], a[3], b[2], b[3]) <= radius:
                out.add((a[0], b[0]))
    return out


def cloud(rng, n, first, box, groups=2):
    s, t, w, e = box
    return [(first + i, rng.randrange(groups), rng.uniform(s, t), rng.uniform(w, e)) for i in range(n)]


@pytest.mark.parametrize("box, radius", [
    ((40.0, 40.01, -74.0, -73.99), 60.0), ((-0.002, 0.002, 179.998, 180.0), 80.0), ((89.999, 90.0, -180.0, 180.0), 50.0), ((-90.0, -89.9995, -180.0, 180.0), 40.0), ((-60.0, 60.0, -180.0, 180.0), 900_000.0),
])
@pytest.mark.parametrize("n_cells", [1, 7, 40])
def test_pairs_are_those_of_brute_force(spark, box, radius, n_cells):
    rng = random.Random(hash((box, n_cells)) % 1000)
    left, right = cloud(rng, 90, 1, box), cloud(rng, 150, 1000, box)
    if box[3] == 180.0 and box[2] > 179:  # the other side of the seam
        right = [(i, g, y, -x if k % 2 else x) for k, (i, g, y, x) in enumerate(right)]
    got = near.near_pairs(spark.createDataFrame(left, POINT), spark.createDataFrame(right, POINT), radius, n_cells)
    rows = [(r.left_id, r.right_id) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(left, right, radius)


def test_a_crowd_on_one_latitude_is_cut_by_longitude(spark):
    rng = random.Random(4)
    left = [(i, 0, 10.0, rng.uniform(20, 20.05)) for i in range(150)]
    right = [(1000 + i, 0, 10.0, rng.uniform(20, 20.05)) for i in range(300)]
    both = spark.createDataFrame(left + right, POINT)
    cells = near.plan_cells(both, 30.0, 20)
    assert len(cells.cuts)
    got = near.near_pairs(spark.createDataFrame(left, POINT), spark.createDataFrame(right, POINT), 30.0, 20)
    rows = [(r.left_id, r.right_id) for r in got.collect()]
    assert sorted(rows) == sorted(brute(left, right, 30.0))


def test_nulls_wrong_positions_repeats_and_the_limit(spark):
    left = [(1, 0, 40.0, -74.0), (1, 0, 40.0, -74.0), (None, 0, 40.0, -74.0), (2, None, 40.0, -74.0), (3, 0, None, -74.0), (4, 0, 0.0, 0.0), (5, 0, 91.0, 0.0), (6, 0, 40.0, 181.0), (7, 1, 40.0, -74.0)]
    right = [(10, 0, 40.0, -74.0), (10, 0, 40.0, -74.0), (11, 0, 40.0 + 0.0002, -74.0), (12, 0, 0.0, 0.0), (13, 0, 40.1, None)]
    frame = lambda rows: spark.createDataFrame(rows, POINT).withColumn("side", F.lit("x")).withColumn("cell", F.lit(1))  # noqa: E731  clashing names
    edge = float(near.great_circle_m(40.0, -74.0, 40.0002, -74.0))
    got = near.near_pairs(frame(left), frame(right), edge).collect()
    assert sorted((r.left_id, r.right_id) for r in got) == [(1, 10), (1, 11)]
    assert near.near_pairs(frame(left), frame(right), edge * 0.999).count() == 1


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], POINT), spark.createDataFrame([(1, 0, 1.0, 1.0)], POINT)
    assert near.near_pairs(none, none, 10.0).count() == near.near_pairs(one, none, 10.0).count() == near.near_pairs(none, one, 10.0).count() == 0


def test_the_active_set_is_carried_across_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rng = random.Random(9)
        left, right = cloud(rng, 60, 1, (40, 40.003, -74, -73.997)), cloud(rng, 80, 1000, (40, 40.003, -74, -73.997))
        side = lambda rows, k: spark.createDataFrame(rows, POINT).withColumn("side", F.lit(k))
        got = near.near_pairs_tagged(side(left, 0).unionByName(side(right, 1)), 70.0, 3, batch_rows=5).collect()
        assert sorted((r.left_id, r.right_id) for r in got) == sorted(brute(left, right, 70.0))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def inside(lat, lon, ys, xs):
    odd = False
    for i in range(len(ys)):
        y1, x1, y2, x2 = ys[i - 1], xs[i - 1], ys[i], xs[i]
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_regions_both_ways(spark):
    rng = random.Random(2)
    rings = [(1, 1, [0.0, 0.0, 1.0, 1.0, 0.5], [0.0, 1.0, 1.0, 0.0, 0.5]), (1, 2, [2.0, 2.0, 3.0], [0.0, 1.0, 0.0]), (2, 1, [0.2, 0.8, 0.5], [1.2, 1.2, 1.9]), (3, 1, None, [1.0]), (4, 1, [0.0, 1.0], [0.0, 1.0]), (None, 1, [0.0, 0.0, 1.0], [5.0, 6.0, 5.0]), (5, 1, [0.0, None, 1.0], [0.0, 1.0, 1.0])]
    regions = spark.createDataFrame(rings, "block_id int, ring_no int, ring_lat array<double>, ring_lon array<double>")
    pts = [(i, i % 3, rng.uniform(-0.5, 3.5), rng.uniform(-0.5, 2.5)) for i in range(400)] + [(None, 1, 0.3, 0.9), (500, None, None, 0.9), (501, None, 0.3, 0.9), (501, None, 0.3, 0.9)]
    points = spark.createDataFrame(pts, "id bigint, own int, latitude double, longitude double")
    want = sorted((i, b) for i, _, y, x in pts if i is not None and y is not None for b, _, ys, xs in rings if b in (1, 2) and inside(y, x, ys, xs))
    for most in (1_000, 0):
        got = near.containing_regions(points, regions, most).collect()
        assert sorted((r.id, r.region) for r in got) == want
    assert near.containing_regions(points, regions.limit(0)).count() == 0
    assert near.containing_regions(points.limit(0), regions).count() == 0


def test_relations_of_messages(spark):
    t = lambda d, h=0: np.datetime64(f"2018-03-{d:02d}T{h:02d}:00:00").astype("O")
    rows = [
        (1, "RIDE_REQUEST", 7, 40.5, -73.5, t(1)), (2, "DRIVER_LOCATION", 7, 40.5001, -73.5, t(1, 23)), (2, "DRIVER_LOCATION", 7, 40.5001, -73.5, t(1, 23)), (3, "ENTERING_BLOCK", 7, 40.5, -73.5, t(2)),
        (4, "LEAVING_BLOCK", 8, 40.5, -73.5, t(1)), (5, None, None, 40.5, -73.5, t(1)), (6, "RIDE_REQUEST", 9, None, None, t(1)), (7, "RIDE_REQUEST", 9, 40.5, -73.5, None),
    ]
    messages = spark.createDataFrame(rows, MESSAGE)
    blocks = spark.createDataFrame([(7, 1, [40.4, 40.4, 40.6, 40.6], [-73.6, -73.4, -73.4, -73.6])], "block_id int, ring_no int, ring_lat array<double>, ring_lon array<double>")
    got = sorted(tuple(r) for r in near.dispatch_relations(messages, blocks).collect())
    assert got == [("block", 7, 4), ("block", 7, 5), ("block", 7, 7), ("near", 1, 2)]


def test_one_place_of_many_points_is_shared_out(spark):
    left = [(i, 0, 40.0, -74.0) for i in range(300)] + [(500 + i, 0, 41.0 + i / 10, 2.0) for i in range(30)]
    right = [(1000 + i, 0, 40.0 + 1e-5, -74.0) for i in range(200)] + [(2000 + i, 0, 41.0 + i / 10, 2.0) for i in range(30)]
    frame = lambda rows: spark.createDataFrame(rows, POINT)
    cells = near.plan_cells(frame(left + right), 30.0, 16)
    assert cells.shares.max() >= 8
    lat, lon, ids = (np.array([p[k] for p in left], float) for k in (2, 3, 0))
    owners = np.bincount(cells.placed_left(lat, lon, ids.astype(np.int64)))
    assert owners.max() < 100  # of 300 points at one place
    got = [(r.left_id, r.right_id) for r in near.near_pairs(frame(left), frame(right), 30.0, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(left, right, 30.0)


def test_cuts_of_longitude_are_no_closer_than_a_box(spark):
    rng = random.Random(5)
    pts = [(i, 0, 60.0, rng.uniform(10, 10.002)) for i in range(500)]
    cells = near.plan_cells(spark.createDataFrame(pts, POINT), 30.0, 64)
    wide = 2 * near.reach_degrees(np.array([60.0]), 30.0)[1][0]
    assert len(cells.cuts) and np.diff(cells.cuts).min() >= wide * 0.999


def test_a_line_of_many_points_meets_its_rings_in_shares(spark):
    rng = random.Random(6)
    regions = spark.createDataFrame([(k, 1, [10.0, 10.0, 10.3, 10.3], [k / 10, k / 10 + 0.08, k / 10 + 0.08, k / 10]) for k in range(20)] + [(99, 1, [9.0, 12.0, 12.0, 9.0], [-1.0, -1.0, 3.0, 3.0])], "block_id int, ring_no int, ring_lat array<double>, ring_lon array<double>")
    pts = [(i, 5, 10.1 if i % 3 else rng.uniform(8, 13), rng.uniform(-2, 4)) for i in range(900)]
    points = spark.createDataFrame(pts, "id bigint, own int, latitude double, longitude double")
    one, other = (sorted(map(tuple, near.containing_regions(points, regions, most).collect())) for most in (10_000, 0))
    assert one == other and len(one) > 600
