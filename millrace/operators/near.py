"""Points near other points, and points inside regions, by latitude strips and a sweep.

Latitude is cut into strips that hold about equally many points (by a histogram
of lines, so a crowded place gets many thin strips).  A strip that stays crowded at
the least height is cut again by longitude, and a cell that stays crowded at the
least width, as around one place of many points, is shared out: its left points go
to its shares by hash, its right points to all of them.  Points of the right side
also go to every cell within reach of them; each left point lies in one share of
one cell, which so owns all its pairs.  A share is sorted by latitude in the shuffle and swept in that order
in Arrow batches: only points within the radius of the sweep line stay active,
held in order of longitude, and every candidate's distance is verified.  A task
never holds more than a batch and the active rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8


def usable(points: DataFrame) -> DataFrame:
    """Rows whose position can be right: both values there and in range, not both 0."""
    return points.where("latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)")


def great_circle_m(lat_a, lon_a, lat_b, lon_b) -> np.ndarray:
    """Great-circle distance in metres; accurate for near points and for antipodes."""
    a, b, dl = np.radians(lat_a), np.radians(lat_b), np.radians(np.asarray(lon_b) - lon_a)
    x = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(dl / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(x), np.sqrt(np.maximum(1 - x, 0)))


def reach_degrees(lat: np.ndarray, radius_m: float) -> tuple[float, np.ndarray]:
    """Half the height, and at each latitude half the width, of a box around a circle, a little widened."""
    d = min(radius_m / EARTH_RADIUS_M * (1 + 1e-9) + 1e-12, np.pi)
    top = np.abs(np.radians(lat)) + d
    with np.errstate(invalid="ignore", divide="ignore"):
        wide = np.degrees(np.arcsin(np.minimum(np.sin(d) / np.maximum(np.cos(np.radians(lat)), 1e-300), 1)))
    return float(np.degrees(d)), np.where(top >= np.pi / 2, 180.0, np.minimum(wide * (1 + 1e-9) + 1e-12, 180.0))


class Cells:
    """Strips of latitude, some of them cut by longitude, and crowded cells in shares.

    ``bounds`` are the inner strip bounds; ``cuts`` maps a strip to its inner
    longitude bounds, ``shares`` a cell to the number of its shares where that is
    not 1.  Their number follows the number of cells asked for, never the number
    of rows.
    """

    def __init__(self, bounds: Sequence[float], cuts: dict[int, Sequence[float]], radius_m: float, shares: dict[int, int] | None = None):
        self.bounds, self.radius_m = np.asarray(bounds, float), radius_m
        self.shares = np.ones(len(self.bounds) + 1 + sum(len(c) for c in cuts.values()), np.int64)
        for cell, n in (shares or {}).items():
            self.shares[cell] = n
        self.first = np.cumsum(self.shares) - self.shares
        # all cuts in one sorted array: strips lie further apart than longitudes can be
        self.cuts = np.array([self._key(k, x) for k in sorted(cuts) for x in sorted(cuts[k])], float)

    @staticmethod
    def _key(strip, lon):
        return strip * 2_000.0 + (lon + 1_000.0)

    def _cell(self, strip: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return strip + np.searchsorted(self.cuts, self._key(strip, lon), "right")

    def own(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return self._cell(np.searchsorted(self.bounds, lat, "right"), lon)

    def placed_left(self, lat: np.ndarray, lon: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The share that owns each left point."""
        cell = self.own(lat, lon)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[cell] + (mixed % self.shares[cell].astype(np.uint64)).astype(np.int64)

    def placed_right(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, share, longitude) for every share of every cell within the radius."""
        row, cell, lon = self.reached(lat, lon)
        at, share = _runs(self.first[cell], self.first[cell] + self.shares[cell] - 1)
        return row[at], share, lon[at]

    def reached(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, longitude) for every cell within the radius.

        A row near the 180th meridian is repeated with its longitude shifted by
        360 degrees, so that cells need not know about the seam.
        """
        # the box of a left point reaches no right point further off than this
        high, wide = reach_degrees(np.minimum(np.abs(lat) + reach_degrees(lat, self.radius_m)[0], 90.0), self.radius_m)
        row = np.arange(len(lat))
        west, east = lon - wide <= -180, lon + wide >= 180
        row, lon = np.concatenate([row, row[west], row[east]]), np.concatenate([lon, lon[west] + 360.0, lon[east] - 360.0])
        low, top = np.searchsorted(self.bounds, lat[row] - high, "right"), np.searchsorted(self.bounds, lat[row] + high, "right")
        at, strip = _runs(low, top)
        row, lon = row[at], lon[at]
        at, cell = _runs(self._cell(strip, lon - wide[row]), self._cell(strip, lon + wide[row]))
        return row[at], cell, lon[at]


def _runs(low: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, x) for every i and every x from low[i] to top[i]."""
    n = top - low + 1
    at = np.repeat(np.arange(len(low)), n)
    return at, low[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches, so that array work outweighs its calls."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


LINES = 200_000  # most lines of the histogram that steers the strips


def plan_cells(points: DataFrame, radius_m: float, n_cells: int) -> Cells:
    """Cells for ``points`` (``latitude``, ``longitude``), about ``n_cells`` of them.

    Points are counted by line of latitude, at most ``LINES`` of them and none
    lower than the box around a circle of the radius; counts combine on the map
    side.  Only lines crowded by themselves are counted by longitude, in steps of
    the box's width, and only the chosen cuts come to the driver.  All this
    steers the load; any cells give the same pairs.
    """
    if n_cells < 2:
        return Cells([], {}, radius_m)
    least = 2 * reach_degrees(np.zeros(1), radius_m)[0]
    height = max(least, 180 / LINES)
    line = F.floor((F.col("latitude") + 90) / height)
    counts = sorted((r["line"], r["n"]) for r in points.groupBy(line.alias("line")).agg(F.count(F.lit(1)).alias("n")).collect())
    target = max(sum(n for _, n in counts) / n_cells, 1.0)
    bounds: list[float] = []
    load, closed, crowded = 0, False, {}  # strip: its line
    for at, (k, n) in enumerate(counts):
        if at and (load + n > target or closed):
            bounds.append(k * height - 90)
            load = 0
        load, closed = load + n, n >= 3 * target
        if closed:
            crowded[len(bounds)] = k
    if not crowded:
        return Cells(bounds, {}, radius_m)
    # a step is as wide as the box of a point anywhere in the line
    edge = {strip: min(max(abs(k * height - 90), abs((k + 1) * height - 90)) + least, 90.0) for strip, k in crowded.items()}
    step = {strip: float(max(2 * reach_degrees(np.array([e]), radius_m)[1][0], 360 / 2**24)) for strip, e in edge.items()}
    lines = points.sparkSession.createDataFrame([(k, strip, step[strip]) for strip, k in crowded.items()], "line bigint, strip int, step double")  # fewer than cells
    some = points.select(line.alias("line"), "longitude").join(F.broadcast(lines), "line")
    slim = some.groupBy("strip", F.floor((F.col("longitude") + 180) / F.col("step")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("strip").orderBy("at")) - F.col("n")
    parts = slim.withColumn("part", F.floor(before / F.lit(target))).groupBy("strip", "part").agg(F.min("at").alias("at"), F.sum("n").alias("n")).orderBy("strip", "part").collect()
    cuts: dict[int, list[float]] = {}
    for r in parts:
        mine = cuts.setdefault(r["strip"], [])
        if r["part"]:
            mine.append(r["at"] * step[r["strip"]] - 180)
    plain = Cells(bounds, cuts, radius_m)
    shares = {}
    for r in parts:
        if r["n"] >= 2 * target:
            cell = int(plain._cell(np.array([r["strip"]]), np.array([(r["at"] + 0.5) * step[r["strip"]] - 180]))[0])
            shares[cell] = max(shares.get(cell, 1), int(np.ceil(r["n"] / target)))
    return Cells(bounds, cuts, radius_m, shares)


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float, n_cells: int | None = None) -> DataFrame:
    """Pairs of a left and a right point of the same group within ``radius_m`` of each other.

    Both inputs have ``id`` BIGINT, ``grp`` BIGINT, ``latitude`` and
    ``longitude`` DOUBLE; other columns are ignored.  Result: ``left_id``,
    ``right_id``, ``distance_m``.  Rows with a null or an unusable position, id
    or group pair with nothing.  Rows repeated exactly count once, and so does
    each pair of rows; a pair on the limit counts.  An empty side gives no rows.
    The two sides are independent: a row in both pairs with itself.

    ``n_cells`` defaults to the session's shuffle partitions.  A cell's share and
    the group together decide a row's partition.
    """
    side = lambda df, k: df.select("id", "grp", "latitude", "longitude", F.lit(k).alias("side"))
    return near_pairs_tagged(side(left, 0).unionByName(side(right, 1)), radius_m, n_cells)


def near_pairs_tagged(points: DataFrame, radius_m: float, n_cells: int | None = None, batch_rows: int = 50_000) -> DataFrame:
    """:func:`near_pairs` of both sides in one frame, read once: ``side`` is 0 for left, 1 for right, null for neither.

    A task sweeps ``batch_rows`` rows at a time.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = usable(points).where("id IS NOT NULL AND grp IS NOT NULL AND side IN (0, 1)").select("id", "grp", "latitude", "longitude", F.col("side").cast("tinyint").alias("side"))
    cells = plan_cells(rows, radius_m, n_cells or parts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            lat, lon, side = _column(b, "latitude"), _column(b, "longitude"), _column(b, "side")
            mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            row, cell, x = cells.placed_right(lat[theirs], lon[theirs])
            take = np.concatenate([mine, theirs[row]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cells.placed_left(lat[mine], lon[mine], _column(b, "id")[mine]), cell]).astype(np.int32)), b.column("grp").take(pa.array(take)), pa.array(lat[take]), pa.array(np.concatenate([lon[mine], x])), b.column("id").take(pa.array(take)), pa.array(side[take])],
                names=["cell", "grp", "latitude", "longitude", "id", "side"])

    placed = rows.mapInArrow(spread, "cell int, grp bigint, latitude double, longitude double, id bigint, side tinyint")
    ordered = placed.repartition(parts, "cell", "grp").sortWithinPartitions("cell", "grp", "latitude", "longitude", "id", "side")
    return ordered.mapInArrow(lambda batches: _sweep(batches, radius_m, batch_rows), "left_id bigint, right_id bigint, distance_m double")


def _sweep(batches: Iterator[pa.RecordBatch], radius_m: float, most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows in order of (cell, grp, latitude), with each pair found at its later row."""
    names = ("cell", "grp", "latitude", "longitude", "id", "side")
    active: list[np.ndarray] | None = None
    high = reach_degrees(np.zeros(1), radius_m)[0]
    for b in _chunks(batches, most):
        cols = [_column(b, n) for n in names]
        if not len(cols[0]):
            continue
        old = 0
        if active is not None:
            old = len(active[0])
            cols = [np.concatenate([a, c]) for a, c in zip(active, cols)]
        # a row repeated exactly follows its twin
        same = np.ones(len(cols[0]) - 1, bool)
        for c in cols:
            same &= c[1:] == c[:-1]
        fresh = np.concatenate([[True], ~same])
        old = int(fresh[:old].sum())
        cols = [c[fresh] for c in cols]
        if len(cols[0]) > old:
            yield from _pairs(cols, old, radius_m, high)
        cell, grp, lat = cols[:3]
        keep = (cell == cell[-1]) & (grp == grp[-1]) & (lat >= lat[-1] - high)
        active = [c[keep] for c in cols]


def _pairs(cols: list[np.ndarray], old: int, radius_m: float, high: float, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Pairs within a batch and between it and the active rows before it (the first ``old``).

    Rows are put into lines one radius high; the active set of a line are the
    lines beside it, each in order of longitude, so that a binary search gives
    the candidates of a point.
    """
    cell, grp, lat, lon, ids, side = cols
    if not (side == 0).any() or not (side == 1).any():
        return
    change = np.concatenate([[False], (cell[1:] != cell[:-1]) | (grp[1:] != grp[:-1])])
    group = np.cumsum(change)
    start = np.flatnonzero(np.concatenate([[True], change[1:]]))
    line = np.floor((lat - lat[start][group]) / high).astype(np.int64)
    # lines of different groups are kept apart by a gap of two
    last = np.zeros(len(start), np.int64)
    np.maximum.at(last, group, line)
    line += np.concatenate([[0], np.cumsum(last + 3)])[:-1][group]
    right = np.flatnonzero(side == 1)
    right = right[np.lexsort((lon[right], line[right]))]
    r_line, r_lon = line[right], lon[right]
    first = np.searchsorted(r_line, np.arange(line[-1] + 3))
    left = np.flatnonzero(side == 0)
    wide = reach_degrees(lat[left], radius_m)[1]
    for step in (-1, 0, 1):
        at = line[left] + step
        ok = at >= 0
        who, at, w = left[ok], at[ok], wide[ok]
        # at a pole the window is the whole circle, and its ends are one meridian
        top = np.where(w >= 180, np.nextafter(lon[who] + w, -np.inf), lon[who] + w)
        lo, hi = _search(r_lon, first[at], first[at + 1], lon[who] - w), _search(r_lon, first[at], first[at + 1], top, True)
        n = np.maximum(hi - lo, 0)
        ends = np.cumsum(n)
        at0 = 0
        while at0 < len(who):
            # candidates are checked in bounded chunks
            base = ends[at0 - 1] if at0 else 0
            at1 = max(int(np.searchsorted(ends, base + most, "right")), at0 + 1)
            k = n[at0:at1]
            a = np.repeat(who[at0:at1], k)
            pos = np.repeat(lo[at0:at1] - (np.cumsum(k) - k), k) + np.arange(len(a))
            c = right[pos]
            new = (a >= old) | (c >= old)
            a, c = a[new], c[new]
            d = great_circle_m(lat[a], lon[a], lat[c], lon[c])
            hit = d <= radius_m
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[hit]]), pa.array(ids[c[hit]]), pa.array(d[hit])], names=["left_id", "right_id", "distance_m"])
            at0 = at1


def _search(values: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, right: bool = False) -> np.ndarray:
    """Binary search of every x[i] in the sorted run values[low[i]:high[i]]."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        v = values[np.minimum(mid, len(values) - 1)]
        up = open_ & ((v <= x) if right else (v < x))
        low = np.where(up, mid + 1, low)
        high = np.where(open_ & ~up, mid, high)
    return low


def rings(regions: DataFrame) -> DataFrame:
    """Rings with at least three corners and no null, with the box around each.

    ``regions`` has ``block_id``, ``ring_lat`` and ``ring_lon``; arrays of unequal length or with null corners are left out.
    """
    good = regions.where("block_id IS NOT NULL AND size(ring_lat) >= 3 AND size(ring_lat) = size(ring_lon) AND NOT exists(ring_lat, x -> x IS NULL) AND NOT exists(ring_lon, x -> x IS NULL)")
    return good.select("block_id", "ring_lat", "ring_lon", F.array_min("ring_lat").alias("low"), F.array_max("ring_lat").alias("high"))


PER_DEGREE = 256  # lines of latitude at which rings are cut for their sweep


def _line_of(lat: np.ndarray) -> np.ndarray:
    return np.floor(lat * PER_DEGREE).astype(np.int64)


def ring_lines(block: int, lats: Sequence[float], lons: Sequence[float]) -> Iterator[tuple[int, int, float, float, np.ndarray]]:
    """(line, block, west, east, sides) of every line of latitude that a ring reaches.

    ``sides`` are the ring's sides that touch the line, as rows of two ends; no
    other side can tell whether a point of the line is inside.  The ring's part
    on the line lies between ``west`` and ``east``.
    """
    y1, x1 = np.asarray(lats, float), np.asarray(lons, float)
    y2, x2 = np.roll(y1, -1), np.roll(x1, -1)
    upright = y1 != y2
    sides = np.stack([y1, x1, y2, x2], axis=1)[upright]
    if not len(sides):
        return
    low, high = np.minimum(sides[:, 0], sides[:, 2]), np.maximum(sides[:, 0], sides[:, 2])
    at, line = _runs(_line_of(low), _line_of(high))
    order = np.argsort(line, kind="stable")
    at, line = at[order], line[order]
    ends = np.flatnonzero(np.diff(line, append=line[-1] + 1)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        some = sides[at[a:b]]
        yield int(line[a]), block, float(some[:, [1, 3]].min()), float(some[:, [1, 3]].max()), some


def _inside(lat: np.ndarray, lon: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Even-odd test of many points against the sides of one ring, straight in latitude and longitude."""
    odd = np.zeros(len(lat), bool)
    for y1, x1, y2, x2 in sides.tolist():
        odd ^= ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
    return odd


def _line_hits(held: Sequence[tuple], lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, block) of the points of one line, in order of longitude, inside each ring's part of it, in order of its western end.

    A ring is active between its ends; corners are looked at for the points
    between them alone.
    """
    rows, blocks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for _, block, west, east, sides in held:
        a, b = int(np.searchsorted(lon, west, "left")), int(np.searchsorted(lon, east, "right"))
        if a < b:
            some = a + np.flatnonzero(_inside(lat[a:b], lon[a:b], sides))
            rows.append(some)
            blocks.append(np.full(len(some), block, np.int64))
    return np.concatenate(rows), np.concatenate(blocks)


def _by_west(lines: Iterator[tuple]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for x in lines:
        out.setdefault(x[0], []).append(x)
    for v in out.values():
        v.sort(key=lambda x: x[2])
    return out


def _sweep_lines(active: dict[int, list[tuple]], lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, block) of every point inside a ring: points are sorted by line and longitude and swept past the rings of each line."""
    where = _line_of(lat)
    order = np.lexsort((lon, where))
    lines, first = np.unique(where[order], return_index=True)
    ends = np.append(first[1:], len(order))
    rows, blocks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, a, b in zip(lines.tolist(), first.tolist(), ends.tolist()):
        if i in active:
            run = order[a:b]
            row, block = _line_hits(active[i], lat[run], lon[run])
            rows.append(run[row])
            blocks.append(block)
    return np.concatenate(rows), np.concatenate(blocks)


_REGION = "id bigint, own int, region int"


def _found(b: pa.RecordBatch, row: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("own").take(take), pa.array(block.astype(np.int32))], names=["id", "own", "region"])


def containing_regions(points: DataFrame, regions: DataFrame, most_corners: int = 500_000) -> DataFrame:
    """Every usable point with each region that contains it.

    ``points`` has ``id``, ``latitude``, ``longitude`` and ``own`` (any INT, kept);
    ``regions`` has ``block_id`` and rings.  Result: ``id``, ``own``, ``region``.
    A point in several regions gives several rows; a point in none gives none.
    Several rows of a point give several rows.

    Rings are cut at lines of latitude and points are sorted and swept past the
    rings of their line, whatever the number of rings.  That number only decides
    where they meet: up to ``most_corners`` corners (8 MB, counted first) the
    rings go to the points, which need not move; beyond it both are shuffled by
    line.
    """
    shaped = rings(regions).select("block_id", "ring_lat", "ring_lon")
    corners = shaped.agg(F.sum(F.size("ring_lat"))).first()[0] or 0
    pts = usable(points).where("id IS NOT NULL").select("id", "own", "latitude", "longitude")
    if corners > most_corners:
        return _meet_by_line(pts, shaped)
    held = points.sparkSession.sparkContext.broadcast(_by_west(x for r in shaped.collect() for x in ring_lines(*r)))  # bounded by most_corners

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            yield _found(b, *_sweep_lines(held.value, _column(b, "latitude"), _column(b, "longitude")))

    return pts.mapInArrow(scan, _REGION)


def _meet_by_line(pts: DataFrame, shaped: DataFrame) -> DataFrame:
    """Points and rings shuffled by line of latitude, a crowded line in several shares.

    Points are counted by line first; a line of more than a partition's part of
    them is shared out by hash, and its rings go to every share.  A task holds
    the rings of one line and a batch of points.
    """
    parts = int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.floor(F.col("latitude") * PER_DEGREE).cast("bigint")
    counts = pts.groupBy(line.alias("line")).agg(F.count(F.lit(1)).alias("n"))
    target = F.greatest(F.ceil(F.sum("n").over(Window.partitionBy(F.lit(1))) / parts), F.lit(1))  # over a row a line, 46,081 at most
    shares = F.broadcast(counts.select("line", F.ceil(F.col("n") / target).cast("int").alias("shares")))
    placed = pts.withColumn("line", line).join(shares, "line").select(
        "line", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), F.col("longitude").alias("west"), F.lit(0.0).alias("east"), F.array("latitude").alias("sides"), "id", "own")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lats, lons in zip(*(b.column(c).to_pylist() for c in ("block_id", "ring_lat", "ring_lon"))):
                rows = list(ring_lines(block, lats, lons))
                for k in range(0, len(rows), 1_000):
                    some = rows[k:k + 1_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int32()), pa.array([r[2] for r in some]), pa.array([r[3] for r in some]), pa.array([r[4].ravel() for r in some], pa.list_(pa.float64()))], names=["line", "own", "west", "east", "sides"])

    lines = shaped.mapInArrow(cut, "line bigint, own int, west double, east double, sides array<double>").join(shares, "line")
    cast = lines.select("line", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "west", "east", "sides", F.lit(None).cast("bigint").alias("id"), "own")
    both = placed.unionByName(cast).repartition(parts, "line", "share").sortWithinPartitions("line", "share", "kind", "west")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for b in _chunks(batches):
            names = [_column(b, c) for c in ("line", "share", "kind")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1
            for a, z in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                run = b.slice(a, z - a)
                if (place := (names[0][a], names[1][a])) != here:
                    here, held = place, []
                if names[2][a] == 0:
                    held += [(None, r["own"], r["west"], r["east"], np.array(r["sides"]).reshape(-1, 4)) for r in run.select(["own", "west", "east", "sides"]).to_pylist()]
                elif held:
                    yield _found(run, *_line_hits(held, run.column("sides").flatten().to_numpy(), _column(run, "west")))

    return both.mapInArrow(sweep, _REGION)


def message_points(messages: DataFrame) -> DataFrame:
    """Messages with what the two relations need; ``grp`` is the day of ``sent_at``, ``side`` 0 for requests and 1 for drivers."""
    side = F.when(F.col("msg_type") == "RIDE_REQUEST", 0).when(F.col("msg_type").isin("DRIVER_LOCATION", "ENTERING_BLOCK"), 1)
    return messages.select(F.col("msg_id").alias("id"), F.unix_date(F.to_date("sent_at")).cast("bigint").alias("grp"), "latitude", "longitude", side.alias("side"), F.col("block_id").alias("own"))


def dispatch_relations(messages: DataFrame, blocks: DataFrame, radius_m: float = 30.0) -> DataFrame:
    """Drivers near ride requests, and messages whose block is not the one they are in.

    Result: ``relation``, ``id_a``, ``id_b``.  'near': a RIDE_REQUEST and a
    DRIVER_LOCATION or ENTERING_BLOCK message of the same day within
    ``radius_m``, smaller ``msg_id`` first.  'block': a message (``id_b``) inside
    a ring of block ``id_a`` while its own block is null or another.  A message
    delivered again counts once.
    """
    pts = message_points(messages)
    pairs = near_pairs_tagged(pts, radius_m)
    near = pairs.where("left_id <> right_id").select(F.lit("near").alias("relation"), F.least("left_id", "right_id").alias("id_a"), F.greatest("left_id", "right_id").alias("id_b"))
    inside = containing_regions(pts, blocks).where("own IS NULL OR own <> region").select(F.lit("block").alias("relation"), F.col("region").cast("bigint").alias("id_a"), F.col("id").alias("id_b")).distinct()
    return near.unionByName(inside)


def match_candidates(messages: DataFrame, radius_m: float = 30.0, n: int = 3) -> DataFrame:
    """For each ride request the ``n`` nearest driver messages of its day: ``request_id``, ``place``, ``driver_msg_id``, ``distance_m``."""
    pairs = near_pairs_tagged(message_points(messages), radius_m)
    w = Window.partitionBy("left_id").orderBy("distance_m", "right_id")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(F.col("left_id").alias("request_id"), "place", F.col("right_id").alias("driver_msg_id"), F.round("distance_m", 3).alias("distance_m"))
