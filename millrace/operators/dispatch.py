"""Routing of dispatch messages and matching of drivers to ride requests."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the message format.
LOCATION = "DRIVER_LOCATION"
EVENTS = ("LEAVING_BLOCK", "ENTERING_BLOCK", "RIDE_REQUEST", "RIDE_COMPLETE")
AVAILABLE = "AVAILABLE"
PARTITIONS = 5
COLUMNS = ("arrival_id", "msg_type", "block_id", "driver_id", "client_id", "latitude", "longitude", "rating", "user_rating", "salary", "gender", "gender_preference", "status")
NEEDED = ("driver_id", "block_id", "latitude", "longitude", "rating", "salary", "gender", "status")
MATCH = "block_id int, arrival_id bigint, driver_id int, client_id int"


def route(messages: DataFrame) -> DataFrame:
    """Messages with the ``topic`` and ``partition`` they go to; rows without type or block, or of unknown type, are left out."""
    topic = F.when(F.col("msg_type") == LOCATION, "driver-locations").when(F.col("msg_type").isin(*EVENTS), "events")
    return messages.where("msg_type IS NOT NULL AND block_id IS NOT NULL").withColumn("topic", topic).where("topic IS NOT NULL").withColumn("partition", F.pmod(F.col("block_id"), F.lit(PARTITIONS)))


def dead_letters(messages: DataFrame) -> DataFrame:
    """What :func:`route` leaves out."""
    known = F.coalesce(F.col("msg_type").isin(LOCATION, *EVENTS), F.lit(False))
    return messages.where(~(known & F.col("block_id").isNotNull()))


def match_score(dist: Column, gender_fits: Column, rating: Column, salary: Column) -> Column:
    """A driver's score for a request."""
    return F.lit(0.4) * F.exp(-dist) + F.lit(0.1) * gender_fits.cast("double") + F.lit(0.3) * rating / 5 + F.lit(0.2) * (1 - salary / 100)


def plane_distance(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Distance in degrees."""
    return F.sqrt(F.pow(lat_a - lat_b, F.lit(2)) + F.pow(lon_a - lon_b, F.lit(2)))


BEYOND = 0.5  # most that distance and gender add to a driver's score


def best_drivers(requests: DataFrame, drivers: DataFrame, on: str, most_requests: int = 500_000, most_drivers: int = 200_000) -> DataFrame:
    """For every request the best driver of the same ``on``: ``request``, ``driver``, ``score``.

    Drivers under a salary of 100 come first, then greater scores, then smaller
    drivers.  Drivers without a position, rating or salary match nobody, those
    without a gender fit requests that ask for none; requests without a position
    or ``on`` get no driver.

    No pair is formed.  Of a key's drivers only those are kept that can win:
    under a salary of 100 if any is, and with a rating and salary worth at most
    ``BEYOND`` less than the best one's.  Keys of many requests or drivers are
    shared out in parts of ``most_requests`` and ``most_drivers``, every part of
    the one meeting every part of the other; in a task drivers lie in order of
    what rating and salary are worth, and requests stop looking where the rest
    cannot beat what they have.  A request's best of all parts is its result.
    """
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    worth = F.lit(0.3) * F.col("rating") / 5 + F.lit(0.2) * (1 - F.col("salary") / 100)
    able = drivers.where(F.col(on).isNotNull() & F.col("driver").isNotNull()).select(
        F.col(on).alias("area"), F.col("driver").cast("bigint").alias("id"), F.col("driver_lat").cast("double").alias("lat"), F.col("driver_lon").cast("double").alias("lon"), F.coalesce("gender", F.lit("")).alias("gender"),
        F.col("rating").cast("double").alias("rating"), F.col("salary").cast("double").alias("salary"), worth.cast("double").alias("worth")).where("lat IS NOT NULL AND lon IS NOT NULL AND worth IS NOT NULL")
    asked = requests.where(F.col(on).isNotNull() & F.col("request").isNotNull()).select(
        F.col(on).alias("area"), F.col("request").cast("bigint").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.coalesce("preference", F.lit("-")).alias("gender")).where("lat IS NOT NULL AND lon IS NOT NULL")
    best = able.groupBy("area").agg(F.max(F.struct((F.col("salary") < 100).alias("cheap"), "worth")).alias("best"))
    kept = able.join(best, "area").where(((F.col("salary") < 100) == F.col("best.cheap")) & (F.col("worth") >= F.col("best.worth") - BEYOND - 1e-9)).drop("best")
    shares = asked.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / most_requests).cast("int").alias("r_of")).join(kept.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / most_drivers).cast("int").alias("d_of")), "area")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None).cast("double")
    right = kept.join(shares, "area").withColumn("d", own("d_of")).withColumn("r", each("r_of")).select("area", "r", "d", F.lit(0).alias("kind"), (-F.col("worth")).alias("rank"), "id", "lat", "lon", "gender", "rating", "salary")
    left = asked.join(shares, "area").withColumn("r", own("r_of")).withColumn("d", each("d_of")).select("area", "r", "d", F.lit(1).alias("kind"), F.lit(0.0).alias("rank"), "id", "lat", "lon", "gender", none.alias("rating"), none.alias("salary"))
    met = left.unionByName(right).repartition(parts, "area", "r", "d").sortWithinPartitions("area", "r", "d", "kind", "rank", "id")
    found = met.mapInArrow(_meet, "request bigint, cheap boolean, score double, driver bigint")
    top = found.groupBy("request").agg(F.max(F.struct("cheap", "score", (-F.col("driver")).alias("last"))).alias("t"))
    return top.select("request", (-F.col("t.last")).alias("driver"), F.col("t.score").alias("score"))


def _meet(batches: Iterator[pa.RecordBatch], chunk: int = 256) -> Iterator[pa.RecordBatch]:
    """The best driver of each request, from rows in order of (area, parts, drivers before requests, falling worth)."""
    here, held, cols = None, [], None
    for b in batches:
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("area", "r", "d", "kind")]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, z in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
            run = b.slice(a, z - a)
            if (place := tuple(k[a] for k in keys[:3])) != here:
                here, held, cols = place, [], None
            if keys[3][a] == 0:
                held.append(run)
            elif held:
                if cols is None:
                    whole = pa.Table.from_batches(held)
                    cols = {c: whole.column(c).to_numpy() for c in ("rank", "id", "lat", "lon", "gender", "rating", "salary")}
                yield _best_of(cols, run, chunk)


def _best_of(d: dict[str, np.ndarray], run: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
    ids, lat, lon, wish = (run.column(c).to_numpy(zero_copy_only=False) for c in ("id", "lat", "lon", "gender"))
    score, who = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
    for at in range(0, len(d["id"]), chunk):
        open_ = np.flatnonzero(score <= BEYOND + 1e-9 - d["rank"][at])  # rank is the worth with its sign turned
        if not len(open_):
            break
        c = slice(at, at + chunk)
        for part in np.array_split(open_, max(len(open_) // 4_096, 1)):
            apart = np.sqrt((lat[part, None] - d["lat"][c]) ** 2 + (lon[part, None] - d["lon"][c]) ** 2)
            fits = (wish[part, None] == "N") | (wish[part, None] == d["gender"][c])
            got = 0.4 * np.exp(-apart) + 0.1 * fits + 0.3 * d["rating"][c] / 5 + 0.2 * (1 - d["salary"][c] / 100)
            top = got.max(axis=1)
            first = np.where(got == top[:, None], d["id"][c], np.iinfo(np.int64).max).min(axis=1)
            better = (top > score[part]) | ((top == score[part]) & (first < who[part]))
            score[part[better]], who[part[better]] = top[better], first[better]
    cheap = bool(d["salary"][0] < 100)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), cheap)), pa.array(score), pa.array(who)], names=["request", "cheap", "score", "driver"])


@dataclass
class Pool:
    """The drivers of one block.  Messages must come in order.

    Available drivers lie in order of salary class and of what rating and salary
    are worth, so that a request looks no further than its best can be beaten.
    """

    readmit: bool = False
    drivers: dict[int, dict] = field(default_factory=dict)
    gone: dict[int, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._order = sorted(self._place(who, d) for who, d in self.drivers.items() if d["status"] == AVAILABLE)

    @staticmethod
    def _place(who: int, d: dict) -> tuple[bool, float, int]:
        return d["salary"] >= 100, -(0.3 * d["rating"] / 5 + 0.2 * (1 - d["salary"] / 100)), who

    def _put(self, who: int, d: dict) -> None:
        self._take(who)
        self.drivers[who] = d
        if d["status"] == AVAILABLE:
            insort(self._order, self._place(who, d))

    def _take(self, who: int) -> dict | None:
        d = self.drivers.pop(who, None)
        if d is not None and d["status"] == AVAILABLE:
            del self._order[bisect_left(self._order, self._place(who, d))]
        return d

    def handle(self, m: dict) -> tuple[int, int] | None:
        """Take one message; a matched ride request gives (driver, client)."""
        kind, who = m["msg_type"], m["driver_id"]
        if kind == "RIDE_REQUEST":
            return self._match(m)
        if who is None:
            return None
        if kind == "ENTERING_BLOCK":
            if all(m[c] is not None for c in NEEDED):
                self._put(who, {c: m[c] for c in NEEDED})
        elif kind == "LEAVING_BLOCK":
            self._take(who)
        elif kind == LOCATION and who in self.drivers:
            self.drivers[who] |= {"latitude": m["latitude"], "longitude": m["longitude"]}
        elif kind == "RIDE_COMPLETE":
            if self.readmit and who in self.gone:
                self._put(who, self.gone.pop(who))
            d = self.drivers.get(who)
            if d is not None and m["rating"] is not None and m["user_rating"] is not None and m["salary"] is not None:
                self._put(who, d | {"status": AVAILABLE, "salary": m["salary"] + 1, "rating": (m["rating"] + m["user_rating"]) / 2, "latitude": m["latitude"], "longitude": m["longitude"], "gender": m["gender"]})
        return None

    def _match(self, m: dict) -> tuple[int, int] | None:
        if m["client_id"] is None or m["latitude"] is None or m["longitude"] is None:
            return None
        best = None
        for dear, turned, who in self._order:
            if best is not None and (dear > best[0] or turned - BEYOND - 1e-9 > best[1]):
                break  # neither this driver nor one behind it can be better
            d = self.drivers[who]
            if any(d[c] is None for c in NEEDED):
                continue
            dist = math.hypot(d["latitude"] - m["latitude"], d["longitude"] - m["longitude"])
            fits = m["gender_preference"] in ("N", d["gender"])
            score = 0.4 * math.exp(-dist) + 0.1 * fits + 0.3 * d["rating"] / 5 + 0.2 * (1 - d["salary"] / 100)
            rank = (dear, -score, who)
            if best is None or rank < best:
                best = rank
        if best is None:
            return None
        gone = self._take(best[2])
        if self.readmit:
            self.gone[best[2]] = gone
        return best[2], m["client_id"]


def python_rows(pdf: pd.DataFrame) -> Iterator[dict]:
    """Rows of a batch with None for what is missing."""
    values = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in COLUMNS]
    for row in zip(*values):
        yield dict(zip(COLUMNS, row))


def replay(messages: DataFrame, readmit: bool = False, make: Callable[[], Pool] | None = None) -> DataFrame:
    """Matches of a whole log: ``block_id``, ``arrival_id`` (of the request), ``driver_id``, ``client_id``.

    Blocks are independent; within one, messages count in order of
    ``arrival_id``.  A block's messages are sorted by the shuffle and streamed
    past its pool, so a task holds one pool and a batch, however busy the block.
    """
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    make = make or (lambda: Pool(readmit))
    ordered = route(messages).select(*COLUMNS).repartition(parts, "block_id").sortWithinPartitions("block_id", "arrival_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, pool = None, None
        for pdf in batches:
            out = []
            for m in python_rows(pdf):
                if m["block_id"] != block:
                    block, pool = m["block_id"], make()
                got = pool.handle(m)
                if got:
                    out.append((int(block), int(m["arrival_id"]), int(got[0]), int(got[1])))
            yield pd.DataFrame(out, columns=["block_id", "arrival_id", "driver_id", "client_id"])

    return ordered.mapInPandas(run, MATCH)
