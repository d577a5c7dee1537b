"""Streams: stateful matching of drivers, windowed counts with a watermark, windowed alarms."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from millrace.operators.dispatch import COLUMNS, MATCH, Pool, route


class Matcher(StatefulProcessor):
    """A block's pool of drivers as map state, one entry a driver.

    A trigger's messages of a block are taken in order of ``arrival_id``; order
    across triggers is the source's.  What a trigger holds is bounded by the
    source's limit on files or offsets a trigger.
    """

    def __init__(self, readmit: bool = False):
        self.readmit = readmit

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = StructType([StructField("driver_id", StringType())])
        value = StructType([StructField("driver", StringType())])
        self.pool = handle.getMapState("pool", key, value)
        self.gone = handle.getMapState("gone", key, value)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator[Row]:
        load = lambda state: {int(k[0]): json.loads(v[0]) for k, v in state.iterator()}
        pool = Pool(self.readmit, load(self.pool), load(self.gone))
        had = set(pool.drivers), set(pool.gone)
        out, named = [], set()
        for r in sorted((r.asDict() for r in rows), key=lambda r: r["arrival_id"]):
            named.add(r["driver_id"])
            got = pool.handle(r)
            if got:
                named.add(got[0])
                out.append(Row(block_id=int(key[0]), arrival_id=r["arrival_id"], driver_id=got[0], client_id=got[1]))
        # only drivers that a message or a match names can have changed
        for state, old, new in ((self.pool, had[0], pool.drivers), (self.gone, had[1], pool.gone)):
            for k in named - {None}:
                if k in new:
                    state.updateValue((str(k),), (json.dumps(new[k]),))
                elif k in old:
                    state.removeKey((str(k),))
        return iter(out)

    def close(self) -> None:
        pass


def match_stream(messages: DataFrame, readmit: bool = False) -> DataFrame:
    """Matches of a stream of messages, as :func:`millrace.operators.dispatch.replay` gives for a log."""
    return route(messages).select(*COLUMNS).groupBy("block_id").transformWithState(statefulProcessor=Matcher(readmit), outputStructType=MATCH, outputMode="append", timeMode="none")


def window_counts(events: DataFrame, ts: str, key: str, value: str, length: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Count and sum of ``value`` per window and key; events later than ``late`` are dropped and finished windows emitted once.

    Without ``late`` nothing is dropped and no window is ever finished: for
    :func:`run_whole`, on a source that ends.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed if late is None else timed.withWatermark("_ts", late)
    sums = timed.groupBy(F.window("_ts", length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), key, "n", "total")


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything the source holds now, written as Parquet and read back; a second call takes up where the first ended."""
    query = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_whole(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """An aggregate of everything the source holds now, open windows too; each trigger writes the whole result anew.

    A second call goes on from where the first ended.  State and result have a row a group.
    """
    df.sparkSession.createDataFrame([], df.schema).write.mode("ignore").parquet(path)  # a source without rows has no trigger
    write = lambda rows, _: rows.write.mode("overwrite").parquet(path)
    query = df.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
