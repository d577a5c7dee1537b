"""Readers and writers.  Schemas are declared, never inferred, for text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import schemas


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def pageview_day(file_name: Column) -> Column:
    """Day of the month in ``pageviews-YYYYMMDD-HHMMSS``; null for other names."""
    return F.regexp_extract(file_name, r"pageviews-\d{6}(\d{2})-", 1).try_cast("int")


def read_pageviews(spark: SparkSession, path: str) -> DataFrame:
    """Lines of hourly page-view files (plain or gzip): ``line``, ``day`` from the file's name."""
    return spark.read.text(path).select(F.col("value").alias("line"), pageview_day(F.col("_metadata.file_name")).alias("day"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated follower pairs ``u``, ``v`` (u follows v), without a header."""
    return spark.read.csv(path, sep="\t", schema="u string, v string")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``phrase``, ``n``."""
    return spark.read.csv(path, sep="\t", schema="phrase string, n bigint")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bulk-load file: tab separated, nothing quoted or escaped.  ``path`` may be a folder of parts."""
    return spark.read.csv(path, sep="\t", schema=schema, quote="", escape="")


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Binary objects with path, time, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch messages, one JSON object a line."""
    return parse_messages(spark.read.text(path))


def stream_messages(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """The same as a stream over a folder of JSON-lines files, oldest first."""
    return parse_messages(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def kafka_messages(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """The same from Kafka topics, from the earliest offset (needs Spark's Kafka connector)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topics).option("startingOffsets", "earliest").load())
    return parse_messages(raw.select(F.col("value").cast("string").alias("value")))


def parse_messages(lines: DataFrame) -> DataFrame:
    """Fields of JSON ``value``; text that is no JSON object gives all nulls."""
    return lines.select(F.from_json("value", schemas.MESSAGE).alias("m")).select("m.*")


def jdbc_range(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int = 8, **options: str) -> DataFrame:
    """Rows of a JDBC table with ``column`` in [low, high], read in ``parts`` ranges; the filter is pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts), **options)
    return reader.load().where(F.col(column).between(low, high))


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls kept: ``value``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_pageviews(rows: DataFrame, root: str, month: str, day: str = "day", line: str = "line") -> None:
    """Lines as gzip files ``root``/pageviews-YYYYMMDD-HHMMSS.gz, the day from a column; ``month`` is YYYYMM.

    Each task writes a file a day it has lines of, with its own number for the
    time; rows with a null day or line are left out.  A retried task writes its
    files anew.
    """
    def put(part) -> None:
        import gzip
        import itertools

        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + ("/" + root[5:].lstrip("/") if root.startswith("file:") else root))
        store.create_dir(base, recursive=True)
        for d, some in itertools.groupby(part, key=lambda r: r["d"]):
            name = f"{base}/pageviews-{month}{d:02d}-{TaskContext.get().partitionId():06d}.gz"
            with store.open_output_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", filename="", mtime=0) as out:
                for r in some:
                    out.write((r["l"] + "\n").encode())

    lines = rows.select(F.col(day).alias("d"), F.col(line).alias("l")).where("d IS NOT NULL AND l IS NOT NULL")
    lines.sortWithinPartitions("d").foreachPartition(put)


def as_lines(df: DataFrame, sep: str = "\t") -> DataFrame:
    """Each row as one line of text, columns in order parted by ``sep``, nulls empty: ``value``."""
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def write_objects(df: DataFrame, root: str, key: str = "key", content: str = "content") -> None:
    """Each row's binary content as an object ``root``/key, written by the executors; an object there already is replaced.

    ``root`` is a path or address that pyarrow's file systems know.  A retried
    task writes the same objects again.
    """
    def put(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for r in rows:
            if r[key] is None or r[content] is None:
                continue
            path = f"{base}/{r[key]}"
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path, compression=None) as out:  # a name that ends in .gz says nothing about the content
                out.write(bytes(r[content]))

    df.select(key, content).foreachPartition(put)


def observed(df: DataFrame, name: str = "rows"):
    """(frame, observation): once an action on the frame has run, ``observation.get[name]`` is its number of rows."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias(name)), o


def write_tsv(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> None:
    """Tab-separated text; ``single`` gives one file and is meant for small results only."""
    (df.coalesce(1) if single else df).write.mode(mode).csv(path, sep="\t", quote="", escape="", emptyValue="", nullValue="")


def write_parquet(df: DataFrame, path: str, single: bool = False, sort_by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet.  ``sort_by`` range-partitions and sorts, so that row-group statistics can skip on that key."""
    if sort_by:
        df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
    (df.coalesce(1) if single else df).write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """A table bucketed and sorted by ``key``: later joins and aggregations on it need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A Parquet sink with exactly-once file commits; returns the running query."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_kafka(df: DataFrame, servers: str, checkpoint: str):
    """Columns ``topic``, ``partition``, ``value`` to Kafka with all acknowledgements."""
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("checkpointLocation", checkpoint).start()
