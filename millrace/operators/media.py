"""Object-store notices, label documents and frame sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import without_extension
from millrace.sources import schemas


def store_objects(events: DataFrame, value: str = "value") -> DataFrame:
    """``bucket`` and ``key`` of every record of JSON notices, bare or wrapped in another notice's message."""
    wrapped = events.select(F.explode_outer(F.from_json(value, schemas.NOTICE)["Records"]).alias("r"), F.col(value).alias("v"))
    body = wrapped.select(F.coalesce("r.Sns.Message", "v").alias("body")).distinct()
    return body.select(F.explode(F.from_json("body", schemas.STORE_EVENT)["Records"]).alias("r")).select(F.col("r.s3.bucket.name").alias("bucket"), F.col("r.s3.object.key").alias("key")).where("key IS NOT NULL")


def detected_labels(images: DataFrame) -> DataFrame:
    """``images`` with the column ``labels`` a vision service would fill; it is none of this engine's, so the array is empty."""
    return images.withColumn("labels", F.array().cast("array<string>"))


def label_documents(labels: DataFrame, key: str, names: Column) -> DataFrame:
    """One document a key for the search index: ``id``, ``type``, ``fields``; the id is the key without its extension."""
    return labels.select(without_extension(F.col(key)).alias("id"), F.lit("add").alias("type"), F.struct(F.col(key).cast("string").alias("key"), names.alias("labels")).alias("fields"))


def label_index(labels: DataFrame, key: str, names: Column) -> DataFrame:
    """``label`` with the number of keys that have it and the first and last of them.

    The full lists are :func:`label_postings`: a label that most keys have must
    not become one row.
    """
    return label_postings(labels, key, names).groupBy("label").agg(F.count(F.lit(1)).alias("keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def label_postings(labels: DataFrame, key: str, names: Column) -> DataFrame:
    """``label``, ``key``: each key once for each of its labels."""
    return labels.select(F.explode(names).alias("label"), F.col(key).alias("key")).where("label IS NOT NULL AND label <> ''").distinct()


def sample_frames(events: DataFrame, key: str, ts: str, every: str) -> DataFrame:
    """Of each key the first event in every window of length ``every``: all columns of it under ``frame``.

    Equal times go by the least other columns.
    """
    others = [c for c in events.columns if c not in (key, ts)]
    first = F.min(F.struct(F.col(ts), *others)).alias("frame")
    return events.where(F.col(ts).isNotNull()).groupBy(F.col(key), F.window(F.col(ts).cast("timestamp"), every).alias("w")).agg(first).select(key, F.col("w.start").alias("window_start"), "frame.*")
