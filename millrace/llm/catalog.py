"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import abuse, mixing, packing, splitting, topn
from millrace.sources.tables import table


def p3_found(spark, root):
    return topn.top_tweets(table(spark, root, "q4")).select("uuid", "tweetid")


def p3_top_tweets(spark, root):
    return topn.top_tweets(table(spark, root, "q4"), 10)


def _scored(spark, root):
    return abuse.score_tweets(table(spark, root, "q4"), table(spark, root, "tweet_labels"))


def p4_found(spark, root):
    return _scored(spark, root).where("abusive").select("tweetid")


def p4_scores(spark, root):
    return _scored(spark, root)


def p4_rates(spark, root):
    return abuse.rates(_scored(spark, root))


def p6_containers(spark, root):
    return packing.pack_documents(table(spark, root, "documents"))


def p6_fill(spark, root):
    placed, plan = packing.pack(table(spark, root, "documents"))
    report = packing.fill_report(placed)
    return report.withColumn("program_bound", F.lit(plan.bound)).withColumn("by_program", F.lit(plan.by_program))


def _mixture(spark, root):
    return mixing.Mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p7_documents(spark, root):
    return _mixture(spark, root).documents()


def p7_shares(spark, root):
    return _mixture(spark, root).shares()


def p7_mixture(spark, root):
    return _mixture(spark, root).tokens()


def p8_pieces(spark, root):
    return splitting.split_documents(table(spark, root, "documents"))


QUERIES = {"p3_found": p3_found, "p3_top_tweets": p3_top_tweets, "p4_found": p4_found, "p4_scores": p4_scores, "p4_rates": p4_rates, "p6_containers": p6_containers, "p6_fill": p6_fill,
           "p7_documents": p7_documents, "p7_shares": p7_shares, "p7_mixture": p7_mixture,
           "p8_pieces": p8_pieces}

_LATEST = """
latest AS (
  SELECT tweetid, uuid, coalesce(favorite_count, 0) + coalesce(retweet_count, 0) AS engagement FROM q4 WHERE tweetid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY tweetid ORDER BY crawled_at DESC NULLS LAST, coalesce(favorite_count, 0) + coalesce(retweet_count, 0) DESC, uuid DESC NULLS LAST) = 1),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY uuid ORDER BY engagement DESC, tweetid) AS INTEGER) AS place FROM latest WHERE uuid IS NOT NULL)"""

ORACLE = {
    "p3_found": f"WITH {_LATEST} SELECT uuid, tweetid FROM ranked WHERE place <= 3",
    "p3_top_tweets": f"WITH {_LATEST} SELECT uuid, place, tweetid, engagement FROM ranked WHERE place <= 10",
}
