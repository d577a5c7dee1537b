"""Word counts, 1-to-5-gram counts and the two completion models built from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import lines, ngrams, words
from millrace.session import cut_lineage, spread

#: Least probability (exclusive) and most suffixes by suffix length; fixed values of the phrase model.
LEAST = {1: 0.05, 2: 0.03, 3: 0.01, 4: 0.005}
MOST = {1: 3, 2: 2, 3: 2, 4: 1}


def word_count(texts: DataFrame, column: str = "text") -> DataFrame:
    """``word`` and ``n`` over all texts."""
    return texts.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def ngram_counts(texts: DataFrame, clean=None, column: str = "text", longest: int = 5, more_than: int = 2, short_of_whole: bool = False) -> DataFrame:
    """``phrase`` and ``n`` of runs of 1 to ``longest`` words within a line, seen more than ``more_than`` times.

    ``clean`` turns a line into blank-separated words.  Lines are parted first,
    so a row of runs is as long as a line, not as a text.
    """
    line = spread(texts.select(column)).select(F.explode(lines(F.col(column))).alias("line"))
    if clean is not None:
        line = line.select(clean(F.col("line")).alias("line"))
    runs = line.where("trim(line) <> ''").select(F.explode(ngrams(words(F.col("line")), longest, short_of_whole)).alias("phrase"))
    return runs.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def ratio(part: Column, whole: Column) -> Column:
    """Their quotient in single precision."""
    return (part.cast("float") / whole.cast("float")).cast("float")


def next_words(counts: DataFrame, n: int = 5) -> DataFrame:
    """``prefix``, ``suffix``, ``prob``: the ``n`` likeliest words after each phrase that is counted itself.

    Order is by count, equal counts by word.  ``counts`` is needed as phrases
    and as prefixes; it is written once, as filters on either use would else
    keep them from sharing the counting.
    """
    counts = cut_lineage(counts)
    w = F.split("phrase", " ")
    ext = counts.select(w.alias("w"), "n").where(F.size("w") >= 2).select(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " ").alias("prefix"), F.element_at("w", -1).alias("suffix"), "n")
    joined = ext.join(counts.select(F.col("phrase").alias("prefix"), F.col("n").alias("whole")), "prefix")
    best = Window.partitionBy("prefix").orderBy(F.desc("n"), "suffix")
    return joined.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).select("prefix", "suffix", ratio(F.col("n"), F.col("whole")).alias("prob"))


def by_length(length: Column, values: Mapping[int, float]) -> Column:
    """The value of a length; null where there is none."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(length == k, F.lit(v)).otherwise(out)
    return out


def phrase_completions(counts: DataFrame, least: Mapping[int, float] = LEAST, most: Mapping[int, int] = MOST) -> DataFrame:
    """``prefix``, ``suffix``, ``suffix_len``, ``prob``: likely completions of one to four words after each phrase.

    By suffix length, a completion's probability must be over ``least`` and it
    must be among the ``most`` most frequent of its prefix, equal counts by text.
    ``counts`` is written once, as in :func:`next_words`.
    """
    counts = cut_lineage(counts)
    w = F.split("phrase", " ")
    cut = lambda i: F.struct(F.array_join(F.slice("w", F.lit(1), i), " ").alias("prefix"), F.array_join(F.slice("w", i + 1, F.size("w") - i), " ").alias("suffix"), (F.size("w") - i).alias("suffix_len"))
    splits = counts.select(w.alias("w"), "n").where(F.size("w") >= 2).select("n", F.inline(F.transform(F.sequence(F.lit(1), F.size("w") - 1), cut))).where(F.col("suffix_len") <= max(least))
    joined = splits.join(counts.select(F.col("phrase").alias("prefix"), F.col("n").alias("whole")), "prefix").withColumn("prob", ratio(F.col("n"), F.col("whole")))
    over = joined.where(F.col("prob") > by_length(F.col("suffix_len"), least).cast("float"))
    best = Window.partitionBy("prefix", "suffix_len").orderBy(F.desc("n"), "suffix")
    return over.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= by_length(F.col("suffix_len"), most)).select("prefix", "suffix", "suffix_len", "prob")
