"""Cleaning of hourly page-view lines, counts of titles and 30-day vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import lines, namespaces, percent_decode, safe_int

# They decide which pages count.
DOMAINS = ("en", "en.m")
NAMESPACES = ("special", "media", "talk", "user", "wikipedia", "file", "timedtext", "mediawiki", "template", "help", "category", "portal", "topic", "book", "draft", "module", "gadget", "education_program", "gadget_definition")
EXTENSIONS = ("png", "gif", "jpg", "jpeg", "tiff", "tif", "xcf", "mid", "ogg", "ogv", "svg", "djvu", "oga", "flac", "opus", "wav", "webm", "ico", "txt")
SPECIAL_PAGES = ("404.php", "Main_Page", "-")
DISAMBIGUATION = "_(disambiguation)"


def countable(title: Column) -> Column:
    """Whether a decoded title is an article: not empty, no namespace, not of a lower-case initial, no file, no special page."""
    return (
        (title != "") & ~title.rlike("(?i)^(" + "|".join(NAMESPACES) + ")(_talk)?:") & ~title.rlike("^[a-z]")
        & ~F.lower(title).endswith(DISAMBIGUATION) & ~title.rlike(r"(?i)\.(" + "|".join(EXTENSIONS) + r")\z") & ~title.isin(*SPECIAL_PAGES)
    )


def clean_views(rows: DataFrame, line: str = "line", day: str = "day") -> DataFrame:
    """``title``, ``day``, ``views`` of the lines that count.

    A line has exactly four fields parted by single blanks: domain, title,
    views, bytes; views that are no number count 0.  Null lines are left out.
    """
    parts = F.split(F.regexp_replace(F.col(line), " +$", ""), " ", -1)
    split = rows.select(F.col(day).alias("day"), parts.alias("p")).where(F.size("p") == 4).where(F.get("p", F.lit(0)).isin(*DOMAINS))
    titled = split.select(percent_decode(F.get("p", F.lit(1))).alias("title"), "day", safe_int(F.get("p", F.lit(2))).alias("views"))
    return titled.where(countable(F.col("title")))


def note_lines(documents: DataFrame) -> DataFrame:
    """Every line of every text with the day of the month it was written."""
    return documents.select(F.dayofmonth("written_at").alias("day"), F.explode(lines(F.col("text"))).alias("line"))


def title_counts(views: DataFrame) -> DataFrame:
    """``title`` and ``views``, summed up."""
    return views.groupBy("title").agg(F.sum(F.col("views").cast("bigint")).alias("views"))


def ordered_counts(views: DataFrame) -> DataFrame:
    """The same by falling views, then title."""
    return title_counts(views).orderBy(F.desc("views"), "title")


def daily_vectors(views: DataFrame, more_than: int = 100_000, days: int = 30) -> DataFrame:
    """``total``, ``title`` and ``daily``, an array of views a day, of titles with more than ``more_than`` views.

    Days outside 1 to ``days`` do not count.  All days are summed in one
    aggregation, so titles are shuffled once, as one partial row a task.
    """
    v = F.col("views").cast("bigint")
    daily = [F.coalesce(F.sum(F.when(F.col("day") == d, v)), F.lit(0)).alias(f"_{d}") for d in range(1, days + 1)]
    sums = views.where(F.col("day").between(1, days)).groupBy("title").agg(F.sum(v).alias("total"), *daily)
    return sums.where(F.col("total") > more_than).select("total", "title", F.array(*[f"_{d}" for d in range(1, days + 1)]).alias("daily"))


def namespace_prefixes(json_rows: DataFrame, value: str = "value") -> DataFrame:
    """Prefixes listed by a namespaces document, all but that of id 0: ``prefix``."""
    parsed = json_rows.select(F.explode(F.from_json(value, "query struct<namespaces: map<string, map<string, string>>>")["query"]["namespaces"]).alias("id", "names"))
    return parsed.where("id <> '0'").select(F.explode(F.map_values("names")).alias("name")).select(namespaces(F.col("name")).alias("prefix")).distinct()
