"""Text functions as Columns; all but :func:`html_unescape` stay inside the JVM."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

LINE_END = r"\r\n|\r|\n"

# The patterns decide which words a wiki text has.
LINK = r"(https?|ftp|file)://[-a-zA-Z0-9+&@#/%?=~_|!:,.;]*[-a-zA-Z0-9+&@#/%=~_|]"
REF_TAG = r"</?ref(.*?)>"
LOOSE_APOSTROPHE = r"'+(?=[^a-zA-Z])|(?<=[^a-zA-Z])'+"
NO_LETTER = r"[^a-zA-Z']"
ELEMENT = "<{0}(.*?)>(.*?)</{0}(.*?)>"


def percent_decode(c: Column) -> Column:
    """``%HH`` decoded once over UTF-8; everything else stays, ``+`` and stray ``%`` included.

    Bytes that are no UTF-8 become U+FFFD.  Null gives null.  Text without a
    ``%`` is passed through.
    """
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.url_decode(safe)).otherwise(c)


@pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """Named and numbered HTML entities resolved; null stays null."""
    return s.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def safe_int(c: Column) -> Column:
    """A whole number of 32 bits, or 0 where the text is none; null gives 0."""
    return F.coalesce(F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.try_cast("int")), F.lit(0))


def lines(c: Column) -> Column:
    """The lines of a text, whatever ends them."""
    return F.split(c, LINE_END, -1)


def words(c: Column) -> Column:
    """Words between ASCII white space; no empty ones.  Null gives null."""
    return F.filter(F.split(c, r"[ \t\n\r\f]+", -1), lambda w: w != "")


def clean_wiki_text(c: Column, unescape: bool = True) -> Column:
    """Lower case, entities resolved, links and reference tags out, loose apostrophes out, only letters and inner apostrophes left.

    ``unescape=False`` keeps the whole expression in the JVM, for text without
    entities.
    """
    t = F.lower(c)
    if unescape:
        t = html_unescape(t)
    for pattern in (LINK, REF_TAG, LOOSE_APOSTROPHE, NO_LETTER):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def letters_only(c: Column) -> Column:
    """Lower case with anything but a to z made one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z]+", " "))


def tagged_texts(c: Column, outer: str = "revision", inner: str = "text") -> Column:
    """Contents of every ``inner`` element within every ``outer`` element of a line, not greedy."""
    pattern = lambda tag: F.lit(ELEMENT.format(tag))
    outers = F.regexp_extract_all(c, pattern(outer), F.lit(2))
    return F.flatten(F.transform(outers, lambda r: F.regexp_extract_all(r, pattern(inner), F.lit(2))))


def ngrams(w: Column, longest: int = 5, short_of_whole: bool = False) -> Column:
    """All runs of 1 to ``longest`` words of an array, each joined by blanks.

    ``short_of_whole`` leaves out the run that is the whole of a short array.
    """
    def runs(w: Column) -> Column:
        short = F.size(w) - 1 if short_of_whole else F.size(w)
        top = F.when(F.size(w) < longest, short).otherwise(F.lit(longest))
        made = F.flatten(F.transform(F.sequence(F.lit(1), top), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
        return F.when(top >= 1, made).otherwise(F.array().cast("array<string>"))

    # bound once: the array's own expression would else be evaluated for every run
    return F.flatten(F.transform(F.array(w), runs))


def censor(w: Column, banned: Sequence[str]) -> Column:
    """Words of ``banned`` with all but their first and last letter starred; longer lists belong in a join."""
    return F.when(F.lower(w).isin(list(banned)), F.regexp_replace(w, r"(?<=.).(?=.)", "*")).otherwise(w)


def java_hash(c: Column) -> Column:
    """The 32-bit hash 31 h + c over UTF-16 units of text in the Basic Multilingual Plane."""
    units = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("bigint"))
    folded = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: (h * 31 + u).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(folded >= 2**31, folded - 2**32).otherwise(folded).cast("int")


def shard(c: Column, shards: int = 7) -> Column:
    """Which of ``shards`` a key belongs to: the absolute remainder of its hash."""
    return F.abs(java_hash(c) % shards)


def parity(c: Column) -> Column:
    """1 if a byte has an odd number of set bits."""
    return F.bit_count(c) % 2


def two_places(c: Column) -> Column:
    """A number with two decimals, halves rounded up; null gives null."""
    return F.when(c.isNotNull(), F.format_string("%.2f", c.cast("double")))


def without_extension(c: Column) -> Column:
    """A path without its last extension; a leading dot of a name is none."""
    return F.regexp_replace(c, r"(?<=[^/])\.[^./]*$", "")


def namespaces(c: Column) -> Column:
    """Prefixes of page titles: lower case, blanks as ``_``, a colon behind."""
    return F.concat(F.lower(F.replace(c, F.lit(" "), F.lit("_"))), F.lit(":"))
