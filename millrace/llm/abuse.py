"""Scores for abusive, hateful or sexual text by a linear-chain conditional random field.

Tokens are tagged T (part of a toxic span) or O.  The labels at hand are
verdicts of fallible reviewers on whole tweets, so the tags of tokens are
latent: a tweet is abusive if any token is T.  With O scored 0 throughout, the
path of only O has weight 1, hence P(abusive) = 1 - 1/Z, and forward-backward
marginals give the exact gradient.  Reviewers' error rates are estimated along
with the field: the target of a tweet is the posterior of its verdicts and a
prediction by a field that has not seen it.  All that the field knows of words it
has from the labelled tweets: there is no word list and no weight set by hand.
Features are hashed to rows of one table, in whole batches at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.spelling import Speller, plain

#: Most labelled tweets used to fit; the ones of smallest hash are taken.
MOST_LABELLED = 20_000
STRENGTH = 1.0  # of the pull of weights to 0
LONGEST = 400  # tokens of the texts that are padded alike when fitting
BITS = 20  # of a feature's row
QUOTES = set("\"“”«»„")
HOW = {"": 0, "drawn": 1, "alike": 2, "apart": 3, "leet": 4, "mask": 5}

Tokens = Sequence[tuple[str, str, int, int]]


@lru_cache(maxsize=200_000)
def _hashes(word: str) -> tuple[int, int, int]:
    """A word's number, and those of its beginning and end."""
    number = lambda x: xxhash.xxh64_intdigest(x)
    plain_word = len(word) > 3 and word[0] != "<"
    return number(word), number("^" + word[:4]) if plain_word else 0, number("$" + word[-3:]) if plain_word else 0


def _row(kind: int, *parts: np.ndarray) -> np.ndarray:
    """The table row of a feature of some kind: a mix of its parts' numbers."""
    z = np.full(len(parts[0]), np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    for p in parts:
        z = (z ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
    z *= np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(64 - BITS)).astype(np.int64)


KINDS = 22


def feature_rows(docs: Sequence[Tokens]) -> np.ndarray:
    """Table rows of the features of all tokens of all texts, one after another: (tokens, ``KINDS``).

    A token has its word, spelling and disguise, the words on either side and
    up to four further off, in pairs and threes, and its word with what the text
    holds: names, links, and quotation marks opened before it.
    """
    n = [len(d) for d in docs]
    width = sum(n) + 8 * (len(docs) + 1)
    word, head, tail, how, about = (np.zeros(width, np.uint64) for _ in range(5))
    place, at = np.empty(sum(n), np.int64), 8
    done = 0
    for d in docs:
        k = len(d)
        if k:
            numbers = np.array([_hashes(t[0]) for t in d], np.uint64)
            word[at:at + k], head[at:at + k], tail[at:at + k] = numbers.T
            how[at:at + k] = [HOW[t[1]] for t in d]
            marks = np.cumsum([t[0] in QUOTES for t in d]) & 1
            names = {t[0] for t in d}
            about[at:at + k] = marks + 2 * ("<user>" in names) + 4 * ("<url>" in names) + 8
            place[done:done + k] = np.arange(at, at + k)
            done += k
        at += k + 8
    w = {d: word[place + d] for d in range(-4, 5)}
    h = how[place]
    with np.errstate(over="ignore"):
        rows = [
            np.zeros(len(place), np.int64), _row(1, w[0]), _row(2, w[-1]), _row(3, w[1]), _row(4, w[-1], w[0]), _row(5, w[0], w[1]), _row(6, w[-2], w[-1], w[0]), _row(7, w[0], w[1], w[2]),
            _row(8, w[-1], w[1]), _row(9, h), _row(10, h, w[0]), _row(11, head[place]), _row(12, tail[place]), _row(13, about[place], w[0]),
            *[_row(14 + k, w[0], w[d]) for k, d in enumerate((-4, -3, -2, 2, 3, 4))], _row(20, w[-2]), _row(21, w[2]),
        ]
    rows = np.stack(rows, axis=1)
    rows[:, 1:] = np.maximum(rows[:, 1:], 1)  # row 0 is the bias
    return rows


@dataclass
class Field:
    """Weights of a fitted field."""

    table: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    trans: np.ndarray = field(default_factory=lambda: np.zeros(3))
    reviewers: dict[str, tuple[float, float]] = field(default_factory=dict)
    odds: dict[str, float] = field(default_factory=dict)

    def speller(self) -> Speller:
        if getattr(self, "_speller", None) is None:
            self._speller = Speller(self.odds)
        return self._speller

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_speller"}

    def emissions(self, docs: Sequence[Tokens]) -> np.ndarray:
        """How much likelier T than O each token of all texts is, one after another."""
        return self.table[feature_rows(docs)].sum(axis=1, dtype=np.float64)


def forward_backward(e: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log Z, marginal of T, expected transitions O-T, T-O and T-T) of padded rows of emissions.

    Forward values are scaled to sum 1 at each token, so Z is the product of
    the scales.  Emissions beyond +-60 count as that.  A row of no tokens has
    log Z 0.
    """
    n, width = e.shape
    ot, to, tt = np.exp(np.clip(trans, -60, 60))
    x = np.ascontiguousarray(np.exp(np.clip(e, -60, 60)).T)
    last = int(length.max(initial=0))
    valid = np.arange(width)[:, None] < length[None, :]
    fo, ft, scale = np.ones((width + 1, n)), np.zeros((width + 1, n)), np.ones((width, n))
    for i in range(last):
        o, t = fo[i] + ft[i] * to, (fo[i] * ot + ft[i] * tt) * x[i]
        c, v = o + t, valid[i]
        fo[i + 1], ft[i + 1] = np.where(v, o / c, fo[i]), np.where(v, t / c, ft[i])
        scale[i] = np.where(v, c, 1.0)
    logz = np.log(scale).sum(0)
    bo, bt = np.ones(n), np.ones(n)
    marginal, pairs = np.zeros((width, n)), np.zeros((3, n))
    for i in range(last - 1, -1, -1):
        v, c = valid[i], scale[i]
        ahead = x[i] * bt / c
        marginal[i] = np.where(v, ft[i + 1] * bt, 0)
        pairs[0] += np.where(v, fo[i] * ot * ahead, 0)
        pairs[1] += np.where(v, ft[i] * to * bo / c, 0)
        pairs[2] += np.where(v, ft[i] * tt * ahead, 0)
        bo, bt = np.where(v, bo / c + ot * ahead, bo), np.where(v, to * bo / c + tt * ahead, bt)
    return logz, marginal.T, pairs.T


class _Corpus:
    """Labelled tweets as index arrays."""

    def __init__(self, docs: Sequence[Tokens], rate: float = 0.2, least: int = 2):
        self.n, self.length = len(docs), np.array([len(d) for d in docs], np.int64)
        rows = feature_rows(docs)
        # texts of up to LONGEST tokens are padded alike, longer ones with those of up to 1, 2, 4, ... times as many
        double = np.ceil(np.log2(np.maximum(self.length, LONGEST) / LONGEST)).astype(np.int64)
        self.parts: list[tuple[np.ndarray, int, int]] = []  # texts, first slot, width
        first, self.slots = np.zeros(self.n, np.int64), 0
        for k in np.unique(double):
            part = np.flatnonzero(double == k)
            width = max(int(self.length[part].max()), 1)
            first[part] = self.slots + np.arange(len(part)) * width
            self.parts.append((part, self.slots, width))
            self.slots += len(part) * width
        starts = np.cumsum(self.length) - self.length
        slot = np.repeat(first - starts, self.length) + np.arange(len(rows))
        text = np.repeat(np.arange(self.n), self.length)
        # a feature counts if several texts have it
        seen = np.bincount(np.unique(rows * self.n + text[:, None]) // max(self.n, 1), minlength=1 << BITS)
        seen[0] = max(least, int(seen[0]))
        self.names = np.flatnonzero(seen >= least)  # table rows, the bias first
        at = np.full(1 << BITS, -1, np.int64)
        at[self.names] = np.arange(len(self.names))
        ids = at[rows]
        some = ids >= 0
        self.ids, self.rows = ids[some], np.broadcast_to(slot[:, None], rows.shape)[some]
        # to begin with, as many tweets are abusive as the reviewers say, by any token alike
        self.prior = np.zeros(len(self.names) + 3)
        self.prior[0] = math.log(max(rate, 1e-3) / max(float(self.length.mean()) if self.n else 1.0, 1.0))

    def chains(self, w: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """log Z of each text, marginals by part, expected transitions of each text."""
        e = np.bincount(self.rows, w[self.ids], self.slots)
        logz, marginals, pairs = np.zeros(self.n), [], np.zeros((3, self.n)).T
        for part, a, width in self.parts:
            logz[part], m, pairs[part] = forward_backward(e[a:a + len(part) * width].reshape(len(part), width), self.length[part], w[-3:])
            marginals.append(m)
        return logz, marginals, pairs

    def loss(self, w: np.ndarray, q: np.ndarray, use: np.ndarray, strength: float) -> tuple[float, np.ndarray]:
        logz, marginals, pairs = self.chains(w)
        logz = np.maximum(logz, 1e-12)
        yes = np.log(-np.expm1(-logz))
        some = use & (self.length > 0)
        value = float(np.sum(np.where(some, -q * yes + (1 - q) * logz, 0)))
        # of -q log(1 - 1/Z) + (1 - q) log Z
        g = np.where(some, (1 - q) - q / np.expm1(np.minimum(logz, 500)), 0)
        grad = np.zeros_like(w)
        grad[:-3] = np.bincount(self.ids, np.concatenate([(m * g[part, None]).ravel() for (part, _, _), m in zip(self.parts, marginals)])[self.rows], len(w) - 3)
        grad[-3:] = (pairs * g[:, None]).sum(0)
        d = w - self.prior
        hold = np.full(len(w), strength)
        hold[0] = strength / 10  # the bias is nearly free
        return value + float(hold @ (d * d)) / 2, grad + hold * d

    def scores(self, w: np.ndarray) -> np.ndarray:
        return -np.expm1(-self.chains(w)[0])

    def fit(self, q: np.ndarray, use: np.ndarray, strength: float, steps: int, start: np.ndarray | None = None) -> np.ndarray:
        """Weights by limited-memory BFGS with backtracking."""
        w = (self.prior if start is None else start).copy()
        f, g = self.loss(w, q, use, strength)
        past: list[tuple[np.ndarray, np.ndarray, float]] = []
        for _ in range(steps):
            d, alphas = -g, []
            for s, y, rho in reversed(past):
                a = rho * (s @ d)
                alphas.append(a)
                d = d - a * y
            if past:
                s, y, _ = past[-1]
                d = d * ((s @ y) / (y @ y))
            else:
                d = d / max(float(np.linalg.norm(d)), 1e-9)
            for (s, y, rho), a in zip(past, reversed(alphas)):
                d = d + (a - rho * (y @ d)) * s
            slope, step = float(g @ d), 1.0
            if slope >= 0:
                break
            while step > 1e-4:
                f2, g2 = self.loss(w + step * d, q, use, strength)
                if f2 <= f + 1e-4 * step * slope:
                    break
                step /= 2
            else:
                break
            s, y = step * d, g2 - g
            if s @ y > 1e-10:
                past = [*past[-7:], (s, y, 1.0 / float(s @ y))]
            w = w + step * d
            done = f - f2 < 1e-5 * max(abs(f), 1)
            f, g = f2, g2
            if done:
                break
        return w


def learnt_odds(docs: Sequence[Tokens], q: np.ndarray, least: int = 2) -> dict[str, float]:
    """How much likelier each word of the texts is in abusive ones, of words without disguise in at least ``least`` texts."""
    bad, all_of = Counter(), Counter()
    for d, p in zip(docs, q):
        for w in {t[0] for t in d if not t[1] and t[0][0] != "<"}:
            bad[w] += float(p)
            all_of[w] += 1
    rate = float(np.mean(q)) if len(q) else 0.0
    return {w: math.log((bad[w] + rate) / (n - bad[w] + 1 - rate)) for w, n in all_of.items() if n >= least}


def fit_field(texts: Sequence[str], verdicts: Sequence[Sequence[tuple[str, int]]], strength: float = STRENGTH, rounds: int = 3, folds: int = 4, steps: int = 20) -> Field:
    """A field from tweets and their reviewers' verdicts; deterministic.

    Without any tweet it knows nothing, and every text scores 0.
    """
    if not texts:
        return Field(np.zeros(1 << BITS, np.float32), np.full(3, -60.0))
    names = sorted({r for v in verdicts for r, _ in v})
    rates = {r: (0.9, 0.95) for r in names}  # P(yes | abusive), P(no | not)
    n = len(texts)
    votes = np.array([sum(y for _, y in v) / max(len(v), 1) for v in verdicts])
    rate = min(max(float(votes.mean()), 0.01), 0.99)
    p = np.full(n, rate)

    def posterior(p: np.ndarray) -> np.ndarray:
        odds = np.log(p / (1 - p))
        for i, v in enumerate(verdicts):
            for r, y in v:
                sens, spec = rates[r]
                odds[i] += math.log(sens / (1 - spec)) if y else math.log((1 - sens) / spec)
        return 1 / (1 + np.exp(-odds))

    shown = [plain(t) for t in texts]
    q = posterior(p)
    odds = learnt_odds([Speller().tokens(t) for t in shown], q)
    speller = Speller(odds)
    c = _Corpus([speller.tokens(t) for t in shown], rate)
    fold = np.arange(n) % folds
    fits: list[np.ndarray | None] = [None] * folds
    for _ in range(rounds):
        fresh = np.empty(n)
        for j in range(folds):
            fits[j] = c.fit(q, fold != j, strength, steps, fits[j])  # a later round starts where the one before ended
            fresh[fold == j] = c.scores(fits[j])[fold == j]
        p = np.clip(fresh, 0.003, 0.997)
        q = posterior(p)
        for r in names:
            s = [(q[i], y) for i, v in enumerate(verdicts) for x, y in v if x == r]
            yes, no = sum(a for a, _ in s), sum(1 - a for a, _ in s)
            # a few imagined verdicts of a good reviewer keep small samples sane
            rates[r] = (min((sum(a * y for a, y in s) + 18) / (yes + 20), 0.99), min((sum((1 - a) * (1 - y) for a, y in s) + 38) / (no + 40), 0.995))
        q = posterior(p)
    w = c.fit(q, np.ones(n, bool), strength, 2 * steps, np.mean(fits, axis=0))
    table = np.zeros(1 << BITS, np.float32)
    table[c.names] = w[:-3]
    return Field(table, w[-3:].copy(), rates, odds)


def _spans(score: float, marginal: np.ndarray, toks, shown: str) -> list[tuple[int, int, str]]:
    """(start, end, words) of runs of tokens likelier T than O.

    Where a text is likely abusive although no single token is, the runs of at
    least half the greatest marginal are given.
    """
    hot = np.flatnonzero(marginal > (min(0.5, float(marginal.max()) / 2) if score >= 0.5 else 0.5))
    if not len(hot):
        return []
    ends = [(toks[run[0]][2], toks[run[-1]][3]) for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)]
    return [(a, b, shown[a:b]) for a, b in ends]


def score_text(f: Field, text: str | None) -> tuple[float, list[tuple[int, int, str]], float]:
    """(P(abusive), spans of plain text with start, end and words, greatest marginal) of one text.

    The whole text is one chain, whatever its length.
    """
    return score_batch(f, [text])[0]


def score_batch(f: Field, texts: Sequence[str | None], most: int = 200_000) -> list[tuple[float, list[tuple[int, int, str]], float]]:
    """:func:`score_text` of many texts, together in array passes of about ``most`` padded tokens."""
    out: list = [(0.0, [], 0.0)] * len(texts)
    speller = f.speller()
    held = []
    for k, t in enumerate(texts):
        if t:
            shown = plain(t)
            toks = speller.tokens(shown)
            if toks:
                held.append((len(toks), k, shown, toks))
    held.sort(key=lambda x: (x[0], x[1]))  # texts of like length share a pass
    at = 0
    while at < len(held):
        upto = at + 1
        while upto < len(held) and held[upto][0] * (upto + 1 - at) <= most:
            upto += 1
        some = held[at:upto]
        at = upto
        length = np.array([x[0] for x in some])
        e = np.zeros((len(some), int(length.max())))
        e[np.arange(e.shape[1]) < length[:, None]] = f.emissions([x[3] for x in some])
        logz, m, _ = forward_backward(e, length, f.trans)
        score, peak = -np.expm1(-logz), m.max(axis=1)
        for r, (n, k, shown, toks) in enumerate(some):
            spans = _spans(float(score[r]), m[r, :n], toks, shown) if score[r] >= 0.5 or peak[r] > 0.5 else []
            out[k] = (float(score[r]), spans, float(peak[r]))
    return out


_FITTED: dict[str, Field] = {}


def fit_from_tables(tweets: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Field:
    """A field from a bounded sample of labelled tweets.

    The ``most`` tweets of smallest hash are used, with all their verdicts; rows
    of ``labels`` with a null tweet, reviewer or verdict, and labels of unknown
    tweets or of tweets without text, are left out.  The field of the last few
    samples is kept, so that queries over one sample fit it once.
    """
    by_tweet = labels.where("tweetid IS NOT NULL AND reviewer IS NOT NULL AND abusive IN (0, 1)").groupBy("tweetid").agg(F.sort_array(F.collect_list(F.struct("reviewer", "abusive"))).alias("verdicts"))
    sample = by_tweet.orderBy(F.xxhash64("tweetid"), "tweetid").limit(most)
    texts = tweets.where("text IS NOT NULL").select("tweetid", "text").join(F.broadcast(sample.select("tweetid")), "tweetid").groupBy("tweetid").agg(F.max("text").alias("text"))
    rows = [(r["text"], [(v["reviewer"], v["abusive"]) for v in r["verdicts"]]) for r in sample.join(texts, "tweetid").orderBy("tweetid").collect()]
    name = hashlib.sha256(repr(rows).encode("utf-8", "replace")).hexdigest()
    if name not in _FITTED:
        while len(_FITTED) >= 4:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[name] = fit_field([t for t, _ in rows], [v for _, v in rows])
    return _FITTED[name]


def score_tweets(tweets: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Every tweet with its score and offending spans.

    Result: ``tweetid``, ``source`` (in lower case, trimmed, inner blanks made
    one; null stays null), ``score``, ``abusive`` (score at least ``least``),
    ``spans`` ARRAY<STRUCT<start, stop, words>> in characters of the decoded
    text, ``peak``.  A tweet crawled several times counts once, by its row
    with a text crawled last.  Null, empty and blank texts score 0.  Rows without
    ``tweetid`` are left out.  The field is fitted when the query is built.
    """
    model = fit_from_tables(tweets, labels)
    held = tweets.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    last = F.max(F.struct(F.col("text").isNotNull(), "crawled_at", "text", "source")).alias("r")
    each = tweets.where("tweetid IS NOT NULL").groupBy("tweetid").agg(last).select("tweetid", "r.text", "r.source")
    each = each.withColumn("source", F.regexp_replace(F.lower(F.trim("source")), r"\s+", " "))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("words", pa.string())]))
        for b in batches:
            got = score_batch(f, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([
                b.column("tweetid"), b.column("source"), pa.array([round(g[0], 6) for g in got], pa.float64()), pa.array([g[0] >= least for g in got]),
                pa.array([[{"start": s, "stop": t, "words": x} for s, t, x in g[1]] for g in got], span), pa.array([round(g[2], 6) for g in got], pa.float64()),
            ], names=["tweetid", "source", "score", "abusive", "spans", "peak"])

    return each.select("tweetid", "source", "text").mapInArrow(scan, "tweetid bigint, source string, score double, abusive boolean, spans array<struct<start: int, stop: int, words: string>>, peak double")


def rates(scored: DataFrame) -> DataFrame:
    """Per ``source``: ``tweets``, ``abusive_tweets``, ``rate`` and ``mean_score``."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("tweets"), F.sum(F.col("abusive").cast("bigint")).alias("abusive_tweets"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
