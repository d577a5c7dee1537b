"""Mixing sources to target shares of tokens.

The documents of a source, in a pseudorandom order, are one stream of tokens cut
into blocks of fixed length.  The mixture is a number of slots of one block
each, spread over output shards; every shard draws its sources' slot counts from
a multinomial of what is still to be given.  A slot finds its block through a
pseudorandom permutation of its source's block numbers, one per pass over the
source, so no block is used once more before every other was used as often.
Slots and blocks then meet in a join on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import tokenizing
from millrace.session import cut_lineage

BLOCK_TOKENS = 256
SHARD_SLOTS = 4_096
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Source:
    """A source's place in the mixture."""

    name: str
    share: float
    repeats: int
    tokens: int  # in its documents
    slots: int  # blocks drawn, repeats counted
    blocks: int

    @property
    def short(self) -> bool:
        return self.slots >= self.blocks * self.repeats


def source_name(c: Column) -> Column:
    """A source's name in lower case, without white space at its ends; blank and null give null."""
    name = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(name != "", name)


def read_targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(name, share, repeats) of each source; rows with a null, a share of 0 or less or no repeats are left out.

    Names are made alike as those of documents are; equal names are added up
    and get the smaller number of repeats.  The list is a parameter, of at most
    ``MOST_SOURCES`` rows.
    """
    rows = targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s IS NOT NULL AND target_share > 0 AND max_repeats > 0").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    out: dict[str, tuple[float, int]] = {}
    for r in rows:
        share, most = out.get(r["s"], (0.0, r["max_repeats"]))
        out[r["s"]] = (share + r["target_share"], min(most, r["max_repeats"]))
    return sorted((k, share, most) for k, (share, most) in out.items())


def allot(targets: list[tuple[str, float, int]], tokens: dict[str, int], block: int, total: int | None = None, least_part: float = 0.25) -> list[Source]:
    """How many blocks each source gives.

    With ``total`` tokens asked for, a source gives its share of them or all it
    may.  Without, the total is the greatest at which every source still
    reaches its share, but at least ``least_part`` of the tokens of all listed
    sources: a source too small even for that gives all it may and stays short,
    and so does one without documents.
    """
    weight = sum(s for _, s, _ in targets) or 1.0
    supply = {k: tokens.get(k, 0) * most for k, _, most in targets}
    if total is None:
        floor = least_part * sum(tokens.get(k, 0) for k, _, _ in targets)
        reach = [supply[k] / (s / weight) for k, s, _ in targets if supply[k] / (s / weight) >= floor > 0]
        total = int(min(reach, default=floor))
    out = []
    for k, s, most in targets:
        n = tokens.get(k, 0)
        blocks = -(-n // block)
        want = total * s / weight
        # in blocks of the source's mean length, as its last one may be short
        slots = min(round(want * blocks / n), blocks * most) if n else 0
        out.append(Source(k, s / weight, most, n, slots, blocks))
    return out


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in a shard, slots of each source in the shards before it).

    The shards are halved until one is left.  Each time the first half's counts
    are a multinomial draw from what is left, the same in every task that makes
    it, and what a source does not have is drawn again from the others; so every
    total is met exactly, and shards differ in size by one at most.
    """
    left, before = slots.astype(np.int64), np.zeros(len(slots), np.int64)
    total, low, high = int(left.sum()), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        n = total * middle // shards - total * low // shards
        draw = rng.multinomial(n, left / left.sum()) if n else np.zeros_like(left)
        while (draw > left).any():
            over = np.maximum(draw - left, 0)
            draw = draw - over
            room = left - draw
            draw = draw + rng.multinomial(int(over.sum()), room / room.sum())
        if shard < middle:
            left, high = draw, middle
        else:
            left, before, low = left - draw, before + draw, middle
    return left, before


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mix of ``x`` and ``key``."""
    z = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permute(x: np.ndarray, n: int, key: np.ndarray | int, rounds: int = 4) -> np.ndarray:
    """The place of each x in a pseudorandom permutation of 0..n-1 chosen by ``key``.

    A Feistel network over the next even number of bits; places beyond n walk on
    until they fall inside.  Needs no table and inverts none, so any slot can be
    placed by itself.
    """
    if n <= 1:
        return np.zeros(len(x), np.int64)
    half = max(((n - 1).bit_length() + 1) // 2, 1)
    low = np.uint64((1 << half) - 1)
    key = np.broadcast_to(np.asarray(key, np.uint64), (len(x),))
    out = x.astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            a, b, k = out[todo] >> np.uint64(half), out[todo] & low, key[todo]
            for r in range(rounds):
                a, b = b, (a ^ _mixed(b + k * np.uint64(0x9E3779B97F4A7C15), r * 0x632BE59BD9B4E019)) & low
            out[todo] = (a << np.uint64(half)) | b
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], names=["source", "block", "at", "tokens"])


class Mixture:
    """The plan of a mixture and the frames that follow from it."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, shards: int | None = None, seed: int = 7, tokenizer: str = tokenizing.DEFAULT, least_part: float = 0.25):
        self.spark, self.block, self.seed, self.tokenizer = documents.sparkSession, block, seed, tokenizer
        self.targets = read_targets(targets)
        names = documents.select(source_name(F.col("source")).alias("source"), "doc_id", "text").where(F.col("source").isin([k for k, _, _ in self.targets]))
        # two hashes name a text; rows repeated exactly are alike and share one
        self.listed = names.select("doc_id", "source", "text", F.xxhash64("doc_id", "source", "text").alias("k1"), F.xxhash64("text", "source", "doc_id").alias("k2"))
        self.counted = cut_lineage(tokenizing.token_counts(self.listed, ["doc_id", "source", "k1", "k2"], tokenizer))
        sums = {r["source"]: r["n"] for r in self.counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row a listed source
        self.sources = allot(self.targets, sums, block, total, least_part)
        self.shards = shards or max(-(-sum(s.slots for s in self.sources) // SHARD_SLOTS), 1)

    def streams(self) -> DataFrame:
        """``doc_id``, ``source``, ``k1``, ``k2``, ``n_tokens``, ``start``: each document's first token in its source's stream.

        The order is by hash.  Buckets of the hash are summed up first, then
        documents within a bucket, so that a source with most documents is no
        single task's.
        """
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 32)
        bits = max((parts - 1).bit_length(), 1)
        spread = self.counted.withColumn("_h", F.xxhash64("doc_id", F.lit(self.seed))).withColumn("_bucket", F.shiftrightunsigned("_h", 64 - bits))
        sums = spread.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_n"))
        before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        inner = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
        local = spread.withColumn("_local", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
        return local.join(offsets, ["source", "_bucket"]).select("doc_id", "source", "k1", "k2", "n_tokens", (F.col("_before") + F.col("_local")).alias("start"))

    def pieces(self) -> DataFrame:
        """What each block holds: ``source``, ``block``, ``doc_id``, ``token_from``, ``token_to`` (in the document)."""
        size = F.lit(self.block)
        s = self.streams().where("n_tokens > 0")
        end = F.col("start") + F.col("n_tokens")
        cut = s.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))))
        return cut.select("source", "block", "doc_id", (F.greatest("start", F.col("block") * size) - F.col("start")).alias("token_from"), (F.least(end, (F.col("block") + 1) * size) - F.col("start")).alias("token_to"))

    def slots(self) -> DataFrame:
        """Every slot of the mixture: ``shard``, ``position``, ``source``, ``block``, ``use_no``.

        ``use_no`` counts from 0 how often the block was used before.  A task
        makes the slots of its shards by arithmetic alone.
        """
        names, blocks, seed = [s.name for s in self.sources], [s.blocks for s in self.sources], self.seed
        given, shards = np.array([s.slots for s in self.sources], np.int64), self.shards
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def make(batches: Iterator[pa.RecordBatch], chunk: int = 100_000) -> Iterator[pa.RecordBatch]:
            for shard in (int(x) for b in batches for x in b.column(0).to_pylist()):
                counts, before = shard_counts(given, shards, shard, seed)
                size, base = int(counts.sum()), 0
                for j, mine in enumerate(counts.tolist()):
                    for a in range(0, mine, chunk):
                        i = np.arange(a, min(a + chunk, mine), dtype=np.int64)
                        g, n = int(before[j]) + i, blocks[j]
                        use = g // n
                        block = permute(g % n, n, (use + np.int64((j + 1) * 1_000_003 + seed * 7_919)).astype(np.uint64))
                        position = permute(base + i, size, shard * 15_485_863 + seed)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), shard, np.int64)), pa.array(position), pa.repeat(pa.scalar(names[j]), len(i)), pa.array(block), pa.array(use)], names=["shard", "position", "source", "block", "use_no"])
                    base += mine

        table = self.spark.range(0, shards if given.sum() else 0, 1, min(parts, shards))
        return table.mapInArrow(make, "shard bigint, position bigint, source string, block bigint, use_no bigint")

    def blocks(self) -> DataFrame:
        """The tokens of every block: ``source``, ``block``, ``tokens``.

        Texts are tokenized where they meet their place in the stream, by their
        hashes; only tokens go on.  A block's pieces, at most as many as it has
        tokens, are put together in order.
        """
        size, tokenizer = self.block, self.tokenizer

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = tokenizing.encoder(tokenizer).encode_ordinary
            for b in batches:
                rows, held = [], 0
                for source, text, start in zip(*(b.column(c).to_pylist() for c in ("source", "text", "start"))):
                    tokens = np.array(encode(text), np.int32)
                    edges = [0, *range(size - start % size, len(tokens), size), len(tokens)]
                    for x, y in zip(edges, edges[1:]):
                        rows.append((source, (start + x) // size, (start + x) % size, tokens[x:y]))
                        held += y - x
                    if held > 500_000:
                        yield _pieces(rows)
                        rows, held = [], 0
                if rows:
                    yield _pieces(rows)

        texts = self.listed.where("text <> ''").groupBy("k1", "k2").agg(F.any_value("text").alias("text"))
        placed = self.streams().where("n_tokens > 0").join(texts, ["k1", "k2"])
        pieces = placed.select("source", "text", "start").mapInArrow(cut, "source string, block bigint, at int, tokens array<int>")
        whole = pieces.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("at", "tokens"))).alias("p"))
        return whole.select("source", "block", F.flatten(F.col("p.tokens")).alias("tokens"))

    def tokens(self) -> DataFrame:
        """The mixture itself, to train on: ``shard``, ``position``, ``source``, ``block``, ``use_no`` and the block's ``tokens``."""
        return self.slots().join(self.blocks().hint("merge"), ["source", "block"]).select("shard", "position", "source", "block", "use_no", "tokens")

    def rows(self) -> DataFrame:
        """Where the mixture's tokens come from: each slot's pieces of documents.

        ``shard``, ``position``, ``source``, ``block``, ``use_no``, ``doc_id``,
        ``token_from``, ``token_to``.
        """
        return self.slots().join(self.pieces().hint("merge"), ["source", "block"]).select("shard", "position", "source", "block", "use_no", "doc_id", "token_from", "token_to")

    def used(self) -> DataFrame:
        """Blocks with how often they are used, joined to their pieces."""
        uses = self.slots().groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))
        return self.pieces().join(uses.hint("merge"), ["source", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))

    def documents(self) -> DataFrame:
        """Every document of a listed source: ``doc_id``, ``source``, ``n_tokens``, ``uses``, ``tokens_used``.

        ``uses`` is how often its most used block comes in the mixture, never
        more than the source's ``max_repeats``; ``tokens_used`` counts its
        tokens with repeats.  A document whose tokens are all left out, or that
        has none, has 0 in both.  Rows of equal ``doc_id`` are one document with
        the tokens of all of them.
        """
        by_doc = self.used().groupBy("doc_id", "source").agg(F.max("uses").alias("uses"), F.sum(F.col("uses") * (F.col("token_to") - F.col("token_from"))).alias("tokens_used"), F.sum(F.col("token_to") - F.col("token_from")).alias("n_tokens"))
        blank = self.counted.where("n_tokens = 0").select("doc_id", "source", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("uses"), F.lit(0).cast("bigint").alias("tokens_used"))
        return by_doc.select("doc_id", "source", "n_tokens", "uses", "tokens_used").unionByName(blank)

    def shares(self) -> DataFrame:
        """Per listed source: ``source``, ``target_share``, ``max_repeats``, ``tokens``, ``tokens_used``, ``share``, ``short``.

        ``tokens_used`` is counted from the slots and blocks themselves;
        ``short`` tells that the source gave all it may.
        """
        plan = self.spark.createDataFrame([(s.name, s.share, s.repeats, s.tokens, s.short) for s in self.sources], "source string, target_share double, max_repeats int, tokens bigint, short boolean")
        got = self.used().groupBy("source").agg(F.sum(F.col("uses") * (F.col("token_to") - F.col("token_from"))).alias("tokens_used"))
        every = plan.join(got, "source", "left").withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0)))
        total = got.agg(F.coalesce(F.sum("tokens_used"), F.lit(0))).scalar()
        return every.select("source", "target_share", "max_repeats", "tokens", "tokens_used", F.when(total > 0, F.col("tokens_used") / total).otherwise(F.lit(0.0)).alias("share"), "short")
