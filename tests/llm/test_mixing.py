import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

DOC = "doc_id bigint, source string, text string"
TARGET = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations_are_permutations(n):
    for key in (0, 1, 99):
        assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))
    if n > 100:
        assert mixing.permute(np.arange(n), n, 1).tolist() != mixing.permute(np.arange(n), n, 2).tolist()


@pytest.mark.parametrize("shards", [1, 16, 37])
def test_draws_meet_every_total(shards):
    slots = np.array([1000, 3, 0, 250])
    each = [mixing.shard_counts(slots, shards, k, 5) for k in range(shards)]
    got = np.array([c for c, _ in each])
    assert got.sum(0).tolist() == [1000, 3, 0, 250] and got.sum(1).max() - got.sum(1).min() <= 1 and (got >= 0).all()
    assert all((before == got[:k].sum(0)).all() for k, (_, before) in enumerate(each))
    assert shards == 1 or got[:, 0].std() > 0


def test_allotment():
    t = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)]
    by = {s.name: s for s in mixing.allot(t, {"a": 10_000, "b": 3_000, "c": 5_000}, 10)}
    assert abs(by["a"].slots / sum(s.slots for s in by.values()) - 0.5) < 0.01 and by["a"].slots == 1000
    tiny = {s.name: s for s in mixing.allot(t, {"a": 10_000, "b": 10}, 10)}
    assert tiny["b"].slots == 2 and tiny["b"].short and tiny["c"].slots == 0 and tiny["a"].slots == 1000
    asked = {s.name: s for s in mixing.allot(t, {"a": 10_000, "b": 100, "c": 5_000}, 10, total=1_000)}
    assert (asked["a"].slots, asked["b"].slots, asked["c"].slots) == (50, 20, 20)
    assert all(s.slots == 0 for s in mixing.allot(t, {}, 10))


def frames(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["Big", " big", "small", "other", None]), "word " * rng.randint(0, 60)) for i in range(300)] + [(900, "big", "long " * 2_000), (901, "big", None), (902, "big", "")]
    return spark.createDataFrame(docs, DOC).withColumn("start", F.lit(1)).withColumn("block", F.lit(2)), spark.createDataFrame([("big", 0.6, 1), ("Small ", 0.4, 3), ("none", 0.1, 2), (None, 0.2, 1), ("zero", 0.0, 1)], TARGET)


def test_mixture(spark):
    docs, targets = frames(spark)
    m = mixing.Mixture(docs, targets, block=16, shards=5)
    rows, by_doc, shares = m.rows().collect(), {r.doc_id: r for r in m.documents().collect()}, {r.source: r for r in m.shares().collect()}
    listed = {r.doc_id: r.s for r in docs.select("doc_id", mixing.source_name(F.col("source")).alias("s")).collect() if r.s in ("big", "small")}
    assert set(by_doc) == set(listed)
    used, blocks = Counter(), Counter()
    for r in rows:
        used[r.doc_id] += r.token_to - r.token_from
    for s, b, _, _ in {(r.source, r.block, r.shard, r.position) for r in rows}:
        blocks[s, b] += 1
    assert all(by_doc[i].tokens_used == used[i] for i in by_doc)
    assert all(n <= {"big": 1, "small": 3}[s] for (s, _), n in blocks.items())
    assert all(by_doc[i].uses <= {"big": 1, "small": 3}[listed[i]] for i in by_doc)
    # each block of a source is used as often as any other, or once more
    for s in ("big", "small"):
        n = [blocks[s, b] for b in range(next(x.blocks for x in m.sources if x.name == s))]
        assert max(n) - min(n) <= 1
    assert abs(sum(r.share for r in shares.values()) - 1) < 1e-9 and shares["none"].tokens_used == 0 and shares["none"].short
    assert abs(shares["big"].share - 0.6) < 0.03 and sum(used.values()) == sum(r.tokens_used for r in shares.values())
    places = [(r.shard, r.position) for r in m.slots().collect()]
    assert len(places) == len(set(places)) == sum(s.slots for s in m.sources)


def test_each_token_is_in_one_block(spark):
    docs, targets = frames(spark)
    m = mixing.Mixture(docs, targets, block=16, shards=5)
    size = Counter()
    for r in m.pieces().collect():
        assert 0 <= r.token_from < r.token_to
        size[r.source, r.block] += r.token_to - r.token_from
    for s in m.sources:
        got = [size[s.name, b] for b in range(s.blocks)]
        assert all(n == 16 for n in got[:-1]) and sum(got) == s.tokens


def test_empty_tables(spark):
    docs, targets = frames(spark)
    for m in (mixing.Mixture(docs.limit(0), targets), mixing.Mixture(docs, targets.limit(0))):
        assert m.rows().count() == m.documents().count() == 0
    assert mixing.Mixture(docs.limit(0), targets).shares().count() == 3


def test_blocks_hold_the_tokens_of_their_documents(spark):
    docs, targets = frames(spark)
    docs = docs.unionByName(docs.where("doc_id = 900")).unionByName(docs.where("doc_id < 3"))  # rows repeated exactly
    m = mixing.Mixture(docs, targets, block=16)
    encode = mixing.tokenizing.encoder().encode_ordinary
    texts = {r.doc_id: encode(r.text) for r in docs.where("text is not null").select("doc_id", "text").collect()}
    want = Counter()
    for r in m.pieces().collect():
        want.update((r.source, r.block, t) for t in texts[r.doc_id][r.token_from:r.token_to])
    blocks = {(r.source, r.block): r.tokens for r in m.blocks().collect()}
    assert Counter((s, b, t) for (s, b), ts in blocks.items() for t in ts) == want
    rows = m.tokens().collect()
    assert len(rows) == sum(s.slots for s in m.sources) and all(r.tokens == blocks[r.source, r.block] for r in rows)
    assert sum(len(r.tokens) for r in rows) == sum(r.tokens_used for r in m.shares().collect())


def test_blocks_keep_the_order_of_their_tokens(spark):
    docs = spark.createDataFrame([(k, "big", " ".join(f"{k} {i}" for i in range(40))) for k in range(20)], DOC)
    m = mixing.Mixture(docs, spark.createDataFrame([("big", 1.0, 1)], TARGET), block=16)
    stream = sum((list(r.tokens) for r in m.blocks().orderBy("block").collect()), [])
    want = sum((mixing.tokenizing.encoder().encode_ordinary(r.text) for r in m.streams().join(docs.select("doc_id", "text"), "doc_id").orderBy("start").collect()), [])
    assert stream == want
