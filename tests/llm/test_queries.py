"""The registered queries of this subpackage on the smallest tables: what must hold of every row."""

from collections import Counter, defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from millrace.llm import mixing, packing, tokenizing

ROOT = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not ROOT.exists(), reason="test tables are not here")


def rows(name):
    return pq.read_table(ROOT / f"{name}.parquet").to_pylist()


def run(spark, name):
    return entry.queries()[name](spark, str(ROOT)).collect()


@pytest.fixture(scope="module")
def tokens():
    encode = tokenizing.encoder().encode_ordinary
    return {r["doc_id"]: encode(r["text"]) if r["text"] else [] for r in rows("documents")}


def test_p4(spark):
    scores = {r.tweetid: r for r in run(spark, "p4_scores")}
    assert set(scores) == {r["tweetid"] for r in rows("q4") if r["tweetid"] is not None}
    assert all(0 <= r.score <= 1 and r.abusive == (r.score >= 0.5) and (bool(r.spans) or not r.abusive) for r in scores.values())
    assert sorted(r.tweetid for r in run(spark, "p4_found")) == sorted(k for k, r in scores.items() if r.abusive)
    want = defaultdict(list)
    for r in scores.values():
        want[r.source].append(r.abusive)
    assert {r.source: (r.tweets, r.abusive_tweets) for r in run(spark, "p4_rates")} == {k: (len(v), sum(v)) for k, v in want.items()}


def test_p6(spark, tokens):
    placed, bins = run(spark, "p6_containers"), defaultdict(list)
    parts = defaultdict(list)
    for r in placed:
        parts[r.doc_id].append((r.part_no, r.n_tokens))
        bins[r.container_id].append((r.slot_no, r.token_start, r.n_tokens))
    for k, t in tokens.items():
        n, cap = len(t), packing.CAPACITY
        assert sorted(parts[k]) == list(enumerate([cap] * (n // cap) + ([n % cap] if n % cap or not n else [])))
    for v in bins.values():
        at = 0
        for slot, (no, start, n) in enumerate(sorted(v)):
            assert no == slot and (n == 0 or start == at)
            at += n
        assert at <= packing.CAPACITY
    assert set(bins) == set(range(len(bins)))
    report, = run(spark, "p6_fill")
    assert (report.containers, report.tokens) == (len(bins), sum(map(len, tokens.values())))
    assert report.program_bound - 1e-6 <= report.containers <= report.program_bound + 2 and report.by_program >= 0.9 * report.containers


def test_p7(spark, tokens):
    by_doc, mixture = run(spark, "p7_documents"), run(spark, "p7_mixture")
    shares = {r.source: r for r in run(spark, "p7_shares")}
    limit = {r["source"].strip().lower(): r["max_repeats"] for r in rows("mix_targets")}
    name = {r["doc_id"]: (r["source"] or "").strip().lower() for r in rows("documents")}
    assert {r.doc_id for r in by_doc} == {k for k, s in name.items() if s in limit}
    assert all(r.uses <= limit[r.source] and r.n_tokens == len(tokens[r.doc_id]) and r.tokens_used <= r.n_tokens * limit[r.source] for r in by_doc)
    used, each = Counter(), Counter()
    for r in mixture:
        used[r.source] += len(r.tokens)
        each[r.source, r.block] += 1
        assert 0 < len(r.tokens) <= mixing.BLOCK_TOKENS
    assert all(n <= limit[s] for (s, _), n in each.items())
    assert all(r.tokens_used == used[s] for s, r in shares.items()) and sum(r.tokens_used for r in by_doc) == sum(used.values())
    reached = sum(r.target_share for r in shares.values() if not r.short)
    for r in shares.values():  # those that had enough keep their proportions
        if not r.short:
            full = sum(x.share for x in shares.values() if not x.short)
            assert abs(r.share / full - r.target_share / reached) < 0.03
    places = [(r.shard, r.position) for r in mixture]
    assert len(places) == len(set(places))


def test_p8(spark, tokens):
    text, got = {r["doc_id"]: (r["text"] or "").encode() for r in rows("documents")}, defaultdict(list)
    for r in run(spark, "p8_pieces"):
        got[r.doc_id].append(r)
    assert set(got) == {k for k, t in tokens.items() if len(t) > 512}
    for k, v in got.items():
        v.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in v] == list(range(len(v))) and v[0].byte_from == 0 and v[-1].byte_to == len(text[k]) and v[-1].token_to == len(tokens[k])
        for r in v:
            assert text[k][r.byte_from:r.byte_to].decode() == r.text and r.token_to - r.token_from <= 512
            assert r.token_from == 0 or r.byte_from == len(tokenizing.encoder().decode_bytes(tokens[k][:r.token_from]))
        for a, b in zip(v, v[1:]):
            assert 64 <= a.token_to - b.token_from <= 68 and a.token_to < b.token_to
