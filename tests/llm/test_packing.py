import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import packing, tokenizing

encoder = tokenizing.encoder


def held(fillings):
    out = Counter()
    for f, n in fillings:
        for s, c in f:
            out[s] += c * n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_everything_and_fit(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 100, 2048])
    hist = {rng.randint(1, cap): rng.choice([1, 2, 50, 5_000]) for _ in range(rng.choice([1, 5, 300]))}
    made = packing.plan(hist, cap)
    assert held(made) == Counter(hist) and all(sum(s * c for s, c in f) <= cap for f, _ in made)
    count, least = sum(n for _, n in made), -(-sum(s * n for s, n in hist.items()) // cap)
    plain = sum(n for _, n in packing.best_fit(dict(hist), cap))
    assert least <= count <= plain * 1.05 + 1


def test_knapsack_is_the_best_filling():
    import itertools

    import numpy as np

    rng = random.Random(1)
    for _ in range(30):
        sizes, values, limits = [rng.randint(1, 9) for _ in range(4)], [rng.random() for _ in range(4)], [rng.randint(0, 5) for _ in range(4)]
        got = packing.knapsack(np.array(sizes), np.array(values), np.array(limits), 20)
        best = max(sum(v * c for v, c in zip(values, cs)) for cs in itertools.product(*[range(k + 1) for k in limits]) if sum(s * c for s, c in zip(sizes, cs)) <= 20)
        assert abs(sum(values[k] * c for k, c in got.items()) - best) < 1e-9
        assert sum(sizes[k] * c for k, c in got.items()) <= 20 and all(c <= limits[k] for k, c in got.items())


def test_the_program_is_close_to_the_bound_on_many_small_texts():
    rng = random.Random(3)
    hist = Counter(min(int(rng.lognormvariate(5, 1)) + 1, 2048) for _ in range(100_000))
    made, least = packing.plan(hist), -(-sum(s * n for s, n in hist.items()) // 2048)
    assert sum(n for _, n in made) <= least * 1.002
    assert sum(packing.solve(hist, 2048).values()) > 0.5 * least


@pytest.mark.parametrize("hist, optimum", [({900: 1200, 600: 1200, 500: 1200}, 1200), ({1450: 1000, 560: 2000, 700: 500}, None), ({1337: 2614, 475: 1222, 1240: 2495}, None), ({230: 2907, 1201: 1311, 842: 1210, 655: 801, 1388: 3004}, None)])
def test_coarse_histograms_reach_the_optimum(hist, optimum):
    made = packing.plan(hist)
    assert held(made) == Counter(hist) and all(sum(s * c for s, c in f) <= 2048 for f, _ in made)
    program, bound = packing.relax(hist, 2048)
    assert abs(sum(program.values()) - bound) <= 1e-4 * bound + 1
    assert bound - 1e-6 <= sum(n for _, n in made) <= -(-bound // 1) + 1
    assert optimum is None or sum(n for _, n in made) == optimum


def test_every_size_is_priced_before_a_configuration_is_rejected():
    small, great = range(464, 512), range(1123, 1267)
    between = {1000 + k: 20 for k in range(0, 48, 2)}  # two of these fill a container, small and great ones do not
    hist = {**{s: 20 for s in [*small, *great]}, **between}
    program = packing.solve(hist, 2048)
    assert sum(n for config, n in program.items() if any(size in between for size, _ in config)) > 50
    made = packing.plan(hist)
    assert held(made) == Counter(hist) and all(sum(s * c for s, c in f) <= 2048 for f, _ in made)


def test_no_packing_goes_below_the_bound():
    import itertools

    rng = random.Random(2)
    for _ in range(20):
        hist = {s: rng.randint(1, 3) for s in rng.sample(range(2, 12), 3)}
        sizes, most = sorted(hist), tuple(hist[s] for s in sorted(hist))
        fits = [f for f in itertools.product(*[range(12 // s + 1) for s in sizes]) if any(f) and sum(a * b for a, b in zip(f, sizes)) <= 12]
        least = {(0, 0, 0): 0}
        for left in itertools.product(*[range(n + 1) for n in most]):
            if any(left):
                least[left] = 1 + min(least[tuple(max(a - b, 0) for a, b in zip(left, f))] for f in fits if any(a and b for a, b in zip(left, f)))
        assert packing.relax(hist, 12)[1] <= least[most] + 1e-6 <= sum(n for _, n in packing.plan(hist, 12)) + 1e-3


def check(spark, rows, capacity):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("size", F.lit(1)).withColumn("rank", F.lit("x"))
    got = packing.pack_documents(docs, capacity).collect()
    sizes = {i: len(encoder().encode_ordinary(t)) if t else 0 for i, t in rows}
    parts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id].append((r.part_no, r.n_tokens))
        bins[r.container_id].append((r.slot_no, r.token_start, r.n_tokens))
    for i, n in sizes.items():
        want = [capacity] * (n // capacity) + ([n % capacity] if n % capacity or not n else [])
        assert sorted(parts[i]) == list(enumerate(want))
    for v in bins.values():
        at = 0
        for k, (slot, start, n) in enumerate(sorted(v)):
            assert slot == k and (n == 0 or start == at)
            at += n
        assert at <= capacity
    assert set(bins) == set(range(len(bins)))
    return got


def test_documents_have_one_place_each(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", None, "word " * rng.randint(1, 40), "same text here", "x"])) for i in range(300)] + [(1000, "long " * 500), (1001, "tok " * 64)]
    check(spark, rows, 64)
    check(spark, [(i, "a b c") for i in range(50)], 10)  # ties


def test_only_empty_texts_and_no_rows(spark):
    got = check(spark, [(1, ""), (2, None)], 8)
    assert {r.container_id for r in got} == {0}
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    report = packing.fill_report(packing.pack_documents(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string"), 3)).first()
    assert (report.containers, report.tokens, report.least_containers) == (1, 3, 1)


def test_rows_repeated_and_without_id(spark):
    rows = [(1, "a b c")] * 3 + [(None, "a")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()
    places = [(r.container_id, r.slot_no) for r in got]
    assert len(places) == len(set(places)) == 4


@pytest.mark.parametrize("times", [1, 100, 10_000])
def test_the_program_fills_the_containers_and_never_takes_more_than_best_fit(times):
    rng = random.Random(8)
    hist = {s: n * times for s, n in Counter(min(int(rng.lognormvariate(6, 1.2)) + 1, 2048) for _ in range(6_000)).items()}
    made = packing.planned(hist)
    assert held(made.fillings) == Counter(hist) and all(sum(s * c for s, c in f) <= 2048 for f, _ in made.fillings)
    assert made.bound - 1e-6 <= made.containers <= sum(n for _, n in packing.best_fit(dict(hist), 2048))
    assert made.containers <= -(-made.bound // 1) * 1.001 + 1 and made.by_program >= 0.95 * made.containers


def test_the_report_has_the_bound_of_the_program(spark):
    placed, made = packing.pack(spark.createDataFrame([(k, "a b c") for k in range(7)], "doc_id bigint, text string"), 8)
    assert made.bound == 7 * 3 / 6 and made.containers == 4 == packing.fill_report(placed, 8).first().containers
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"))[1].bound == 0
