"""Packing texts into containers of fixed capacity by a configuration linear program.

The lengths of all texts form a histogram of at most ``capacity`` sizes.  A
configuration is a way to fill one container.  The linear program over all
configurations asks for the fewest containers that hold every text, that is, to
cover each size's demand.  It is solved by multiplicative weights: each size has
a price, whose weight falls with the share of its demand that is covered; a
knapsack dynamic program over all sizes finds what a container is worth at most;
configurations worth that much are taken, each in whole containers as far as the
stage's share of the demand goes, and prices are made anew.  Prices also bound
the program from below.  What no such configuration covers is packed best-fit, or,
where lengths are coarse, by the program solved with generated columns.  Only the
histogram and the configurations come to the driver; texts learn their container
by rank within their size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import tokenizing
from millrace.session import cut_lineage

CAPACITY = 2048


Filling = tuple[tuple[int, int], ...]  # (size, how many), by falling size


def knapsack(sizes: np.ndarray, values: np.ndarray, limits: np.ndarray, capacity: int) -> dict[int, int]:
    """{index: copies} worth most in one container: a bounded knapsack by dynamic programming over the capacity.

    A size of up to q copies is split into items of 1, 2, 4, ... copies.
    """
    items: list[tuple[int, int]] = []
    for k in range(len(sizes)):
        left, part = int(min(limits[k], capacity // sizes[k])), 1
        while left > 0:
            c = min(part, left)
            items.append((k, c))
            left, part = left - c, part * 2
    best, choices = np.zeros(capacity + 1), []
    for k, c in items:
        w = int(sizes[k]) * c
        offer = best[:capacity + 1 - w] + values[k] * c
        better = offer > best[w:] + 1e-12
        choices.append(better)
        if better.any():
            best = best.copy()
            best[w:] = np.where(better, offer, best[w:])
    out: dict[int, int] = {}
    room = capacity
    for (k, c), better in zip(reversed(items), reversed(choices)):
        w = int(sizes[k]) * c
        if room >= w and better[room - w]:
            out[k] = out.get(k, 0) + c
            room -= w
    return out


def solve(hist: dict[int, int], capacity: int, stages: int = 2, eta: float = 1.0, lean: float = 0.9, most_exact: int = 200) -> dict[Filling, int]:
    """The configuration program by multiplicative weights: {configuration: containers}, no size beyond its demand.

    A token of size s is priced 1 / capacity, a little more by the size's weight
    exp(-eta * log(sizes) * share covered) and (``lean``) for great sizes, which
    fit in fewer places; all these extras together weigh less than one token of
    a container, so that configurations as full as there can be are worth most.
    Each stage may cover an equal part of what is left of each size.  Within it
    the dynamic program is solved over all sizes still to be had, and a
    configuration through each size is followed along its values; it counts if
    it is worth the most.  If none is found, the best one within the supply is
    looked for exactly, at most ``most_exact`` times.
    """
    sizes = np.array(sorted(k for k, n in hist.items() if k > 0 and n > 0), np.int64)
    if not len(sizes):
        return {}
    demand = np.array([hist[int(k)] for k in sizes], np.int64)
    left, found, most = demand.copy(), {}, widest(sizes, capacity)
    rate, extra, least = eta * np.log(len(sizes) + 1), 0.5 / capacity, most / capacity - 1e-9

    def take(some: np.ndarray, config: dict[int, int], supply: np.ndarray) -> int:
        n = min(int(supply[k]) // c for k, c in config.items())
        for k, c in config.items():
            supply[k] -= c * n
            left[some[k]] -= c * n
        name = tuple(sorted(((int(sizes[some[k]]), c) for k, c in config.items()), reverse=True))
        found[name] = found.get(name, 0) + n
        return n

    for stage in range(stages):
        supply = -(-left // (stages - stage))
        while int(sizes @ supply) >= most:
            some = np.flatnonzero(supply > 0)
            weight = np.exp(-rate * (1 - left[some] / demand[some]))
            weight /= weight.max()
            here, stock = sizes[some], supply[some]
            prices = here / capacity * (1 + extra * (lean * here / capacity + (1 - lean) * weight))
            best, _ = fullest(here, prices, capacity)
            made = 0
            for first in range(len(here) - 1, -1, -1):
                while stock[first] > 0:
                    config, room, rest, worth_so_far = {first: 1}, capacity - int(here[first]), stock.copy(), float(prices[first])
                    rest[first] -= 1
                    while room >= here[0]:
                        upto = int(np.searchsorted(here, room, "right"))
                        worth = np.where(rest[:upto] > 0, best[room - here[:upto]] + prices[:upto], -1.0)
                        k = int(worth.argmax())
                        if worth_so_far + worth[k] < least:
                            break  # no way to fill it from here
                        worth_so_far += float(prices[k])
                        config[k] = config.get(k, 0) + 1
                        rest[k] -= 1
                        room -= int(here[k])
                    if capacity - room < most:
                        break
                    made += take(some, config, stock)
            if not made and most_exact > 0:
                most_exact -= 1
                config = knapsack(here, prices, stock, capacity)
                if sum(int(here[k]) * c for k, c in config.items()) >= most:
                    made = take(some, config, stock)
            supply[some] = stock
            if not made:
                break
    return found


def widest(sizes: np.ndarray, capacity: int) -> int:
    """How many tokens a container can hold at most, by any number of each size."""
    held = np.zeros(capacity + 1, bool)
    held[0] = True
    for w in range(int(sizes[0]), capacity + 1):
        held[w] = held[w - sizes[:np.searchsorted(sizes, w, "right")]].any()
    return int(np.flatnonzero(held)[-1])


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: equal containers are one group, so work follows sizes, not texts."""
    groups: list[tuple[int, int, dict[int, int]]] = []  # room, containers, contents
    for size in sorted((k for k in hist if k > 0), reverse=True):
        n = hist[size]
        while n > 0:
            fits = [g for g in range(len(groups)) if groups[g][0] >= size]
            if not fits:
                each = capacity // size
                whole, rest = divmod(n, each)
                if whole:
                    groups.append((capacity - each * size, whole, {size: each}))
                if rest:
                    groups.append((capacity - rest * size, 1, {size: rest}))
                break
            g = min(fits, key=lambda i: groups[i][0])
            room, count, held = groups[g]
            each = room // size
            if n >= count:  # as many as fill these containers evenly
                each = min(each, n // count)
                groups[g] = (room - each * size, count, {**held, size: held.get(size, 0) + each})
                n -= each * count
            else:
                groups[g] = (room, count - n, held)
                groups.append((room - size, n, {**held, size: held.get(size, 0) + 1}))
                n = 0
    return [(tuple(sorted(h.items(), reverse=True)), c) for _, c, h in groups]


def fullest(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the capacity what can be held at most at these prices, and the index of a size to take there, -1 for none.

    ``sizes`` ascend.  Every size is looked at, any number of times.
    """
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for w in range(int(sizes[0]), capacity + 1):
        offers = best[w - sizes[:upto[w]]] + prices[:upto[w]]
        k = int(offers.argmax())
        best[w], taken[w] = max((offers[k], k), (best[w - 1], -1))
    return best, taken


WORK = 4e10  # pivots times the square of the sizes: less than half a minute


def relax(hist: dict[int, int], capacity: int, known: Sequence[Filling] = (), enough: float = 0.0, gap: float = 1e-4, batch: int = 32) -> tuple[dict[Filling, float], float]:
    """The configuration program by generated columns: ({configuration: containers}, a bound no packing goes below).

    Simplex over the configurations found so far, ``known`` ones first, gives a
    price to each size; configurations worth most at these prices, or at
    prices drawn towards the best so far, enter.  The prices' total over the
    worth of the best configuration is a bound (Farley's).  A configuration is
    judged by its worth alone, not by how full it is.  The search ends when the
    bound reaches ``enough`` or shows that no better whole number is left, or
    at most ``gap`` of all containers; or after ``WORK``, and then bound and
    program are as far apart as they are.
    """
    sizes = np.array(sorted(k for k, n in hist.items() if k > 0 and n > 0), np.int64)
    if not len(sizes):
        return {}, 0.0
    demand = np.array([hist[int(k)] for k in sizes], float)
    m = len(sizes)
    each = capacity // sizes
    columns: list[dict[int, int]] = [{k: int(each[k])} for k in range(m)]  # {-1: k}: more of size k than there is
    inverse, x, cost = np.diag(1.0 / each), demand / each, np.ones(m)
    prices, bound, pivots = 1.0 / each, float(sizes @ demand) / capacity, 0
    center, pull = sizes / capacity, 0.8  # prices of the best bound, and how far towards them
    most = max(int(WORK / m**2), 100)
    at = {int(size): k for k, size in enumerate(sizes)}
    pool = [{at[size]: c for size, c in config} for config in known]
    wide = max((len(c) for c in pool), default=0)
    held, copies = (np.array([[*of(c), *[0] * (wide - len(c))] for c in pool], np.int64).reshape(len(pool), wide) for of in (dict.keys, dict.values))

    def enter(column: dict[int, int], value: float, real: bool) -> bool:
        nonlocal inverse, x, prices, pivots
        u = sum(inverse[:, k] * c for k, c in column.items())
        ok = np.flatnonzero(u > 1e-9)
        if not len(ok):
            return False
        ratios = x[ok] / u[ok]
        near = ok[ratios <= ratios.min() + 1e-9]
        r = int(near[u[near].argmax()])
        step = max(x[r] / u[r], 0.0)
        x = np.maximum(x - step * u, 0.0)
        x[r] = step
        row = inverse[r] / u[r]
        some = np.flatnonzero(np.abs(u) > 1e-13)
        inverse[some] -= np.outer(u[some], row)
        inverse[r] = row
        prices = prices + value * row
        columns[r], cost[r] = (column if real else {-1: next(iter(column))}), float(real)
        pivots += 1
        if pivots % 500 == 0:  # against errors that add up
            basis = np.zeros((m, m))
            for j, column_held in enumerate(columns):
                for k, c in column_held.items():
                    basis[c if k < 0 else k, j] = -1 if k < 0 else c
            inverse = np.linalg.inv(basis)
            x, prices = np.maximum(inverse @ demand, 0.0), cost @ inverse
        return True

    while True:
        if prices.min() < -1e-9:
            k = int(prices.argmin())
            if not enter({k: -1}, float(prices[k]), False):
                break
            continue
        total = float(cost @ x)
        if pivots > most or total - bound <= gap * total or np.ceil(bound - 1e-6) >= np.ceil(total - 1e-6) or bound >= enough > 0:
            break
        if len(pool):
            worth = (prices[held] * copies).sum(axis=1)
            k = int(worth.argmax())
            if worth[k] > 1 + 1e-6 and enter(pool[k], 1 - float(worth[k]), True):
                continue
        drawn = pull * center + (1 - pull) * np.maximum(prices, 0.0)
        best, taken = fullest(sizes, drawn, capacity)
        if (reached := float(drawn @ demand) / max(best[capacity], 1e-12)) > bound:
            bound, center = reached, drawn / best[capacity]
        through = best[capacity - sizes] + drawn  # the best configuration that holds a size
        entered = 0
        for first in np.argsort(-through, kind="stable")[:batch]:
            column, w = {int(first): 1}, capacity - int(sizes[first])
            while w > 0:
                if taken[w] >= 0:
                    column[int(taken[w])] = column.get(int(taken[w]), 0) + 1
                    w -= int(sizes[taken[w]])
                else:
                    w -= 1
            value = 1 - sum(prices[k] * c for k, c in column.items())
            entered += value < -1e-9 and enter(column, value, True)
        if entered:
            pull = 0.8
        elif pull == 0:
            break
        else:
            pull = pull - 0.4 if pull > 0.4 else 0.0  # nothing at these prices: nearer the program's own
    found: dict[Filling, float] = {}
    for column, n in zip(columns, x):
        if -1 not in column and n > 1e-9:
            config = tuple(sorted(((int(sizes[k]), c) for k, c in column.items()), reverse=True))
            found[config] = found.get(config, 0.0) + float(n)
    return found, bound


def rounded(program: dict[Filling, float], hist: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """The program in whole containers that hold the histogram exactly.

    It is rounded down, and the rest is packed best-fit, at once or after one
    more container of each configuration with a great part left over.
    """
    rest, whole, parts = dict(hist), [], []
    for config, x in sorted(program.items()):
        n = min(int(x + 1e-6), *(rest[size] // c for size, c in config))
        if n > 0:
            whole.append((config, n))
            for size, c in config:
                rest[size] -= c * n
        parts.append((x - n, config))
    made = best_fit(rest, capacity)
    more = []
    for _, config in sorted(parts, reverse=True):
        if all(rest[size] >= c for size, c in config):
            more.append((config, 1))
            for size, c in config:
                rest[size] -= c
    other = more + best_fit(rest, capacity)
    return whole + min(made, other, key=lambda fillings: sum(n for _, n in fillings))


@dataclass(frozen=True)
class Plan:
    """Fillings and how many containers have each, a bound no packing goes below, and the containers the program made."""

    fillings: list[tuple[Filling, int]]
    bound: float
    by_program: int

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.fillings)


def planned(hist: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan of a histogram, which its fillings hold exactly.

    The program by multiplicative weights comes first, with what it leaves
    packed best-fit, and plain best-fit where that takes fewer containers.  With
    every token at the same price no container is worth more than the most
    tokens one can hold, which bounds the program from below.  If the count is
    more than a thousandth, and more than one container, over that bound, the
    program is solved by generated columns, and the fewer containers count.
    """
    hist = {k: n for k, n in hist.items() if k > 0 and n > 0}
    if not hist:
        return Plan([], 0.0, 0)
    program = solve(hist, capacity)
    rest = dict(hist)
    for config, n in program.items():
        for size, c in config:
            rest[size] -= c * n
    bound = sum(s * n for s, n in hist.items()) / widest(np.array(sorted(hist), np.int64), capacity)
    plans = [Plan([*sorted(program.items()), *best_fit(rest, capacity)], bound, sum(program.values())), Plan(best_fit(hist, capacity), bound, 0)]
    made = min(plans, key=lambda p: p.containers)
    slack = max(1, int(bound) // 1000)
    if made.containers - np.ceil(bound - 1e-6) > slack:
        columns, better = relax(hist, capacity, [config for config, _ in made.fillings], made.containers - slack)
        bound, other = max(bound, better), rounded(columns, hist, capacity)
        if sum(n for _, n in other) < made.containers:
            made = Plan(other, bound, sum(min(int(x + 1e-6), *(hist[s] // c for s, c in config)) for config, x in columns.items()))
    return Plan(made.fillings, bound, made.by_program)


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """The fillings of :func:`planned`."""
    return planned(hist, capacity).fillings


class Places:
    """Where the item of a given size and rank goes."""

    def __init__(self, fillings: list[tuple[Filling, int]]):
        first, rows, used, start, self.slots, self.fill = 0, [], {}, [], [], []
        for config, n in fillings:
            slot = offset = 0
            for size, c in config:
                a = used.get(size, 0)
                rows.append((size, a, first, c, slot, offset))
                used[size] = a + n * c
                slot, offset = slot + c, offset + size * c
            start.append(first)
            self.slots.append(slot)
            self.fill.append(offset)
            first += n
        rows.sort()
        self.containers = first
        self.start, self.slots, self.fill = (np.array(x, np.int64) for x in (start, self.slots, self.fill))
        self.size, self.rank, self.first, self.each, self.slot, self.offset = (np.array([r[i] for r in rows], np.int64) for i in range(6))
        self.at = {s: (int(np.searchsorted(self.size, s)), int(np.searchsorted(self.size, s, "right"))) for s in used}

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(container, slot, first token) of items; those without tokens go round all containers, behind the rest."""
        container, slot, start = (np.zeros(len(size), np.int64) for _ in range(3))
        for s in np.unique(size):
            m = size == s
            r = rank[m]
            if s == 0:
                total = max(self.containers, 1)
                c = r % total
                container[m] = c
                if self.containers:
                    run = np.searchsorted(self.start, c, "right") - 1
                    slot[m], start[m] = self.slots[run] + r // total, self.fill[run]
                else:
                    slot[m] = r
                continue
            a, b = self.at[int(s)]
            k = a + np.searchsorted(self.rank[a:b], r, "right") - 1
            d = r - self.rank[k]
            container[m], slot[m] = self.first[k] + d // self.each[k], self.slot[k] + d % self.each[k]
            start[m] = self.offset[k] + d % self.each[k] * s
        return container, slot, start


def ranked(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``items`` with ``rank`` from 0 within equal ``size``, whatever share of the items has that size.

    Items are spread over buckets by hash; buckets are counted, the counts
    summed up in order, and items ranked within (size, bucket).
    """
    buckets = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), 32)
    spread = items.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("size", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("size", "_bucket").orderBy(*keys)
    local = spread.withColumn("_local", F.row_number().over(inner) - 1)
    return local.join(offsets, ["size", "_bucket"]).withColumn("rank", F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_before")


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = tokenizing.DEFAULT) -> tuple[DataFrame, Plan]:
    """:func:`pack_documents` and the plan behind it."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    counted = cut_lineage(tokenizing.token_counts(documents, ["doc_id"], tokenizer))
    cap = F.lit(capacity)
    parts = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / cap) - 1, F.lit(0)).cast("int"))).alias("part_no"))
    items = parts.select("doc_id", "part_no", F.least(F.col("n_tokens") - F.col("part_no") * cap, cap).cast("int").alias("size"))
    hist = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    made = planned(hist, capacity)
    held = documents.sparkSession.sparkContext.broadcast(Places(made.fillings))  # bounded by the stages of the program and the capacity

    def place(batches):
        import pyarrow as pa

        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "rank"))
            container, slot, start = held.value.of(size, rank)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part_no"), pa.array(size), pa.array(container), pa.array(slot), pa.array(start)], names=["doc_id", "part_no", "n_tokens", "container_id", "slot_no", "token_start"])

    placed = ranked(items, ["doc_id", "part_no"]).select("doc_id", "part_no", "size", "rank").mapInArrow(place, "doc_id bigint, part_no int, n_tokens bigint, container_id bigint, slot_no bigint, token_start bigint")
    return placed, made


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = tokenizing.DEFAULT) -> DataFrame:
    """Every document's container and position.

    ``documents`` has ``doc_id`` and ``text``; other columns are ignored.
    Result: ``doc_id``, ``part_no``, ``n_tokens``, ``container_id``, ``slot_no``
    and ``token_start`` (the place of its first token in the container).  A text
    is whole (``part_no`` 0) unless it has more than ``capacity`` tokens: then
    it is cut into parts of ``capacity`` tokens and a rest.  Texts that are
    null or empty take no room and are shared out over all containers.  Each row
    is a document, rows repeated exactly too; a row with a null ``doc_id`` is
    placed like any other.  No rows give no containers.

    Texts are tokenized once; the counts are kept in the checkpoint folder
    because both the histogram and the placing need them.
    """
    return pack(documents, capacity, tokenizer)[0]


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``containers``, ``tokens``, ``least_containers`` (tokens over capacity, rounded up), ``fill``."""
    each = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    total = F.coalesce(F.sum("used"), F.lit(0))
    return each.agg(F.count(F.lit(1)).alias("containers"), total.alias("tokens"), F.ceil(total / F.lit(capacity)).alias("least_containers"), F.when(F.count(F.lit(1)) > 0, total / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"))
