"""Every query with SQL against DuckDB on the smallest tables, where they are at hand."""

import math
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not ROOT.exists(), reason="test tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in ROOT.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_each_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(ROOT))
    cols = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*cols).collect()), key=str)
    picked = ", ".join(f'"{c}"' for c in cols)
    want = sorted(([plain(v) for v in r] for r in duck.sql(f"SELECT {picked} FROM ({entry.oracle_sql()[name]}) z").fetchall()), key=str)
    assert got == want


def rows(name, *columns):
    """A test table's rows as Python values."""
    import pyarrow.parquet as pq

    return pq.read_table(ROOT / f"{name}.parquet", columns=list(columns) or None).to_pylist()


def test_replay_and_stream_match_a_plain_walk_over_the_log(spark):
    known = ("DRIVER_LOCATION", "LEAVING_BLOCK", "ENTERING_BLOCK", "RIDE_REQUEST", "RIDE_COMPLETE")
    free, want = {}, []
    for m in sorted(rows("driver_messages"), key=lambda m: m["arrival_id"]):
        kind, who, block = m["msg_type"], m["driver_id"], m["block_id"]
        if kind not in known or block is None:
            continue
        pool = free.setdefault(block, {})
        if kind == "RIDE_REQUEST":
            at = m["latitude"], m["longitude"]
            if m["client_id"] is None or None in at:
                continue
            ranked = []
            for w, d in pool.items():
                if d["status"] == "AVAILABLE" and None not in d.values():
                    fits = m["gender_preference"] in ("N", d["gender"])
                    ranked.append((d["salary"] >= 100, -(0.4 * math.exp(-math.hypot(d["latitude"] - at[0], d["longitude"] - at[1])) + 0.1 * fits + 0.3 * d["rating"] / 5 + 0.2 * (1 - d["salary"] / 100)), w))
            if ranked:
                best = min(ranked)[2]
                del pool[best]
                want.append((block, m["arrival_id"], best, m["client_id"]))
        elif who is None:
            continue
        elif kind == "ENTERING_BLOCK":
            d = {c: m[c] for c in ("latitude", "longitude", "rating", "salary", "gender", "status")}
            if None not in d.values():
                pool[who] = d
        elif kind == "LEAVING_BLOCK":
            pool.pop(who, None)
        elif who in pool and kind == "DRIVER_LOCATION":
            pool[who] |= {c: m[c] for c in ("latitude", "longitude")}
        elif who in pool and None not in (m["rating"], m["user_rating"], m["salary"]):
            pool[who] |= {"status": "AVAILABLE", "salary": m["salary"] + 1, "rating": (m["rating"] + m["user_rating"]) / 2, **{c: m[c] for c in ("latitude", "longitude", "gender")}}
    assert len(want) > 20
    for name in ("dispatch_replay", "stream_matches"):
        got = entry.queries()[name](spark, str(ROOT)).select("block_id", "arrival_id", "driver_id", "client_id").collect()
        assert sorted(map(tuple, got)) == sorted(want), name


def test_wiki_runs_are_those_of_a_plain_count(spark):
    import html
    from collections import Counter

    want = Counter()
    for r in rows("documents", "text"):
        for line in re.split(r"\r\n|\r|\n", r["text"] or ""):
            t = html.unescape(line.lower())
            t = re.sub(r"(https?|ftp|file)://[-a-zA-Z0-9+&@#/%?=~_|!:,.;]*[-a-zA-Z0-9+&@#/%=~_|]", " ", t)
            t = re.sub("</?ref(.*?)>", " ", t)
            t = re.sub("'+(?=[^a-zA-Z])|(?<=[^a-zA-Z])'+", " ", t)
            w = re.sub("[^a-zA-Z']", " ", t).split()
            want.update(" ".join(w[i:i + n]) for n in range(1, 6) for i in range(len(w) - n + 1))
    got = {r.phrase: r.n for r in entry.queries()["ngram_count_wiki"](spark, str(ROOT)).collect()}
    assert got == {k: n for k, n in want.items() if n > 2} and len(got) > 100


def test_codes_read_back_as_names(spark):
    from millrace.functions import qr

    names = {r["c_custkey"]: r["c_name"] for r in rows("customer", "c_custkey", "c_name")}
    got = {r.c_custkey: r.code for r in entry.queries()["qr_codes"](spark, str(ROOT)).collect()}
    assert set(got) == set(names)
    assert all(got[k] == qr.encode(n) for k, n in names.items()) and len(set(got.values())) == len(set(names.values()))


def test_each_query_without_sql_has_a_test_of_its_rows():
    """Those of the training-data operators are in tests/llm."""
    left = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not re.match(r"p\d", n)}
    assert left == {"dispatch_replay", "stream_matches", "ngram_count_wiki", "qr_codes"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["total", "title", "daily"]
