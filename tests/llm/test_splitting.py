import random
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import splitting, tokenizing

encoder = tokenizing.encoder


TEXTS = [
    "One two three. Four five, six seven!\n\nEight nine ten: eleven; twelve (13). It's 3.14 and don't. " * 40,
    "第一句话在这里。第二句话，在那里；完了！" * 120, "no_blanks_at_all._Every_word,_joined_by_a_sign._" * 80, "x" * 6_000, "0x" + "a1b2c3d4" * 500, "👨‍👩‍👧‍👦 family 🏳️‍🌈 flags " * 150,
    "line\r\nends\r\rof\nall  kinds \t here\n \n\n" * 120, " " * 3_000, "é" * 2_500, "mixed. Texte, déjà vu! 漢字かな交じり文。 " * 90, "a b",
    "word \n\n\n then\t\tmore  \u00a0 and\u3000so on\n" * 60, "\U00020000\U00020001字" * 700 + " end", "no\n" * 30 + "\n" * 700 + "x" * 300 + " " * 400 + "y",
]
UNBROKEN = (3, 4, 7, 8, 12, 13)  # runs of more than two halos of 128 bytes without a place to split


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_pauses_are_token_boundaries(k):
    t = TEXTS[k]
    real = {0, len(t)} | {m.start() for m in regex.finditer(tokenizing.PATTERN, t)}
    levels, safe = splitting.pauses(splitting._points(t.encode()))
    assert set(np.flatnonzero(levels >= splitting.IN_WORD).tolist()) <= real
    cuts = np.flatnonzero(safe).tolist()
    parts = [x for i, j in zip(cuts, cuts[1:]) for x in encoder().encode_ordinary(t[i:j])]
    assert parts == encoder().encode_ordinary(t)  # tokenized in parts as in one


def tokens_by_ranges(raw, range_bytes, halo):
    how, out = splitting.Cutting(64, 8, range_bytes, halo), []
    for r in range(how.ranges(len(raw))):
        a, b = how.window(r, len(raw))
        x = splitting.Range(raw[a:b], a, r, len(raw), how)
        out += list(zip(x.offsets[:x.own].tolist(), x.marks[:x.own].tolist()))
    return out


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_ranges_meet_and_tokenize_as_the_whole(k):
    raw, halo = TEXTS[k].encode(), 128
    whole = tokens_by_ranges(raw, 1_000_000, halo)
    for size in (256, 700, 1_024, 5_000):
        assert tokens_by_ranges(raw, size, halo) == whole
    if k not in UNBROKEN:
        lengths = [len(encoder().decode_single_token_bytes(x)) for x in encoder().encode_ordinary(TEXTS[k])]
        assert [a for a, _ in whole] == np.concatenate([[0], np.cumsum(lengths)[:-1]]).tolist()


def test_bytes_that_are_no_text_keep_their_places():
    raw = b"some words \xff\xfe and \x80 more. " * 300
    for size in (256, 1_024):
        assert tokens_by_ranges(raw, size, 64) == tokens_by_ranges(raw, 10**6, 64)


def brute(marks, limit, overlap):
    """Pieces of a whole text's marks, written plainly."""
    s, out, n = 0, [], len(marks) - 1
    while n - s > limit:
        tiers = [[], [], [], [], [], []]
        for k in range(overlap + 1, limit + 1):
            level, begin, half = marks[s + k], marks[s + k - overlap], k > limit // 2
            word, certain = level >= splitting.WORD, level >= splitting.IN_WORD
            clean = certain and begin >= splitting.IN_WORD
            letters = level >= splitting.SPLIT_RUN
            for tier, ok in enumerate((clean and half and word, clean and word, clean and half, certain and begin >= splitting.SPLIT_RUN and half, letters and begin >= splitting.SPLIT_RUN, letters)):
                if ok:
                    tiers[tier].append((level, k))
        k = max(next(t for t in tiers if t), default=(0, limit))[1] if any(tiers) else limit
        out.append((s, s + k))
        back = overlap
        while back < k - 1 and marks[s + k - back] == splitting.NO_PLACE:
            back += 1
        s += max(k - back, 1)
    return [*out, (s, n)] if out else []


@pytest.mark.parametrize("limit, overlap", [(20, 3), (64, 8), (100, 0)])
def test_tables_stitch_to_the_pieces_of_brute_force(limit, overlap):
    for t in TEXTS:
        raw = t.encode()
        one = splitting.Range(raw, 0, 0, len(raw), splitting.Cutting(limit, overlap, 10**6, 128))
        want = brute(one.marks.tolist(), limit, overlap)
        for size in (256, 512, 1_700, 10**6):
            how, got = splitting.Cutting(limit, overlap, size, 128), []
            entry = tokens = number = 0
            for r in range(how.ranges(len(raw))):
                a, b = how.window(r, len(raw))
                x = splitting.Range(raw[a:b], a, r, len(raw), how)
                n, exits, pieces = x.table(r)
                if entry >= 0:
                    mine = list(x.pieces(r, entry, tokens, number))
                    assert len(mine) == pieces[entry]
                    got += mine
                    entry, tokens, number = int(exits[entry]), tokens + n, number + len(mine)
            assert [(p[1], p[2]) for p in got] == want and [p[0] for p in got] == list(range(len(want)))


def pieces_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("piece_no", F.lit(1)).withColumn("size", F.lit(2))
    by = defaultdict(list)
    for r in splitting.split_documents(df, **options).collect():
        by[r.doc_id].append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in by.items()}


@pytest.mark.parametrize("range_bytes", [16_384, 512])
@pytest.mark.parametrize("limit, overlap", [(64, 8), (100, 0)])
def test_pieces(spark, range_bytes, limit, overlap):
    got = pieces_of(spark, list(enumerate(TEXTS)), limit=limit, overlap=overlap, range_bytes=range_bytes, halo=128)
    for k, t in enumerate(TEXTS):
        n = len(encoder().encode_ordinary(t))
        if n <= limit:
            assert k not in got or range_bytes == 512
            continue
        raw, v = t.encode(), got[k]
        assert [p.piece_no for p in v] == list(range(len(v))) and v[0].byte_from == 0 and v[-1].byte_to == len(raw)
        for p in v:
            assert raw[p.byte_from:p.byte_to].decode() == p.text and 0 < p.token_to - p.token_from <= limit
        for a, b in zip(v, v[1:]):
            assert overlap <= a.token_to - b.token_from <= overlap + 4 and b.byte_from <= a.byte_to and b.token_to > a.token_to


def test_natural_places_are_used(spark):
    got = pieces_of(spark, [(1, ("A sentence of some words here. " * 6 + "\n\n") * 12)], limit=64, overlap=8)[1]
    assert {p.pause for p in got[:-1]} <= {"paragraph", "sentence"} and got[-1].pause == "end"
    assert all(len(encoder().encode_ordinary(p.text)) <= 64 for p in got)


def test_pieces_do_not_depend_on_the_ranges(spark):
    cut = lambda v: {k: [tuple(p) for p in x] for k, x in v.items()}
    rows = list(enumerate(TEXTS))
    whole = cut(pieces_of(spark, rows, limit=64, overlap=8, range_bytes=100_000, halo=128))
    assert len(whole) == len(TEXTS) - 1
    for size in (256, 512, 3_000):
        assert cut(pieces_of(spark, rows, limit=64, overlap=8, range_bytes=size, halo=128)) == whole


def test_files_give_the_same_pieces(spark, tmp_path):
    for k, t in enumerate(TEXTS):
        (tmp_path / f"{k}.txt").write_bytes(t.encode())
    (tmp_path / "empty.txt").touch()
    want = pieces_of(spark, list(enumerate(TEXTS)), limit=64, overlap=8, range_bytes=100_000, halo=128)
    for size in (512, 100_000):
        got = defaultdict(list)
        for r in splitting.split_files(spark, str(tmp_path), limit=64, overlap=8, range_bytes=size, halo=128).collect():
            got[int(r.path.rsplit("/", 1)[1][:-4])].append(tuple(r)[1:])
        assert {k: sorted(v) for k, v in got.items()} == {k: [tuple(p)[1:] for p in v] for k, v in want.items()}


def test_a_giant_file_is_never_loaded(tmp_path):
    """A file of 300 MB in ranges: what a worker holds follows the range, not the file."""
    import tracemalloc

    import pyarrow as pa

    path, part = tmp_path / "giant.txt", ("A sentence of some words here. " * 30 + "\n\n").encode()
    with path.open("wb") as f:
        for _ in range(300):
            f.write(part * (1_000_000 // len(part)))
    size, how = path.stat().st_size, splitting.Cutting()
    some = [0, 1, how.ranges(size) // 2, how.ranges(size) - 1]
    rows = pa.RecordBatch.from_pydict({"k1": pa.array([1] * 4, pa.int64()), "k2": pa.array([2] * 4, pa.int64()), "path": [str(path)] * 4, "size": [size] * 4, "range_no": pa.array(some, pa.int32())})
    taken = []

    def read(name, low, high):
        taken.append(high - low)
        return splitting.read_bytes(name, low, high)

    splitting.Range(part, 0, 0, len(part), how)
    tracemalloc.start()
    tables = list(splitting._tables(iter([rows]), how, read))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(taken) <= how.range_bytes + how.before + how.after < size // 100 and peak < size // 5
    assert len(tables) == 4 and all(t.column("tokens")[0].as_py() > 0 for t in tables)


def test_nulls_short_repeated_and_no_rows(spark):
    long = "some words in a row. " * 200
    for size in (16_384, 512):
        got = pieces_of(spark, [(1, None), (2, ""), (3, "short"), (4, long), (4, long), (None, long)], limit=64, overlap=8, range_bytes=size, halo=128)
        assert set(got) == {4, None}
        assert len(got[4]) == 2 * len(got[None]) and sorted(p.text for p in got[4]) == sorted([p.text for p in got[None]] * 2)
    assert splitting.split_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(1)
    t = " ".join(rng.choice(["river", "stone,", "light.", "\n\n", "harbour"]) for _ in range(150_000))
    v = pieces_of(spark, [(1, t)])[1]
    raw = t.encode()
    assert v[0].byte_from == 0 and v[-1].byte_to == len(raw) and all(a.token_to - b.token_from == 64 for a, b in zip(v, v[1:])) and "".join(
        raw[p.byte_from:(v[k + 1].byte_from if k + 1 < len(v) else p.byte_to)].decode() for k, p in enumerate(v)) == t


def test_options_are_checked(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    for bad in ({"overlap": 300}, {"halo": 10}, {"range_bytes": 1_000}):
        with pytest.raises(ValueError):
            splitting.split_documents(df, **bad)
