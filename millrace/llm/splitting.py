"""Cutting long texts into overlapping pieces at natural boundaries, by byte ranges.

A text is read as ranges of bytes with halos.  A worker detects the boundaries of
its range: the tokens that begin in it, and a few beyond, each with a byte for how
well the text pauses before it.  Where pieces end depends on where they begin, so
a range is summed up by a boundary table: for every token at which a first piece
may begin in it, how many pieces begin in the range and where the first one of the
next range does.  The tables of a text are stitched in order, a row a range, with
prefix sums of tokens and pieces; then every range emits the pieces that begin in
it, by offset.  Files are read by seeking, in both passes; a cell of a table is cut
into ranges where it is read.  A task holds a range with its halos, and never more
of a text than it was handed as one value.

Tokens do not depend on the ranges.  A text may be tokenized in parts wherever its
pattern splits whatever stands around; an unbroken run without such a place is cut
at multiples of ``halo`` bytes that have none for a halo on either side.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokenizing
from millrace.session import spread

LIMIT = 512
OVERLAP = 64
RANGE_BYTES = 131_072
HALO_BYTES = 2_048
NEAR_BLANKS = 64  # characters of a run of white space, from either end, in which line ends count

#: How well a text pauses at a place: inside a character, inside a word's token run, inside a word, between words, and so on.
NO_PLACE, SPLIT_RUN, IN_WORD, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(8)
PAUSES = ("none", "character", "token", "word", "clause", "sentence", "line", "paragraph")

BLANK, SPACE, LETTER, NUMBER, OTHER = range(5)  # SPACE is ' ', BLANK any other white space
_WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
STOPS, COMMAS, CLOSERS = ".!?…。！？", ",;:，、；：", "\"'”’)]»"


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and marks of punctuation of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    cls = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    cls[_WHITE], cls[32] = BLANK, SPACE
    mark = np.zeros(0x110000, np.uint8)  # 1 stop, 2 comma, 4 closer, 8 newline, 16 a pause without a blank behind it
    for chars, bit in ((STOPS, 1), (COMMAS, 2), (CLOSERS, 4), ("\n\r\x85  ", 8), ("。！？，、；：", 16)):
        for c in chars:
            mark[ord(c)] |= bit
    return cls, mark


codecs.register_error("a-character-a-byte", lambda e: ("\x1a" * (e.end - e.start), e.end))


def _points(data: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes; a byte that is no UTF-8 counts as one control character, so that offsets hold."""
    return np.frombuffer(data.decode("utf-8", "a-character-a-byte").encode("utf-32-le"), np.uint32)


def pauses(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How well the text pauses before each code point and at its end, and where it may be tokenized in parts.

    Values from ``IN_WORD`` on are given only where the tokenizer's pattern
    splits whatever stands around; ``SPLIT_RUN`` elsewhere.  Of these places,
    those behind white space are left out of the second result: white space at
    a text's very end is matched otherwise than before a word.
    """
    n = len(points)
    out, safe = np.full(n + 1, SPLIT_RUN, np.uint8), np.ones(n + 1, bool)
    out[0] = out[n] = PARAGRAPH
    if n < 2:
        return out, safe
    cls_of, mark_of = _classes()
    cls, mark = cls_of[points], mark_of[points]
    white = cls <= SPACE
    p, c, wp, wc = cls[:-1], cls[1:], white[:-1], white[1:]
    sure = np.where(wp, ~wc & (p == BLANK), wc | ((p != c) & ~((points[:-1] == 39) & (c == LETTER))))
    # after a stop and its closing quote
    stop = (mark & 1) > 0
    stop[1:] |= ((mark[1:] & 4) > 0) & stop[:-1]
    comma = (mark & 2) > 0
    level = np.where(wp | wc, WORD, IN_WORD).astype(np.uint8)
    ends = wc | ((mark[:-1] & 16) > 0)
    level[ends & comma[:-1]] = CLAUSE
    level[ends & stop[:-1]] = SENTENCE
    # texts with a sign for blanks: the run of signs tells, as "._" before a letter
    under = (points == 95)
    word = under[:-1] & ~wc
    level[word] = WORD
    before = np.zeros(n - 1, bool)
    before[1:] = under[1:-1]
    level[1:][word[1:] & comma[:-2]] = CLAUSE
    level[1:][word[1:] & stop[:-2]] = SENTENCE
    # line ends anywhere in the white space on either side
    newline = np.cumsum((mark & 8) > 0) - np.cumsum((points == 10) & (np.concatenate([[0], points[:-1]]) == 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], white.view(np.int8), [0]])))
    for side in (0, 1):  # the place before a white run, and the one behind it
        a, b = edge[0::2], edge[1::2]
        first, last = (a, np.minimum(b, a + NEAR_BLANKS)) if side == 0 else (np.maximum(a, b - NEAR_BLANKS), b)
        lines = newline[last - 1] - np.where(first > 0, newline[np.maximum(first - 1, 0)], 0)
        at = (a if side == 0 else b) - 1
        ok = (at >= 0) & (at < n - 1)
        at, k = at[ok], lines[ok]
        level[at[k == 1]] = LINE
        level[at[k >= 2]] = PARAGRAPH
    out[1:n] = np.where(sure, level, SPLIT_RUN)
    safe[1:n] = sure & ~wp
    return out, safe


_LENGTHS: dict[int, np.ndarray] = {}


def _lengths(encoding) -> np.ndarray:
    if id(encoding) not in _LENGTHS:
        out = np.zeros(encoding.n_vocab, np.int64)
        for token, rank in encoding._mergeable_ranks.items():
            out[rank] = len(token)
        _LENGTHS[id(encoding)] = out
    return _LENGTHS[id(encoding)]


class Cutting:
    """How texts are cut, and what a worker needs of a text to do so."""

    def __init__(self, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, halo: int = HALO_BYTES, tokenizer: str = tokenizing.DEFAULT):
        if not 0 <= overlap < limit // 2:
            raise ValueError("overlap must be less than half the limit")
        if halo < 64 or range_bytes < 2 * halo:
            raise ValueError("a range must be at least two halos of 64 bytes")
        self.limit, self.overlap, self.range_bytes, self.halo, self.tokenizer = limit, overlap, range_bytes, halo, tokenizer
        # a stretch without a place to split is shorter than three halos; its ends show within two more
        self.before = 5 * halo + 8
        longest = int(_lengths(tokenizing.encoder(tokenizer)).max())
        self.after = (limit + 1) * longest + 5 * halo + 8  # room for all tokens of a last piece

    def window(self, range_no: int, size: int) -> tuple[int, int]:
        """The bytes of a text that a range and its halos take."""
        return max(range_no * self.range_bytes - self.before, 0), min((range_no + 1) * self.range_bytes + self.after, size)

    def ranges(self, size: int) -> int:
        return -(-size // self.range_bytes)


class Range:
    """The tokens of a range: own ones begin in it, and up to a piece's length of the next ones follow."""

    def __init__(self, data: bytes, at: int, range_no: int, size: int, how: Cutting, tokens: list[int] | None = None):
        """``data`` are the text's bytes from ``at`` on, those of :meth:`Cutting.window`; ``tokens`` those of a whole text, if it was tokenized before."""
        encoding = tokenizing.encoder(how.tokenizer)
        self.data, self.at, self.how = data, at, how
        low, high = range_no * how.range_bytes, min((range_no + 1) * how.range_bytes, size)
        skip = 0
        while at and skip < min(3, len(data)) and data[skip] & 0xC0 == 0x80:
            skip += 1
        text = bytes(data[skip:]).decode("utf-8", "a-character-a-byte")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.arange(at + skip, at + skip + len(points) + 1)
        if len(points) < len(data) - skip:
            widths = (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000)
            starts[1:] += np.cumsum(widths, dtype=np.int64)
        levels, safe = pauses(points)
        end = int(starts[-1])
        safe[0], safe[-1] = at == 0, end == size
        bounds = starts[safe]
        grid = np.arange(-(-(at + skip) // how.halo), end // how.halo + 1) * how.halo
        known = ((grid - how.halo >= at + 4) | (at == 0)) & ((grid + how.halo <= end - 4) | (end == size)) & (grid > 0) & (grid < size)
        grid = grid[known]
        alone = np.searchsorted(bounds, grid + how.halo, "right") == np.searchsorted(bounds, grid - how.halo, "left")
        forced = np.searchsorted(starts, grid[alone])  # the next character's start
        cuts = np.flatnonzero(safe)
        if len(forced):
            cuts = np.union1d(cuts, forced)
        cut_at = starts[cuts]

        first = int(np.searchsorted(cut_at, low, "right")) - 1
        place = int(cuts[first])
        self.begin = int(starts[place])
        lengths: list[np.ndarray] = []
        seen = np.int64(self.begin)
        token_bytes, ahead = _lengths(encoding), how.limit + 1
        inner = np.unique(forced) if len(forced) else forced
        beyond, target = 0, high
        while place < len(points) and beyond < ahead:
            k = int(np.searchsorted(cut_at, target))
            upto = int(cuts[k]) if k < len(cuts) else len(points)
            some = inner[np.searchsorted(inner, place, "right"):np.searchsorted(inner, upto)]
            for x, y in zip([place, *some.tolist()], [*some.tolist(), upto]):
                whole = tokens is not None and y - x == len(points)
                n = token_bytes[np.array(tokens if whole else encoding.encode_ordinary(text[x:y]), np.int64)]
                lengths.append(n)
                beyond += int((seen + np.cumsum(n) - n >= high).sum())
                seen += n.sum()
            place, target = upto, int(starts[upto]) + 4_096
        n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        begins = self.begin + np.cumsum(n) - n
        mine = (begins >= low) & (np.cumsum(begins >= high) <= ahead)
        n, begins = n[mine], begins[mine]
        self.own = int((begins < high).sum())
        #: Byte offsets of tokens, and of the end of the last one.
        self.offsets = np.append(begins, begins[-1] + n[-1] if len(n) else low)
        self.whole = int(self.offsets[-1]) == size  # the text's end is in sight
        where = np.minimum(np.searchsorted(starts, self.offsets), len(levels) - 1)
        self.marks = np.where(starts[where] == self.offsets, levels[where], NO_PLACE).astype(np.uint8)
        self._late, self._early = self._worth()

    def _worth(self) -> tuple[np.ndarray, np.ndarray]:
        """How good each place is as a piece's end in the second half of the room, and before it.

        Best is a pause at least between words whose overlap begins at such a
        certain place too, in the second half; then one before it; then in the
        second half a certain place of any kind, then one whose overlap begins
        between characters; at last any place between two characters.
        """
        level = self.marks
        begin = np.concatenate([np.zeros(self.how.overlap, np.uint8), level])[:len(level)]
        certain, letters = level >= IN_WORD, level >= SPLIT_RUN
        clean = certain & (begin >= IN_WORD)
        apart = begin >= SPLIT_RUN
        early = letters.view(np.uint8) + (letters & apart)
        late = early.copy()
        late[certain & apart] = 3
        late[clean] = 4
        clean &= level >= WORD
        late[clean], early[clean] = 6, 5
        return late * 8 + level * (late > 0), early * 8 + level * (early > 0)

    def end_of(self, s: int) -> int:
        """The token before which the piece that begins at token ``s`` ends: the best place in its room, the later of equals."""
        if self.whole and len(self.marks) - 1 - s <= self.how.limit:
            return len(self.marks) - 1
        half, full = s + self.how.limit // 2 + 1, s + self.how.limit + 1
        late, early = self._late[half:full][::-1], self._early[s + self.how.overlap + 1:half][::-1]
        i = int(late.argmax())
        if len(early) and early[j := int(early.argmax())] > late[i]:
            return half - 1 - j
        return full - 1 - i if late[i] else full - 1

    def next_of(self, s: int, end: int) -> int:
        """Where the piece after the one from ``s`` to ``end`` begins, -1 after the last."""
        if self.whole and end == len(self.marks) - 1 and end - s <= self.how.limit:
            return -1
        back = self.how.overlap
        while back < end - s - 1 and self.marks[end - back] == NO_PLACE:
            back += 1  # a piece begins with a whole character
        return max(end - back, s + 1)

    def short(self) -> bool:
        """Whether this first range shows that the text has no more tokens than the limit."""
        return self.whole and len(self.marks) - 1 <= self.how.limit

    def table(self, range_no: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(own tokens, token of the next range where its first piece begins or -1, pieces) for each token a first piece may begin at.

        A first range has one such token, others have ``limit``.
        """
        after: dict[int, tuple[int, int]] = {}
        wanted = 1 if range_no == 0 else self.how.limit
        exits, pieces = np.full(wanted, -1, np.int32), np.zeros(wanted, np.int32)
        if range_no == 0 and self.short():
            return self.own, exits, pieces
        for e in range(wanted):
            path, s = [], e
            while 0 <= s < self.own and s not in after:
                path.append(s)
                s = self.next_of(s, self.end_of(s))
            out, n = after[s] if s in after else (s - self.own if s >= 0 else -1, 0)
            for k, x in enumerate(reversed(path)):
                after[x] = (out, n + k + 1)
            exits[e], pieces[e] = out, n + len(path)
        return self.own, exits, pieces

    def pieces(self, range_no: int, entry: int, token_base: int, piece_base: int) -> Iterator[tuple]:
        """The pieces that begin in the range: number, tokens, bytes, pause at the end, text."""
        if range_no == 0 and self.short():
            return
        s = entry
        while 0 <= s < self.own:
            end = self.end_of(s)
            a, b, after = int(self.offsets[s]), int(self.offsets[end]), self.next_of(s, end)
            text = bytes(self.data[a - self.at:b - self.at]).decode("utf-8", "replace")
            yield piece_base, token_base + s, token_base + end, a, b, "end" if after < 0 else PAUSES[self.marks[end]], text
            piece_base, s = piece_base + 1, after


PIECE = "piece_no int, token_from bigint, token_to bigint, byte_from bigint, byte_to bigint, pause string, text string"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_NAMES = ["piece_no", "token_from", "token_to", "byte_from", "byte_to", "pause", "text"]
BATCH_BYTES = 4_000_000

Reader = Callable[[str, int, int], bytes]


def read_bytes(path: str, low: int, high: int) -> bytes:
    """Bytes ``low`` to ``high`` of a file, by seeking; ``path`` is a path or address that pyarrow's file systems know."""
    from pyarrow import fs

    if path.startswith("file:"):
        store, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    elif "://" in path:
        store, name = fs.FileSystem.from_uri(path)
    else:
        store, name = fs.LocalFileSystem(), path
    with store.open_input_file(name) as f:
        return f.read_at(high - low, low)


def _windows(b: pa.RecordBatch, how: Cutting, read: Reader | None) -> Iterator[tuple[int, int, Range]]:
    """(row, range, its tokens) of rows of ranges, whose bytes are a column or are read from a file."""
    encode = tokenizing.encoder(how.tokenizer).encode_ordinary
    for k in range(b.num_rows):
        r, size = b.column("range_no")[k].as_py(), b.column("size")[k].as_py()
        low, high = how.window(r, size)
        data = read(b.column("path")[k].as_py(), low, high) if read else b.column("data")[k].as_buffer()
        known = None
        if size <= how.range_bytes:
            known = encode(bytes(data).decode("utf-8", "a-character-a-byte"))
            if len(known) <= how.limit and size <= 2 * how.halo:
                continue  # not to be cut, and too short for an unbroken run that would be tokenized in parts
        yield k, r, Range(data, low, r, size, how, known)


def _emit(batches: Iterator[pa.RecordBatch], how: Cutting, key: str, read: Reader | None) -> Iterator[pa.RecordBatch]:
    """The pieces of ranges whose first token, ``entry`` and bases are known."""
    for b in batches:
        at, rows, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), *[pa.array([p[i] for p in rows], t) for i, t in enumerate(_TYPES)]], names=[key, *_NAMES])

        for k, r, tokens in _windows(b, how, read):
            entry, token_base, piece_base = (b.column(c)[k].as_py() for c in ("entry", "token_base", "piece_base"))
            for p in tokens.pieces(r, entry, token_base, piece_base):
                at.append(k)
                rows.append(p)
                held += p[4] - p[3]
                if held >= BATCH_BYTES:
                    yield out()
                    at, rows, held = [], [], 0
        if rows:
            yield out()


def _tables(batches: Iterator[pa.RecordBatch], how: Cutting, read: Reader | None) -> Iterator[pa.RecordBatch]:
    """The boundary table of each range."""
    for b in batches:
        for k, r, tokens in _windows(b, how, read):
            n, exits, pieces = tokens.table(r)
            one = [b.column(c).slice(k, 1) for c in ("k1", "k2", "range_no")]
            yield pa.RecordBatch.from_arrays([*one, pa.array([n], pa.int64()), pa.array([exits.tobytes()], pa.binary()), pa.array([pieces.tobytes()], pa.binary())], names=["k1", "k2", "range_no", "tokens", "exits", "pieces"])


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From tables in order of (text, range) the entry and prefix sums of every range in which a piece begins."""
    text, seen, entry, tokens, number = None, -1, 0, 0, 0
    for b in batches:
        out = []
        for k1, k2, r, n, exits, pieces in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "range_no", "tokens", "exits", "pieces"))):
            if (k1, k2) != text:
                text, seen, entry, tokens, number = (k1, k2), -1, 0, 0, 0
            if r == seen:
                continue  # of a row repeated exactly
            seen = r
            if entry < 0:
                continue
            begun = int(np.frombuffer(pieces, np.int32)[entry])
            if begun:
                out.append((k1, k2, r, entry, tokens, number))
            entry, tokens, number = int(np.frombuffer(exits, np.int32)[entry]), tokens + n, number + begun
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["k1", "k2", "range_no", "entry", "token_base", "piece_base"])


def _cut_cells(batches: Iterator[pa.RecordBatch], how: Cutting) -> Iterator[pa.RecordBatch]:
    """Cells as rows of ranges with their halos, a few at a time."""
    names = ["k1", "k2", "doc_id", "size", "range_no", "data"]
    for b in batches:
        for k in range(b.num_rows):
            data, size = b.column("data")[k].as_buffer(), b.column("size")[k].as_py()
            step = max(BATCH_BYTES // how.range_bytes, 1)
            for r in range(0, how.ranges(size), step):
                some = range(r, min(r + step, how.ranges(size)))
                slices = pa.array([bytes(data[slice(*how.window(i, size))]) for i in some], pa.binary())
                same = pa.array([k] * len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(same) for c in names[:4]], pa.array(some, pa.int32()), slices], names=names)


_FIRST = "0 AS range_no", "0 AS entry", "0L AS token_base", "0 AS piece_base"
_LOCATED = "k1 bigint NOT NULL, k2 bigint NOT NULL, range_no int NOT NULL"


def _stitched(wide: DataFrame, how: Cutting, key: str, read: Reader | None, parts: int) -> DataFrame:
    """The pieces of texts of several ranges: boundary tables, stitched, and emitted by the ranges again.

    ``wide`` is partitioned by (text, range).  Where it holds bytes, both passes
    read the one exchange.
    """
    tables = wide.mapInArrow(lambda b: _tables(b, how, read), f"{_LOCATED}, tokens bigint, exits binary, pieces binary")
    ordered = tables.repartition(parts, "k1").sortWithinPartitions("k1", "k2", "range_no")
    entries = ordered.mapInArrow(_stitch, f"{_LOCATED}, entry int, token_base bigint, piece_base int")
    known = wide.join(entries.hint("shuffle_hash"), ["k1", "k2", "range_no"])
    if read:
        known = known.repartition(parts, "k1", "k2", "range_no")  # against coalescing: these rows are few bytes and much work
    return known.mapInArrow(lambda b: _emit(b, how, key, read), f"{_KEYS[key]}, {PIECE}")


_KEYS = {"doc_id": "doc_id bigint", "path": "path string"}


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, halo: int = HALO_BYTES, tokenizer: str = tokenizing.DEFAULT) -> DataFrame:
    """Texts of more than ``limit`` tokens as numbered pieces of at most ``limit``.

    ``documents`` has ``doc_id`` and ``text``; other columns are ignored.
    Result: ``doc_id``, ``piece_no`` from 0, ``token_from``, ``token_to``,
    ``byte_from``, ``byte_to`` (in the text), ``pause`` (what ends the piece;
    'end' for a last one) and ``text``.  Each piece shares ``overlap`` tokens
    with the one before it; where a token boundary falls inside a character and
    no other place fits, a token or two more.  Pieces cover the text without a
    gap.  Texts of at most ``limit`` tokens, null and empty ones give no rows;
    each row is a text of its own, rows repeated exactly too.

    Tokens are those of the whole text, save that a run without a blank or other
    place to split for more than two ``halo`` is cut at multiples of it.  Pieces
    are the same whatever ``range_bytes`` is.  The first range of a text begins
    with its first piece, so texts of one range are cut where they are read;
    ranges of the others are spread over the cluster and their tables stitched.
    """
    how = Cutting(limit, overlap, range_bytes, halo, tokenizer)
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a text has no more tokens than bytes
    some = documents.select("doc_id", F.col("text").cast("binary").alias("data"), F.octet_length("text").cast("bigint").alias("size")).where(F.col("size") > limit)
    one = spread(some.where(F.col("size") <= range_bytes)).selectExpr("doc_id", "size", "data", *_FIRST)
    done = one.mapInArrow(lambda b: _emit(b, how, "doc_id", None), f"doc_id bigint, {PIECE}")

    keyed = some.where(F.col("size") > range_bytes).select(F.xxhash64("doc_id", "data").alias("k1"), F.xxhash64("data", "size", "doc_id").alias("k2"), "doc_id", "size", "data")
    cells = keyed.mapInArrow(lambda b: _cut_cells(b, how), "k1 bigint NOT NULL, k2 bigint NOT NULL, doc_id bigint, size bigint, range_no int NOT NULL, data binary")
    return done.unionByName(_stitched(cells.repartition(parts, "k1", "k2", "range_no"), how, "doc_id", None, parts))


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 8 * RANGE_BYTES, halo: int = HALO_BYTES, tokenizer: str = tokenizing.DEFAULT, glob: str = "*", read: Reader = read_bytes) -> DataFrame:
    """:func:`split_documents` of UTF-8 files of any size: ``path`` in place of ``doc_id``.

    Only names and sizes of files are listed; every task reads its ranges by
    seeking, and no file is ever loaded.  Text is never shuffled, only names,
    tables and offsets are.  Files of at most ``limit`` bytes give no rows.
    A byte that is no UTF-8 counts as a character and comes out as U+FFFD.
    """
    how = Cutting(limit, overlap, range_bytes, halo, tokenizer)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size")).where(F.col("size") > limit)
    one = listed.where(F.col("size") <= range_bytes).repartition(parts, "path").selectExpr("path", "size", *_FIRST)
    done = one.mapInArrow(lambda b: _emit(b, how, "path", read), f"path string, {PIECE}")
    numbers = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / range_bytes) - 1).cast("int")))
    wide = listed.where(F.col("size") > range_bytes).select(F.xxhash64("path").alias("k1"), F.xxhash64("path", "size").alias("k2"), "path", "size", numbers.alias("range_no"))
    return done.unionByName(_stitched(wide.repartition(parts, "k1", "k2", "range_no"), how, "path", read, parts))
