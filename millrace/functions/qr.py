"""A text codec on square bit matrices, with UDFs over it.

Version 1 is 21 cells a side for up to 14 characters, version 2 is 25 for up to
23.  Three finder patterns, two timing lines and, in version 2, an alignment
pattern are fixed; all other cells hold, column by column from the right and
alternately upwards and downwards, the length, then every character and its
parity, then a filler.  Texts that are too long give ``heartbeat``.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values of the format.
TOO_LONG = "heartbeat"
FILLER = (0xEC, 0x11)
SIDES = {1: 21, 2: 25}
MOST = {1: 14, 2: 23}
CANVAS = 32
FINDER, QUIET = 7, 8
ALIGNMENT = {2: (16, 16)}


def _rings(side: int) -> list[list[int]]:
    """Concentric squares: dark rim, light ring, dark core."""
    far = lambda i, j: min(i, j, side - 1 - i, side - 1 - j)
    return [[int(far(i, j) != 1) for j in range(side)] for i in range(side)]


@lru_cache(maxsize=2)
def layout(version: int) -> tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, int], ...]]:
    """(fixed matrix by row, free cells in writing order as (row, column))."""
    n = SIDES[version]
    dark = [[0] * n for _ in range(n)]
    fixed = [[False] * n for _ in range(n)]

    def stamp(top: int, left: int, pattern: list[list[int]]) -> None:
        for i, row in enumerate(pattern):
            for j, v in enumerate(row):
                dark[top + i][left + j], fixed[top + i][left + j] = v, True

    for k in range(n):  # timing lines
        on = int(k % 2 == 0)
        dark[6][k] = dark[k][6] = on
        fixed[6][k] = fixed[k][6] = True
    for top, left in ((0, 0), (0, n - QUIET), (n - QUIET, 0)):
        stamp(top, left, [[0] * QUIET for _ in range(QUIET)])
    for top, left in ((0, 0), (0, n - FINDER), (n - FINDER, 0)):
        stamp(top, left, _rings(FINDER))
    if version in ALIGNMENT:
        stamp(*ALIGNMENT[version], _rings(5))
    order = []
    for turn, col in enumerate(range(n - 1, -1, -1)):
        rows = range(n - 1, -1, -1) if turn % 2 == 0 else range(n)
        order += [(r, col) for r in rows if not fixed[r][col]]
    return tuple(map(tuple, dark)), tuple(order)


def matrix(text: str) -> list[list[int]] | None:
    """The matrix of a text, by row; None if it is too long.  Characters beyond ASCII become ``?``."""
    version = next((v for v in (1, 2) if len(text) <= MOST[v]), None)
    if version is None:
        return None
    dark, order = layout(version)
    payload = [len(text)]
    for b in text.encode("ascii", "replace"):
        payload += [b, b.bit_count() & 1]
    bits = [(b >> (7 - k)) & 1 for b in payload for k in range(8)]
    filler = [(b >> (7 - k)) & 1 for b in FILLER for k in range(8)]
    bits += [filler[k % 16] for k in range(max(len(order) - len(bits), 0))]
    out = [list(r) for r in dark]
    for (r, c), bit in zip(order, bits):
        out[r][c] = bit
    return out


def to_hex(rows: list[list[int]]) -> str:
    """Bits by row in words of 32, each as ``0x`` and its hex digits without padding; a last word may be shorter."""
    bits = [b for r in rows for b in r]
    return "".join("0x" + format(int("".join(map(str, bits[k:k + 32])), 2), "x") for k in range(0, len(bits), 32))


def encode(text: str | None) -> str | None:
    """Hex words of a text's matrix, or ``heartbeat``; null gives null."""
    if text is None:
        return None
    rows = matrix(text)
    return TOO_LONG if rows is None else to_hex(rows)


def turned(rows: list[list[int]], quarter_turns: int) -> list[list[int]]:
    """The square turned clockwise."""
    for _ in range(quarter_turns % 4):
        rows = [list(r) for r in zip(*rows[::-1])]
    return rows


def on_canvas(rows: list[list[int]], top: int, left: int, quarter_turns: int = 0) -> list[list[int]]:
    """A 32-cell canvas with the matrix at a place, turned."""
    out = [[0] * CANVAS for _ in range(CANVAS)]
    for i, r in enumerate(turned(rows, quarter_turns)):
        out[top + i][left:left + len(r)] = r
    return out


def _finders(rows: list[int]) -> set[tuple[int, int]]:
    """(row, column) of every finder pattern on a canvas of 32-bit rows."""
    wanted = [int("".join(map(str, r)), 2) for r in _rings(FINDER)]
    found = set()
    for i in range(CANVAS - FINDER + 1):
        run = rows[i]
        for k in (1, 2, 3):  # seven dark cells on end: runs of 2, 4, 7
            run &= rows[i] << 1 if k == 1 else run << 2 if k == 2 else run << 3
        while run:
            top = run.bit_length() - 1
            run ^= 1 << top
            j = CANVAS - 1 - top
            if 0 <= j <= CANVAS - FINDER and all((rows[i + a] >> (CANVAS - FINDER - j)) & 0x7F == wanted[a] for a in range(FINDER)):
                found.add((i, j))
    return found


def _locate(rows: list[int]) -> tuple[int, int, int, int] | None:
    """(version, top, left, quarter turns clockwise) of the matrix on a canvas, by its three finder patterns."""
    spots = _finders(rows)
    for version, n in SIDES.items():
        d = n - FINDER
        for top, left in sorted(spots):
            for i0, j0 in ((top, left), (top - d, left), (top, left - d)):
                corners = [(i0, j0), (i0, j0 + d), (i0 + d, j0 + d), (i0 + d, j0)]  # clockwise from the top left
                there = [c in spots for c in corners]
                if sum(there) == 3 and i0 >= 0 and j0 >= 0 and i0 + n <= CANVAS and j0 + n <= CANVAS:
                    # upright, the bottom right corner has none; each step clockwise is one turn
                    return version, i0, j0, (there.index(False) - 2) % 4
    return None


@lru_cache(maxsize=8)
def _reading_order(version: int, turns: int) -> tuple[tuple[int, int], ...]:
    """Where the free cells lie, in writing order, after so many quarter turns clockwise."""
    n, cells = SIDES[version], layout(version)[1]
    for _ in range(turns):
        cells = tuple((c, n - 1 - r) for r, c in cells)
    return cells


def decode(code: str | None) -> str | None:
    """The text of a matrix anywhere and any way up on a 32-cell canvas.

    ``heartbeat`` where none is found; null where the text is no hex.  Length
    and parity are not checked.
    """
    if code is None:
        return None
    try:
        rows = [int(p, 16) for p in code.split("0x") if p]  # a word is a row
    except ValueError:
        return None
    rows = (rows + [0] * CANVAS)[:CANVAS]
    found = _locate(rows)
    if found is None:
        return TOO_LONG
    version, top, left, turns = found
    shift = CANVAS - 1 - left
    bits = [(rows[top + r] >> (shift - c)) & 1 for r, c in _reading_order(version, turns)]
    data = int("".join(map(str, bits[:len(bits) // 8 * 8])), 2).to_bytes(len(bits) // 8, "big")
    text, is_parity = [], False
    for b in data[1:]:
        if is_parity:
            is_parity = False
        elif b not in FILLER:
            text.append(chr(b))
            is_parity = True
    return "".join(text)


@pandas_udf(StringType())
def qr_encode(s: pd.Series) -> pd.Series:
    return s.map(lambda t: encode(t) if isinstance(t, str) else None)


@pandas_udf(StringType())
def qr_decode(s: pd.Series) -> pd.Series:
    return s.map(lambda t: decode(t) if isinstance(t, str) else None)


@pandas_udf(StringType())
def qr_canvas(s: pd.Series) -> pd.Series:
    """A text's matrix on a canvas, its place and turn taken from its length."""
    def one(t):
        if not isinstance(t, str):
            return None
        rows = matrix(t)
        return TOO_LONG if rows is None else to_hex(on_canvas(rows, len(t) % 7, len(t) % 5, len(t)))

    return s.map(one)
