"""Tokens of a tweet with their offsets, and what each token probably spells.

Undone are percent-encoding and HTML escapes of a whole text, invisible
characters, look-alike letters, digits and signs for letters, letters set apart
and masked letters.  Where a disguise leaves several readings, those among the
words of the labelled tweets count, the one with the greatest odds first; there is
no other word list.
"""

from __future__ import annotations

import html
import re
import unicodedata
import urllib.parse
from collections.abc import Mapping

#: Letters of other scripts that look like Latin ones; fixed values.
LOOKALIKE = dict(zip("аеорсухіјѕԁһӏкмтвн" "АВЕКМНОРСТУХ" "αορενικτυ", "aeopcyxijsdhlkmtbh" "ABEKMHOPCTYX" "aopevikty"))
#: Digits and signs that stand for letters; fixed values.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
MASK = "*_#@-.%$?"

_ENCODED = re.compile(r"(?:%[0-9A-Fa-f]{2})")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿️]")
_TOKEN = re.compile(r"https?://\S+|@\w+|#\w+|[^\W\d_](?:[ .\-*_][^\W\d_]){3,}(?![^\W\d_])|[\w*$@'’+\-.]*\w[\w*$@'’+\-]*|[一-鿿぀-ヿ]|[^\s\w]", re.I)
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_APART = re.compile(r"[^\W\d_](?:[ .\-*_][^\W\d_]){3,}")


def plain(text: str) -> str:
    """``text`` with encodings and invisible characters undone."""
    if len(_ENCODED.findall(text)) >= 2 or (" " not in text and "%20" in text):
        text = urllib.parse.unquote(text, errors="replace")
    if "&" in text:
        text = html.unescape(text)
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


class Speller:
    """Reads disguised tokens as words of ``odds``, which says how much likelier a word is in abusive texts."""

    def __init__(self, odds: Mapping[str, float] | None = None, most: int = 200_000):
        self.odds, self.most = dict(odds or {}), most
        self._by_length: dict[int, list[str]] = {}
        for w in sorted(self.odds, key=lambda w: (-self.odds[w], w)):
            self._by_length.setdefault(len(w), []).append(w)
        self._read: dict[str, tuple[str, str]] = {}

    def _known(self, guesses: list[str]) -> str | None:
        return max((g for g in guesses if g in self.odds), key=lambda g: self.odds[g], default=None)

    def spelt(self, token: str) -> tuple[str, str]:
        """(what a token spells, in lower case; the way it was disguised, or '')."""
        got = self._read.get(token)
        if got is None:
            if len(self._read) >= self.most:
                self._read.clear()
            got = self._read[token] = self._spelt(token)
        return got

    def _spelt(self, token: str) -> tuple[str, str]:
        low = token.lower().replace("’", "'")
        how = ""
        if _DRAWN.search(low):
            single = _DRAWN.sub(r"\1", low)
            known = self._known([single, _DRAWN.sub(r"\1\1", low)])
            if known:
                return known, "drawn"
            low, how = single, "drawn"
        if low.isascii() and low.isalpha():
            return low, how
        if not low.isascii() and re.search("[a-z]", low):
            turned = "".join(LOOKALIKE.get(c, c) for c in low)
            if turned != low:
                low, how = turned, "alike"
        if low.isalpha() or low in self.odds:
            return low, how
        bare = re.sub(r"[ .\-*_]", "", low)
        if _APART.fullmatch(low):
            # a short word before the letters may have been caught with them
            return (bare[1:] if bare not in self.odds and bare[1:] in self.odds else bare), "apart"
        if re.search(r"[a-z]", low) and re.search(r"[0-9@$!|+]", low):
            one = "".join(LEET.get(c, c) for c in low)
            known = self._known([one, "".join("l" if c in "1!" else LEET.get(c, c) for c in low), *(one[:k] + "l" + one[k + 1:] for k, c in enumerate(low) if c in "1!" and len(one) == len(low))])
            if known:
                return known, "leet"
        if 3 <= len(low) <= 14 and any(c in MASK for c in low):
            for w in self._by_length.get(len(low), ()):
                if w[0] == low[0] and w.isalpha() and all(a == b or a in MASK for a, b in zip(low, w)):
                    return w, "mask"
            if bare in self.odds:
                return bare, "mask"
            if any(c in "*@_" for c in low[1:]):
                return "<masked>", "mask"
        letters = sum(c.isalpha() for c in low)
        if letters >= 3 and re.search(r"[0-9]", low) and re.fullmatch(r"[a-z0-9]+", low) and letters * 2 >= len(low):
            return "".join(LEET.get(c, c) for c in low), "leet"
        return low.strip("'-.*_"), how

    def tokens(self, text: str) -> list[tuple[str, str, int, int]]:
        """(word, disguise, start, end) of each token of ``plain(text)``.

        Links, names and tags become ``<url>``, ``<user>`` and ``<tag>``, numbers ``<num>``.
        """
        out = []
        read = self._read.get
        for m in _TOKEN.finditer(text):
            t, a, b = m.group(), m.start(), m.end()
            got = read(t)
            if got is None:
                if t[:4].lower() == "http" and "://" in t:
                    got = ("<url>", "")
                elif t[0] == "@" and len(t) > 1:
                    got = ("<user>", "")
                elif t[0] == "#" and len(t) > 1:
                    got = ("<tag>", "")
                elif t.isdigit():
                    got = ("<num>", "")
                else:
                    if len(t) > 1 and t[-1] in ".-":
                        # a last letter may be masked by a stroke; a full stop is none
                        t, b = (t, b) if t[-1] == "-" and len(t) > 3 else (t.rstrip(".-") or t, b)
                    got = self.spelt(t)
            if got[0]:
                out.append((got[0], got[1], a, b))
        return out
