import html

import pytest
from pyspark.sql import functions as F

from millrace.functions import qr, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [
    ("%41%42c", "ABc"), ("A%42", "AB"), ("Caf%C3%A9", "Café"), ("100%", "100%"), ("a+b %zz%4", "a+b %zz%4"), ("%FF", "�"), ("%2541", "%41"), ("", ""), (None, None), ("x" * 100_000 + "%20", "x" * 100_000 + " "),
])
def test_percent_decode(spark, raw, want):
    assert one(spark, raw, text.percent_decode) == want


@pytest.mark.parametrize("raw, want", [("12", 12), ("-3", -3), ("+4", 4), ("x", 0), ("", 0), (None, 0), ("99999999999", 0), (" 5", 0), ("5\n", 0), ("1.5", 0)])
def test_safe_int(spark, raw, want):
    assert one(spark, raw, text.safe_int) == want


def test_wiki_cleaning(spark):
    assert one(spark, "It's 'ok' http://x.y/z <ref a>q</ref> &amp; Done", text.clean_wiki_text) == "it's ok q done"
    assert one(spark, None, text.clean_wiki_text) is None
    assert one(spark, "&eacute;&#65; &lt;b&gt;", text.html_unescape) == html.unescape("&eacute;&#65; &lt;b&gt;")


def test_tagged_texts(spark):
    line = "<revision x><text a>one</text><text>two</text></revision><text>no</text><revision><text></text></revision>"
    assert one(spark, line, text.tagged_texts) == ["one", "two", ""]


@pytest.mark.parametrize("words, n, short", [("a b c d e f", 20, False), ("a b c d e f", 20, True), ("the cat", 3, False), ("the cat", 2, True), ("one", 1, False), ("one", 0, True), ("", 0, False)])
def test_ngrams(spark, words, n, short):
    got = one(spark, words, lambda c: text.ngrams(text.words(c), 5, short))
    assert len(got) == n and all(words.find(g) >= 0 for g in got)


def test_censor_hash_parity_and_paths(spark):
    assert one(spark, "FooBar", lambda c: text.censor(c, ["foobar"])) == "F****r" and one(spark, "ok", lambda c: text.censor(c, ["foobar"])) == "ok"

    def java(s):
        h = 0
        for ch in s:
            h = (31 * h + ord(ch)) & 0xFFFFFFFF
        return h - 2**32 if h >= 2**31 else h

    for s in ("", "a", "svc-mirror", "é漢字", "long " * 50):
        assert one(spark, s, text.java_hash) == java(s)
        assert one(spark, s, text.shard) == abs(java(s)) % 7
    assert one(spark, 7, text.parity, "int") == 1 and one(spark, 3, text.parity, "int") == 0
    assert [one(spark, s, text.without_extension) for s in ("a/b.c.mp4", "a.b/c", ".x", "x")] == ["a/b.c", "a.b/c", ".x", "x"]
    assert one(spark, "User talk", text.namespaces) == "user_talk:"


# Golden values of the format.
GOLDEN = {
    "CC Team": "0xfe33fc140xd06ea2bb0x7595dbac0xaec121070xfaafe00c0xb32450xce10b7980x490419c0x2340001c0x47f844300x5315bac90x25d18c2e0xa60505140x1fd8a2",
    "CC Team is awesome!": "0xfe453fc10x106e950x4bb75aa50xdba102ec0x100907fa0xaafe00800x2338280x8aaa0600xea1228b40x4a0040x42cd56410xcea034790x81de020xff000a440x7f802b300x42b14ba50x5f85d02d0x4ee840450x42820fe0x17e00",
}
CANVAS = "0x294acd760xfe823fc00x82bc20fd0xba60aeac0xbaf12ee20xbad82eeb0x82c420d00xfeaabfd70x37801e0x807624430x80146b50x8036a0750xed018e040x8032a0520xdd0106ea0x809020690x9c0116f80x1f90204a0x8db00720x1a80bfff0x688020920x1fb2aeb20x2a82ea20x4802e9e0x30a020bd0x13433fea0xf879a0250xe281253c0x386ba9e90xcb8ac96a0x3bb6b9480x3cb69f31"


def test_qr_golden_values():
    for t, code in GOLDEN.items():
        assert qr.encode(t) == code
    assert qr.decode(CANVAS) == "CC Team is awesome!"


@pytest.mark.parametrize("t", ["", "a", "fourteen chars", "just over fourteen", "0123456789 0123456789 x"])
@pytest.mark.parametrize("turns", range(4))
def test_qr_round_trip(t, turns):
    rows = qr.matrix(t)
    assert qr.decode(qr.to_hex(qr.on_canvas(rows, 32 - len(rows), 2, turns))) == t


def test_qr_edges():
    assert qr.encode("x" * 24) == qr.TOO_LONG and qr.encode(None) is None and qr.decode(None) is None
    assert qr.decode("0xzz") is None and qr.decode("") == qr.TOO_LONG and qr.decode("0x0" * 32) == qr.TOO_LONG
