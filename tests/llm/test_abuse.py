import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import abuse, spelling

TWEET = "tweetid bigint, text string, source string, crawled_at timestamp_ntz"
AT = datetime(2018, 3, 1)


SPELLER = spelling.Speller({w: 1.0 for w in ("idiot", "dipshit", "vile", "lowlife", "loser", "idiota", "wanker")} | {"vole": -1.0})


@pytest.mark.parametrize("token, word", [
    ("1d10t", "idiot"), ("d.i.p.s.h.i.t", "dipshit"), ("d i p s h i t", "dipshit"), ("v**e", "vile"), ("l0wl1f3", "lowlife"), ("lоsеr", "loser"), ("idiiiiiota", "idiota"), ("WaNKer", "wanker"), ("harbour", "harbour"), ("it's", "it's"),
])
def test_spelling(token, word):
    assert SPELLER.spelt(token)[0] == word


def test_disguises_are_undone_without_any_word():
    none = spelling.Speller()
    assert [none.spelt(t)[0] for t in ("l0wl1f3", "d.i.p.s.h.i.t", "lоsеr", "idiiiiiota", "v**e")] == ["lowlife", "dipshit", "loser", "idiota", "<masked>"]


def test_plain_text():
    assert spelling.plain("c%C3%A1llate%20ya") == "cállate ya" and spelling.plain("a &amp; b") == "a & b" and spelling.plain("stu​pid 100%") == "stupid 100%"


def test_tokens_keep_their_offsets():
    t = "hey @bob, d i p s h i t! see https://a.b/c #x 42"
    got = SPELLER.tokens(t)
    assert [g[0] for g in got] == ["hey", "<user>", ",", "dipshit", "!", "see", "<url>", "<tag>", "<num>"]
    assert t[got[3][2]:got[3][3]] == "d i p s h i t"


def test_forward_backward_is_exact():
    """Against all taggings of short rows."""
    rng = np.random.default_rng(1)
    e, length, trans = rng.normal(size=(4, 5)), np.array([5, 3, 1, 0]), np.array([-0.4, 0.2, 0.7])
    logz, m, pairs = abuse.forward_backward(e, length, trans)
    for r in range(4):
        total, on, steps = 0.0, np.zeros(5), np.zeros(3)
        for code in range(2 ** length[r]):
            tag = [0, *[(code >> k) & 1 for k in range(length[r])]]
            s = sum(e[r, k] for k in range(length[r]) if tag[k + 1])
            used = np.zeros(3)
            for a, b in zip(tag, tag[1:]):
                if (a, b) != (0, 0):
                    used[{(0, 1): 0, (1, 0): 1, (1, 1): 2}[a, b]] += 1
            w = np.exp(s + used @ trans)
            total += w
            on[:length[r]] += w * np.array(tag[1:])
            steps += w * used
        assert np.isclose(logz[r], np.log(total)) and np.allclose(m[r], on / total) and np.allclose(pairs[r], steps / total)


def docs(texts):
    return [SPELLER.tokens(spelling.plain(t)) for t in texts]


def check_gradient(c, w, q, some):
    use = np.ones(c.n, bool)
    g = c.loss(w, q, use, 0.3)[1]
    for k in some:
        d = np.zeros(len(w))
        d[k] = 1e-6
        assert np.isclose((c.loss(w + d, q, use, 0.3)[0] - c.loss(w - d, q, use, 0.3)[0]) / 2e-6, g[k], atol=1e-4, rtol=1e-4)


def test_gradient_is_that_of_the_loss():
    c = abuse._Corpus(docs(["you idiot", "a fine day", "you fool of a man", "fine idiot proof day"]), least=1)
    w = c.prior + np.random.default_rng(0).normal(size=len(c.prior)) * 0.1
    check_gradient(c, w, np.array([0.9, 0.05, 0.7, 0.2]), (0, 1, len(w) // 2, len(w) - 3, len(w) - 2, len(w) - 1))


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["you idiot", "", "a \"fine day\" @bob https://x.y/z", "v**e d i p s h i t 42 " * 10, "x"]
    together = abuse.feature_rows(docs(texts))
    assert (together == np.concatenate([abuse.feature_rows([d]) for d in docs(texts)])).all()
    assert (together[:, 0] == 0).all() and (together[:, 1:] > 0).all() and (together < 1 << abuse.BITS).all()


def test_labelled_texts_are_fitted_whole():
    clean = " ".join(f"calm{k % 50}" for k in range(1000))
    texts = [clean + " glorp snarf", "a fine day", clean, "glorp snarf", "you idiot", clean + " " + clean + " idiot"]
    c = abuse._Corpus(docs(texts), least=1)
    assert list(c.length) == [len(d) for d in docs(texts)]
    assert set(np.unique(abuse.feature_rows(docs(texts[:1]))).tolist()) <= set(c.names.tolist())  # those of the last tokens too
    assert c.slots < 3 * c.length.sum() + len(texts) * abuse.LONGEST
    w = c.prior + np.random.default_rng(0).normal(size=len(c.prior)) * 0.1
    table = np.zeros(1 << abuse.BITS)
    table[c.names] = w[:-3]
    f = abuse.Field(table, w[-3:])
    alone = [abuse.forward_backward(f.emissions([d])[None, :], np.array([len(d)]), f.trans)[0][0] for d in docs(texts)]
    assert np.allclose(c.scores(w), -np.expm1(-np.array(alone)))
    check_gradient(c, w, np.array([0.9, 0.05, 0.1, 0.8, 0.7, 0.6]), (1, len(w) // 3, len(w) // 2, len(w) - 1))


def fitted():
    rng = random.Random(7)
    train = corpus(rng, 400)
    return abuse.fit_field([t for t, _ in train], [[("a", y)] for _, y in train])


def test_long_texts_are_scored_as_one_chain():
    f = fitted()
    filler = lambda n: " ".join(["ferry"] * n)
    for n in (10, 300, 399, 401, 799, 2000):  # at 399 and 799 a border of 400 tokens would part the words
        text = f"{filler(n)} you vile glorp {filler(500)} you stupid idiot {filler(450)} you"
        toks = f.speller().tokens(spelling.plain(text))
        logz, m, _ = abuse.forward_backward(f.emissions([toks])[None, :], np.array([len(toks)]), f.trans)
        score, spans, peak = abuse.score_text(f, text)
        assert np.isclose(score, 1 - np.exp(-logz[0])) and np.isclose(peak, m.max())
        assert any("glorp" in words for _, _, words in spans) and any("idiot" in words for _, _, words in spans)
        assert np.isclose(abuse.score_batch(f, ["a", text, None])[1][0], score)


def corpus(rng, n):
    bad = ["you are a {} {}", "shut up {} {}", "what a {} {} you are", "@bob you {} {}"]
    good = ["the {} ferry was late", "what a {} day at the market", "you are not a {} idiot, the queue is long", "my {} driver was kind", "thank you for the {} map"]
    out = []
    for k in range(n):
        if k % 5 == 0:
            out.append((rng.choice(bad).format(rng.choice(["vile", "lazy", "stupid"]), rng.choice(["idiot", "moron", "glorp", "snarf"])), 1))
        else:
            out.append((rng.choice(good).format(rng.choice(["quiet", "steep", "lazy", "late"])), 0))
    return out


def test_held_out_accuracy_with_reviewers_that_err():
    rng = random.Random(7)
    train, held = corpus(rng, 400), corpus(rng, 200)
    verdicts = [[(r, y ^ (rng.random() < err)) for r, err in (("a", 0.05), ("b", 0.25)) if rng.random() < 0.8] or [("a", y)] for _, y in train]
    f = abuse.fit_field([t for t, _ in train], verdicts)
    right = sum((abuse.score_text(f, t)[0] >= 0.5) == y for t, y in held)
    assert right >= 0.97 * len(held)
    assert f.reviewers["a"][1] > f.reviewers["b"][1]
    assert (abuse.fit_field([t for t, _ in train], verdicts).table == f.table).all()
    disguised = sum(abuse.score_text(f, t)[0] >= 0.5 for t in ("you are a v*le idiot", "you are a lazy 1d10t", "what a stupid mooooron you are", "you are a lazy g l o r p"))
    assert disguised >= 3


def test_batches_and_spans_agree_with_single_texts():
    f = fitted()
    texts = ["hello @bob", "you are a stupid idiot", None, "", "  ", "ferry " * 3_000 + "you are a stupid idiot", "late " * 100]
    one = [abuse.score_text(f, t) for t in texts]
    for most in (200_000, 7):
        for a, b in zip(one, abuse.score_batch(f, texts, most)):
            assert np.isclose(a[0], b[0]) and a[1] == b[1]
    assert one[0][0] < 0.5 < one[1][0] and one[5][0] > 0.5 and one[2] == one[3] == one[4] == (0.0, [], 0.0)
    assert any("idiot" in s[2] for s in one[1][1]) and texts[1][one[1][1][0][0]:one[1][1][0][1]] == one[1][1][0][2]


def test_without_labels_nothing_is_abusive():
    f = abuse.fit_field([], [])
    assert abuse.score_text(f, "you stupid idiot " * 50)[0] < 1e-6


def test_tables(spark):
    train = corpus(random.Random(3), 200)
    rows = [(100 + k, t, "web", AT) for k, (t, _) in enumerate(train)]
    rows += [(1, "you are a stupid idiot", " Web ", AT), (1, "you are a stupid idiot", " Web ", AT), (2, "my quiet driver was kind", "web", AT), (3, None, None, AT), (4, "", "APP", AT), (None, "x", "web", AT), (5, "the late ferry was late", "web", None)]
    tweets = spark.createDataFrame(rows, TWEET).withColumn("score", F.lit(1)).withColumn("spans", F.lit(2))
    given = [(100 + k, "r", y) for k, (_, y) in enumerate(train)] + [(9, "r", 1), (None, "r", 1), (1, None, 1), (2, "s", None), (2, "s", 7)]
    labels = spark.createDataFrame(given, "tweetid bigint, reviewer string, abusive int")
    got = {r.tweetid: r for r in abuse.score_tweets(tweets, labels).where("tweetid < 100").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1].abusive and not got[2].abusive and got[3].score == got[4].score == 0 and got[1].spans
    rates = {r.source: (r.tweets, r.abusive_tweets) for r in abuse.rates(abuse.score_tweets(tweets, labels).where("tweetid < 100")).collect()}
    assert rates == {"web": (3, 1), None: (1, 0), "app": (1, 0)}
    assert abuse.score_tweets(tweets.limit(0), labels).count() == 0
    assert abuse.score_tweets(tweets, labels.limit(0)).where("abusive").count() == 0
