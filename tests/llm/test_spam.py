"""Spam pages."""

import random
import tracemalloc

import numpy as np
import pytest

from millrace.llm import spam

DOCS = "doc_id bigint, text string"
NOUNS = "harbour bridge council library school budget ferry bakery market tunnel bursary clinic".split()
ADJECTIVES = "public old small narrow rural patient hasty new costly fragile".split()
VERBS = "supports weakens delays funds rescues explains limits".split()
GOODS = "sofa watch lamp mattress boots tyre carpet".split()
DEALS = "cheap buy discount sale offer online".split()


def _prose(rng, n):
    one = lambda: f"The {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)} {rng.choice(VERBS)} a {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)} in {rng.choice(['the north', 'our town', 'this district'])} and we know that it will do so for {rng.randint(2, 90)} years."
    return " ".join(one() for _ in range(n))


def _pages():
    rng = random.Random(4)
    spam_, fine = {}, {i: _prose(rng, rng.randint(4, 12)) for i in range(300)}
    link = lambda: f"https://{rng.choice(GOODS)}-{rng.randint(1, 99)}.shop.example/p/{rng.randint(1, 9999)}"
    makers = [
        lambda: ", ".join(f"{rng.choice(DEALS)} {rng.choice(GOODS[:3])}" for _ in range(60)),
        lambda: "\n".join(f"[{rng.choice(DEALS)} {rng.choice(GOODS)}]({link()})" for _ in range(20)),
        lambda: "\n".join(link() for _ in range(25)),
        lambda: " ".join(f"#{rng.choice(DEALS)}{rng.choice(GOODS).title()}" for _ in range(60)),
        lambda: "\n".join(f"{rng.choice(GOODS).title()} Tor{rng.choice('abcdef')}by | {rng.randint(10, 900)}.{rng.randint(10, 99)} EUR | {rng.choice(DEALS)} | art. {rng.randint(1000, 9999)}" for _ in range(25)),
    ]
    for k in range(25):
        spam_[1000 + k] = makers[k % 5]() + "\n" + _prose(rng, 1)
        spam_[1100 + k] = spam_[1000 + k].upper()
    names = lambda: f"{rng.choice('ABCDEFGH')}. {rng.choice(['Tor', 'Hes', 'Kes', 'Gal', 'Ull', 'Bra'])}{rng.choice(['fen', 'mo', 'la', 'ri', 'ne'])}{rng.choice(['by', 'ness', 'wick', 'sund', 'vale', 'holt', 'lund'])}"
    for k in range(15):
        fine[2000 + k] = _prose(rng, 1) + "\n" + "\n".join(names() for _ in range(40))
        fine[2100 + k] = "\n".join(f"The {rng.choice(ADJECTIVES)} {rng.choice(NOUNS)}\t{rng.randint(100, 9999)}\t{rng.randint(100, 9999)}" for _ in range(20))
        fine[2200 + k] = _prose(rng, 8) + "\n" + link() + " cheap"
        fine[2300 + k] = "Order! " * 8 + _prose(rng, 1)
    return spam_, fine


def test_spam_and_what_only_looks_like_it(spark):
    bad, fine = _pages()
    rows = [*bad.items(), *fine.items(), (9000, None), (9001, ""), (None, "x"), (9002, "   \n ")]
    got = {r.doc_id: r.spam_share for r in spam.spam_pages(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as kind", "2 as n")).collect()}
    assert len(set(bad) & set(got)) >= 0.95 * len(bad)
    assert not set(got) - set(bad)
    assert all(0.5 < s <= 1 for s in got.values())


def test_empty_tiny_and_long(spark):
    assert spam.spam_pages(spark.createDataFrame([], DOCS)).count() == 0
    assert spam.spam_pages(spark.createDataFrame([(1, "a"), (2, "!"), (3, "­")], DOCS)).count() == 0
    _, fine = _pages()
    rows = [*fine.items(), (1, "buy lamp, cheap lamp, lamp sale, " * 20_000), (2, _prose(random.Random(1), 3000))]
    got = {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, DOCS)).collect()}
    assert 1 in got and 2 not in got


@pytest.mark.parametrize("text", ["Ab c1, https://x.example/p?q#z end.\n\nÉté été www.a.b x.y/z", "", "a", "://", "..//"])
def test_tokens_against_plain_loop(text):
    t = spam.Tokens([text])
    n = [w for w in text.split() if "://" in w or "www." in w.lower() or ("/" in w and "." in w and w[w.index(".") - 1 : w.index(".")].isalnum() and w[w.index(".") + 1 : w.index(".") + 2].isalnum())]
    assert (t.kind == spam.LINK).sum() == len(n)
    assert t.size.sum() == sum(not c.isspace() for c in text) == t.solid.sum()


def test_hash_is_of_the_folded_word_wherever_it_stands():
    t = spam.Tokens(["Été, the ÉTÉ", "x été"])
    h = t.hash[t.kind == spam.WORD]
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    assert t.doc.tolist()[-2] == 1


def test_line_ends_within_sentences_are_left_out():
    t, plain = spam.Tokens(["The costly court\nof the thre-\natened town sat. It\n\nThe next\n- item\nThird"]), spam.Tokens(["The costly court of the threatened town sat. It\n\nThe next\n- item\nThird"])
    assert t.kind.tolist() == plain.kind.tolist() and t.sentence.tolist() == plain.sentence.tolist()
    assert t.size.sum() == t.solid.sum() == plain.size.sum() + 1 and (t.hash[:5] == plain.hash[:5]).all()
    two = spam.Tokens(["a line\n", "small next"])
    assert (two.kind == spam.LINE).sum() == 3 and two.doc.tolist() == [0, 0, 0, 0, 1, 1, 1]


def test_windows_stay_in_their_document():
    doc = np.repeat([0, 1], 50)
    assert (spam.smooth(np.where(doc == 0, 1.0, 5.0), np.ones(100), doc, 12) == np.where(doc == 0, 1.0, 5.0)).all()


def test_lexicon_has_no_cap(spark):
    """Pages that name each of many goods once are known by the words of other pages, however many those are."""
    rng = random.Random(8)
    goods = [a + b for a in "zor vad mil tek bru nal".split() for b in "quad fenk opri lusk arbo imta ulve ostri egna yspo".split()]
    _, fine = _pages()
    rows = dict(fine)
    for k in range(120):
        own = [goods[(k + d) % 60] for d in (0, 7, 19)]
        rows[3000 + k] = ", ".join(rng.choice(own) for _ in range(60))
    for k in range(2):
        rows[4000 + k] = ", ".join(rng.sample(goods, 60))
    got = {r.doc_id for r in spam.spam_pages(spark.createDataFrame(list(rows.items()), DOCS)).collect()}
    assert {4000, 4001} <= got and not got & set(fine)


def test_keyword_pages_written_like_sentences(spark):
    """Some pages are of keywords in short sentences, whose perplexity lies between the two tails."""
    rng = random.Random(11)
    _, fine = _pages()
    one = lambda: " ".join(rng.choice([GOODS[0], rng.choice(DEALS)]) for _ in range(rng.randint(2, 4))).capitalize() + rng.choice(".!?")
    bad = {6000 + k: " ".join(one() for _ in range(50)) for k in range(60)}
    texts = spark.createDataFrame([*fine.items(), *bad.items()], DOCS)
    trained, limits = spam.prose_model(texts)
    kept = spam.abnormal_pages(texts, spark.sparkContext.broadcast(trained), limits, spam.PAGE)
    t = spam.Tokens([*fine.values(), *bad.values()])
    mean = trained.perplexity(t, t.classes(trained.vocabulary))
    ids = np.array([*fine, *bad])
    assert set(ids[spam.share(t, spam.beyond(mean, limits)) >= spam.PAGE].tolist()) == {r.doc_id for r in kept.collect()} >= set(bad)
    assert set(bad) <= {r.doc_id for r in spam.spam_pages(texts).collect()}


def test_model_against_plain_counts():
    """Bits of a trigram model against the formula, for texts of few classes."""
    rng = np.random.default_rng(1)
    c, doc = rng.integers(0, 9, 4000), np.repeat([0, 1], 2000)
    before, both = spam._contexts(c, doc)
    keys, n = np.unique(both * spam._CLASSES + c, return_counts=True)
    count = lambda x, size: np.bincount(x, minlength=size)
    single = count(c, spam._CLASSES)
    model = spam.Model(None, single, count(before * spam._CLASSES + c, (spam._CLASSES + 1) * spam._CLASSES), count(both, (spam._CLASSES + 1) ** 2), keys[::2], n[::2])
    got = model.bits(c, doc)
    kept = dict(zip(keys[::2].tolist(), n[::2].tolist(), strict=True))
    one = (single + 0.5) / (single.sum() + 0.5 * len(single))
    for i in (0, 1, 2, 17, 1999, 2000, 2001, 3999):
        a = before[i]
        two = (((before == a) & (c == c[i])).sum() + 5 * one[c[i]]) / ((before == a).sum() + 5)
        p = (kept.get(int(both[i] * spam._CLASSES + c[i]), 0) + 5 * two) / ((both == both[i]).sum() + 5)
        assert got[i] == pytest.approx(max(0, -np.log2(p)), rel=1e-5)


def test_calls_and_openings_are_no_keywords():
    text = " ".join(f"I shall be brief. a {ADJECTIVES[i % 10]} veto {VERBS[i % 7]} this {NOUNS[i % 12]}." for i in range(9)) + " Cheap lamp. " * 9
    t = spam.Tokens([text])
    vocabulary = spam.Vocabulary(np.array([spam._hash_of(w) for w in ("i", "a", "be", "shall", "this")], np.uint64), np.array([9, 9, 9, 9, 9]))
    got = spam.calls(t, t.classes(vocabulary))
    words = {int(h) for h in t.hash[got]}
    assert spam._hash_of("brief") in words and spam._hash_of("lamp") not in words and spam._hash_of("veto") not in words


def test_many_keywords_on_a_long_page():
    """50 keywords of 40 times each have 2 % of the page each, and all of it together."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(50)] * 40
    rng.shuffle(words)
    t = spam.Tokens([", ".join(words)])
    vocabulary = spam.Vocabulary(np.array([], np.uint64), np.array([], np.int64))
    tags = spam.tagged(t, t.classes(vocabulary), np.ones(len(t.kind), bool), vocabulary)
    assert tags[t.kind == spam.WORD].mean() > 0.95
    t = spam.Tokens([" ".join(f"{w}{i}x" for i, w in enumerate(words))])
    assert not spam.tagged(t, t.classes(vocabulary), np.ones(len(t.kind), bool), vocabulary)[(t.kind == spam.WORD) & ~t.odd].any()


def test_tokens_take_few_bytes_a_character():
    texts = ["abcdefghij" * 100 + " "] * 100
    spam.Tokens(texts)
    tracemalloc.start()
    spam.Tokens(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 46 * 100_000


def test_tokens_of_odd_texts():
    t = spam.Tokens(["iPhone A4 été­x co­op.", "", "aB漢字 \U0001d400b x2 B2B.\nwww.AbC.de/x1 end", "#Tag exam-\nple Go!"])
    assert t.odd.nonzero()[0].tolist() == [0, 1, 7, 8, 9]
    assert t.size.tolist() == [6, 2, 5, 5, 1, 0, 0, 3, 2, 3, 1, 0, 13, 3, 0, 1, 3, 8, 2, 1, 0]
    assert t.solid.tolist() == [19, 0, 25, 15]
    assert t.doc.tolist() == [0] * 6 + [1] + [2] * 8 + [3] * 6
    assert t.sentence.tolist() == [0] * 6 + [1] + [2] * 5 + [3] * 3 + [4] * 6
    empty = spam.Tokens([""])
    assert (len(empty.kind), empty.solid.tolist(), empty.doc.tolist()) == (1, [0], [0])
