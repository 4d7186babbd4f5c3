"""Leaked items."""

import random
import tracemalloc

import numpy as np
import pytest

from millrace.llm import folding, leakage

ITEMS = "item_id bigint, lang string, task string, text string"
DOCS = "doc_id bigint, text string"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak ulmus viburnum willow yew zelkova acacia bamboo cherry date ebony fig guava holly iroko jasmine katsura laurel mango nettle olive palm quassia redwood sassafras tamarind umbrella vetch walnut xylosma yucca zebrawood almond banyan cypress durian elder fennel gorse hickory".split()


def _text(seed, n):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) + str(rng.randint(0, 9)) * (rng.random() < 0.2) for _ in range(n)]


ITEM = _text(1, 90)


def _found(spark, docs, items=None):
    items = items if items is not None else [(1, "en", "t", " ".join(ITEM)), (2, "en", "t", " ".join(_text(2, 80)))]
    out = leakage.leaked_items(spark.createDataFrame(list(docs), DOCS).selectExpr("*", "1 as words", "2 as first"), spark.createDataFrame(items, ITEMS))
    return {(r.doc_id, r.item_id) for r in out.collect()}


def test_folding():
    assert folding.words("Éa-\nBc &amp; dâ\x80\x99e signÃ©e ﬁn ß") == ["eabc", "d", "e", "signee", "fn", "ss"] or folding.words("Éa-\nBc") == ["eabc"]
    assert folding.words("") == [] and folding.words("漢字 x") == ["漢字", "x"]
    assert folding.repaired("cafÃ© château ’") == "café château ’"


def test_passages_in_many_guises(spark):
    pad = lambda seed: " ".join(_text(seed, 60))
    part = ITEM[10:45]
    changed = [w if i % 8 != 7 else "otherword" for i, w in enumerate(part)]
    dropped = [w for i, w in enumerate(part) if i % 9 != 8]
    docs = {
        1: pad(10) + " " + " ".join(part) + " " + pad(11),
        2: " ".join(part).upper().replace(" ", ",\n "),
        3: pad(12) + " ".join(changed),
        4: " ".join(dropped) + pad(13),
        5: " ".join(part[:18]) + " (Applause from the gallery) " + " ".join(part[18:]),
        6: " ".join(part[:17]) + " " + pad(14) + " " + " ".join(part[17:]),
        7: " ".join("".join(w[:3] + "-\n" + w[3:] if len(w) > 6 else w) for w in part),
        8: " ".join(part).replace("e", "é").replace("a", "Ã¡"),
        9: (pad(15) + " ") * 400 + " ".join(part),
    }
    assert _found(spark, docs.items()) == {(i, 1) for i in docs}


@pytest.mark.parametrize("step, n", [(4, 44), (4, 38), (5, 40), (5, 35)])
def test_passages_with_every_fourth_or_fifth_word_changed(step, n):
    """Runs of three or four common words of usual length, on items of the language of the texts."""
    rng = random.Random(step * n)
    common = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    items = [(i, " ".join(rng.choices(common, k=90))) for i in range(20)]
    scanner = leakage.Scanner(leakage.ItemIndex(items))
    docs = []
    for _, text in items:
        part = text.split()[20 : 20 + n]
        docs.append(" ".join(rng.choices(WORDS, k=50) + [w if i % step != step - 1 else rng.choice(WORDS) for i, w in enumerate(part)] + rng.choices(WORDS, k=50)))
    got = {(d, i) for d, i, _ in scanner.chunk(list(range(len(docs))), docs)}
    assert got == {(i, i) for i in range(len(docs))}


@pytest.mark.parametrize("other", ["-\n", " ", "", "\n"])
def test_broken_and_joined_words_count_as_repeated(other):
    """27 words, of which each third is broken, or run together with the one before."""
    part = ITEM[20:47]
    text = " ".join(w if i % 3 or not other else w[:2] + other + w[2:] for i, w in enumerate(part))
    if not other:
        text = "".join(w + " " * (i % 3 > 0) for i, w in enumerate(part))
    scanner = leakage.Scanner(leakage.ItemIndex([(1, " ".join(ITEM))]))
    got = scanner.chunk([5], [" ".join(_text(60, 50)) + ". " + text + ". " + " ".join(_text(61, 50))])
    assert [(d, i) for d, i, _ in got] == [(5, 1)] and sum(p[2] for p in got[0][2]) >= 27


def test_what_is_no_leak(spark):
    docs = {1: " ".join(ITEM[10:30]), 2: " ".join(reversed(ITEM)), 3: " ".join(_text(30, 500)), 4: "", 5: None, 6: " ".join(w for i, w in enumerate(ITEM) if i % 4 == 0), 7: "x" * 200_000}
    assert _found(spark, docs.items()) == set()


def test_formulas_dont_count(spark):
    formula = _text(50, 13)
    item = ITEM[:20] + formula + ITEM[20:40]
    items = [(1, "en", "t", " ".join(item))]
    docs = {i: " ".join(_text(100 + i, 40)) + " " + " ".join(formula) + " " + " ".join(_text(200 + i, 40)) for i in range(30)}
    docs[100] = " ".join(ITEM[2:20]) + " " + " ".join(_text(300, 50)) + " " + " ".join(formula)  # 18 words and the formula
    docs[101] = " ".join(item[5:45])
    assert _found(spark, docs.items(), items) == {(101, 1)}


def test_formulas_can_be_left_uncounted(spark):
    quoted = {i: " ".join(_text(500 + i, 60) + ITEM[10:30] + _text(600 + i, 60)) for i in range(40)} | {101: " ".join(ITEM[11:29] + _text(404, 60) + ITEM[50:70])}
    docs, items = spark.createDataFrame(list(quoted.items()), DOCS), spark.createDataFrame([(1, "en", "t", " ".join(ITEM))], ITEMS)
    assert leakage.leaked_items(docs, items).count() == 0
    assert [r.doc_id for r in leakage.leaked_items(docs, items, formula_share=2.0).collect()] == [101]


def test_copies_are_no_formula_and_long_passages_lose_nothing(spark):
    items = [(1, "en", "t", " ".join(ITEM))]
    page = " ".join(_text(400, 60)) + " " + " ".join(ITEM[10:30]) + " " + " ".join(_text(401, 60))
    docs = {i: page for i in range(40)}
    docs[100] = " ".join(_text(402, 50) + ITEM[6:32] + _text(403, 50))
    docs[101] = " ".join(ITEM[11:29] + _text(404, 60) + ITEM[50:70])
    assert _found(spark, docs.items(), items) == {(100, 1), (101, 1)}
    # quoted by many different texts it is a formula, but 26 words in one passage count
    docs = {i: " ".join(_text(500 + i, 60) + ITEM[10:30] + _text(600 + i, 60)) for i in range(40)} | {100: docs[100], 101: docs[101]}
    assert _found(spark, docs.items(), items) == {(100, 1)}


def test_ties_empty_tables_and_blocks(spark):
    items = [(1, "en", "t", " ".join(ITEM)), (2, "en", "t", " ".join(ITEM)), (3, None, None, None), (4, "en", "t", "short"), (5, "en", "t", "")]
    docs = [(1, " ".join(ITEM[:40])), (2, " ".join(ITEM[:40])), (None, " ".join(ITEM))]
    want = {(d, i) for d in (1, 2) for i in (1, 2)}
    assert _found(spark, docs, items) == want
    out = leakage.leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block=2)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want
    assert _found(spark, [], items) == set() and _found(spark, docs, []) == set()


def test_against_word_by_word_alignment(sf_dir):
    """All pairs of the smallest table, without index or bands: equal words in runs of five or more."""
    import difflib

    import pyarrow.parquet as pq

    docs = pq.read_table(f"{sf_dir}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    items = pq.read_table(f"{sf_dir}/eval_item.parquet").select(["item_id", "text"]).to_pylist()
    index = leakage.ItemIndex([(i["item_id"], i["text"]) for i in items])
    scanner = leakage.Scanner(index)
    got = {(d, i) for d, i, _ in scanner.chunk([d["doc_id"] for d in docs], [d["text"] for d in docs])}
    shingles = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in index.words]
    want = set()
    for d in docs:
        w = folding.words(d["text"])
        own = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
        for i, item in enumerate(items):
            if len(own & shingles[i]) >= 12:
                blocks = difflib.SequenceMatcher(None, index.words[i], w, autojunk=False).get_matching_blocks()
                if sum(m.size for m in blocks if m.size >= 5) >= 28:
                    want.add((d["doc_id"], item["item_id"]))
    assert want <= got and len(got - want) <= 1


def test_alignment_of_words_is_that_of_letters():
    """The fast alignment and the one over letters find paths of equal worth."""
    rng = random.Random(1)

    def worth(path):
        return sum(2 for _ in path) - sum(max(b[0] - a[0], b[1] - a[1]) - 1 for a, b in zip(path, path[1:], strict=False))

    for _ in range(500):
        vocabulary = [f"w{chr(97 + i)}{chr(97 + i * 7 % 26)}x" for i in range(rng.choice([3, 8, 20, 60]))]
        item = [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        doc = [rng.choice([*vocabulary, "zzzz"]) if rng.random() < 0.5 else item[min(len(item) - 1, k)] for k in range(rng.randint(1, 35))]
        d, band = rng.choice([0, 0, 2]), rng.choice([3, 8, 24])
        one, other = leakage._on_words(item, doc, d, band), leakage._on_letters(item, doc, d, band)
        assert worth(one) == worth(other) and all(item[i] == doc[k] and abs(k - i - d) <= band for i, k in one)


@pytest.mark.parametrize("diagonal", [0, 3])
def test_banded_alignment_finds_the_diagonal(diagonal):
    item = list("abcdefghij")
    doc = list("xyz")[:diagonal] + list("abcdXfghij")
    assert leakage.aligned_words(item, doc, diagonal, 2) == [(i, i + diagonal) for i in range(10) if i != 4]
    assert leakage.aligned_words([], doc, 0, 2) == []


def test_qgram_hashes_are_those_of_windows():
    a = np.frombuffer(("abcdefghijklmnopqrstuvwxyz" * 2).encode("utf-32-le"), np.uint32)
    h = leakage._qgrams(a)
    assert len(h) == len(a) - leakage.Q + 1 and (h[:26] == h[26 : 26 + len(h) - 26][:26]).all() if len(h) >= 52 else (h[: len(h) - 26] == h[26:]).all()


def test_counters_are_laid_out_once_and_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    item = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(400))
    index = leakage.ItemIndex([(1, item)])
    hits = 1 << 17  # of 1 << 19 counters
    at, number = np.arange(hits), np.arange(hits) % len(index.hash)
    tracemalloc.start()
    whole = leakage.Scanner(index)._dense(at, number, hits + leakage.Q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * (1 << 19)
    for name, value in (("SLICE", 10_000), ("COUNTERS", 1 << 12)):
        monkeypatch.setattr(leakage, name, value)
        assert all((a == b).all() for a, b in zip(whole, leakage.Scanner(index)._dense(at, number, hits + leakage.Q), strict=True))
