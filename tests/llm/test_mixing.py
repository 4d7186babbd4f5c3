"""Apportionment and mixtures."""

import base64
from collections import defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing

DOCS = "doc_id bigint, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def _one_by_one(weights, seats):
    out = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8).filter(any), st.integers(0, 300))
def test_same_as_awarding_singly(weights, seats):
    assert mixing.sainte_lague(weights, seats).tolist() == _one_by_one(weights, seats)


def test_many_seats_and_none():
    assert mixing.sainte_lague([1, 3], 10**12).tolist() == [25 * 10**10, 75 * 10**10]
    assert mixing.sainte_lague([], 5).tolist() == [] and mixing.sainte_lague([0.0], 5).tolist() == [0]


def test_token_counts_against_plain_bpe(spark):
    with open(mixing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def count(text):
        n = 0
        for piece in regex.findall(mixing.PATTERN, text):
            parts = [bytes([b]) for b in piece.encode()]
            while len(parts) > 1:
                rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if rank == 1 << 40:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            n += len(parts)
        return n

    texts = ["Où est-ce?  The committee's 12 papers\n\n", "", "<|endoftext|> x", "漢字 🎉", "a" * 300]
    got = {r.doc_id: r.tokens for r in mixing.token_counts(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(99, None, None)], DOCS)).collect()}
    assert got == {**{i: count(t) for i, t in enumerate(texts)}, 99: 0}


def _mix(spark, docs, targets, **options):
    uses, report = mixing.mixture(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as tokens", "2 as uses"), spark.createDataFrame(targets, TARGETS), **options)
    return {r.doc_id: (r.source, r.tokens, r.uses) for r in uses.collect()}, {r.source: r for r in report.collect()}


def test_quotas_caps_and_shares(spark):
    docs = [(i, "word " * (20 + i % 30), " Big-One" if i % 2 else "big_one") for i in range(800)] + [(1000 + i, "word " * 40, "small") for i in range(50)] + [(2000 + i, "word " * 40, "tiny") for i in range(3)] + [(3000 + i, "word " * 30, None) for i in range(40)]
    targets = [("big_one", 0.5, 1), ("small", 0.2, 4), ("tiny", 0.2, 5), ("absent", 0.1, 9)]
    uses, report = _mix(spark, docs, targets, block_tokens=64, shard_tokens=4000)
    total = sum(r.tokens for r in report.values()) + 40 * 31
    repeats = {t[0]: t[2] for t in targets}
    used = defaultdict(int)
    for source, tokens, n in uses.values():
        assert 1 <= n <= repeats[source]
        used[source] += tokens * n
    for s, r in report.items():
        assert r.used_tokens == used[s]
    assert abs(used["big_one"] - 0.5 * total) < 0.02 * total
    assert abs(used["small"] - min(0.2 * total, 4 * report["small"].tokens)) < 0.02 * total
    assert used["tiny"] == 5 * report["tiny"].tokens and used["absent"] == 0  # too little to go round
    assert sum(r.share for r in report.values()) == pytest.approx(1)


def test_seed_changes_the_choice_but_not_the_quota(spark):
    docs = [(i, "word " * 25, "a" if i < 200 else "b") for i in range(400)]
    one, two = (_mix(spark, docs, [("a", 0.2, 1), ("b", 0.2, 1)], block_tokens=64, seed=s)[0] for s in (1, 2))
    again = _mix(spark, docs, [("a", 0.2, 1), ("b", 0.2, 1)], block_tokens=64, seed=1)[0]
    assert one == again and set(one) != set(two) and abs(len(one) - len(two)) <= 2


def test_odd_tables(spark):
    uses, report = _mix(spark, [], [("a", 1.0, 2)])
    assert uses == {} and report["a"].used_tokens == 0 and report["a"].share == 0
    uses, report = _mix(spark, [(1, None, "a"), (2, "", "a"), (None, "x y z", "a"), (3, "word " * 200_000, "a")], [("a", 1.0, None), (None, 0.5, 1)])
    assert uses == {} and report["a"].tokens == 200_001 or report["a"].tokens >= 200_000
    uses, _ = _mix(spark, [(3, "word " * 50_000, "a")], [("a", 1.0, 1)])
    assert uses[3][2] == 1
    assert _mix(spark, [(1, "x", "a")], [])[1] == {}


def test_blocks_and_the_rest_fill_the_quota():
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 900, 3000)
    for quota in (0, 1, 500, 4096, 40_000, 600_000, int(tokens.sum()), int(tokens.sum()) + 9):
        got = mixing.chosen(tokens, quota, 4096)
        assert abs(int(tokens[got].sum()) - min(quota, int(tokens.sum()))) <= 1
        prefix = int(np.argmin(got)) if not got.all() else len(got)
        assert tokens[:prefix].sum() > quota - 2 * 4096 - 900 or got.all()
    # a long record at the border is left out, and what it leaves is filled
    got = mixing.chosen(np.array([3000, 3000, 60_000, 500, 700, 800, 900]), 8000, 4096)
    assert got.tolist() == [True, True, False, True, True, True, False] or got[:2].all() and not got[2]
    assert not mixing.chosen(np.array([], np.int64), 10, 5).any() and mixing.chosen(np.array([10]), 6, 4).all() and not mixing.chosen(np.array([13]), 6, 4).any()
