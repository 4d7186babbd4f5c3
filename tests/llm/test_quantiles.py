"""Summaries of ranks: bounds, merging, and percentiles."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import quantiles as q


def _bounds_hold(s, values):
    v, low, high = s
    ordered = np.sort(values)
    first, last = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
    assert int(high[-1]) == len(values) and v[0] == ordered[0] and v[-1] == ordered[-1]
    assert (low <= last).all() and (high >= first).all() and (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=120), min_size=1, max_size=6), st.floats(0.01, 0.2))
def test_merged_and_compressed_bounds_hold(parts, epsilon):
    summaries = [q.compress(q.exact(np.array(p)), epsilon / 2 * len(p)) for p in parts]
    for s, p in zip(summaries, parts, strict=True):
        _bounds_hold(s, np.array(p))
    whole, values = summaries[0], parts[0]
    for s, p in zip(summaries[1:], parts[1:], strict=True):
        whole, values = q.merge(whole, s), values + p
        whole = q.compress(whole, epsilon * len(values))
    _bounds_hold(whole, np.array(values))
    ordered = np.sort(values)
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        v, _, _, off = q.find(whole, share)
        assert off <= max(1, math.ceil(epsilon * len(values)))
        r = max(1, math.ceil(share * len(values) - 1e-9))
        assert ordered[max(0, r - 1 - off)] <= v <= ordered[min(len(values) - 1, r - 1 + off)]


def test_compression_is_small():
    s = q.compress(q.exact(np.random.default_rng(1).integers(0, 10**9, 200_000)), 0.001 * 200_000)
    assert len(s[0]) < 1100


def _lines(spark, rows):
    return spark.createDataFrame(rows, "line_id bigint, stage_name string, stat_name string, hostname string, logged_at timestamp_ntz, uint_value bigint")


def test_spelling_copies_and_nulls(spark):
    rows = [(1, " Sorter", "bytes-in", "A1.x.y", None, 5), (1, " Sorter", "bytes-in", "A1.x.y", None, 5), (2, "sorter", "bytes_in", "a1", None, 7), (3, "sorter", "bytes_in", None, None, 1), (4, "sorter", "bytes_in", "a1", None, None), (5, "sorter", "bytes_in", "a1", None, -1), (None, "sorter", "bytes_in", "a1", None, 9)]
    got = {(r.stage_name, r.stat_name, r.hostname): (r.n, r.p50, r.rank_error) for r in q.group_percentiles(_lines(spark, rows).selectExpr("*", "1 as v", "2 as n"), {"p50": 0.5}).collect()}
    assert got == {("sorter", "bytes_in", "a1"): (2, 5, 0), ("sorter", "bytes_in", None): (1, 1, 0)}
    assert q.group_percentiles(_lines(spark, []), {"p50": 0.5}).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "long_tailed", "constant", "sorted"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    values = {"uniform": rng.integers(0, 10**6, 30_000), "long_tailed": np.exp(rng.normal(8, 3, 30_000)).astype(int), "constant": np.full(30_000, 4), "sorted": np.arange(30_000)}[kind]
    df = spark.createDataFrame([(int(v), i % 3 == 0) for i, v in enumerate(values)], "x bigint, k boolean").repartition(13)
    parts = q.summarise(df, ["k"], "x", 0.01, block=1000)
    got = q.percentiles(q.merge_summaries(parts, ["k"], 0.01, fan_in=3), ["k"], {"p50": 0.5, "p99": 0.99}).collect()
    for r in got:
        own = np.sort(values[[(i % 3 == 0) == r.k for i in range(len(values))]])
        assert r.n == len(own) and r.rank_error <= 0.01 * r.n
        for name, share in (("p50", 0.5), ("p99", 0.99)):
            at = math.ceil(share * r.n) - 1
            assert own[max(0, at - r.rank_error)] <= r[name] <= own[min(r.n - 1, at + r.rank_error)]


def test_days_merge_to_the_whole(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/stat_line.parquet")
    days = q.daily_summaries(lines)
    whole = q.percentiles(q.merge_summaries(days.drop("day", "node").selectExpr("*", "cast(pmod(hash(hostname), 64) as int) as node"), list(q.KEYS), nodes=64), list(q.KEYS), {"p50": 0.5})
    want = {tuple(r[:5]) for r in q.group_percentiles(lines, {"p50": 0.5}).collect()}
    assert {tuple(r[:5]) for r in whole.collect()} == want


def test_floats_with_nan(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,), (2.5,)], "x double").selectExpr("1 as k", "x")
    assert [tuple(r) for r in q.percentiles(q.merge_summaries(q.summarise(df, ["k"], "x"), ["k"]), ["k"], {"p100": 1.0}).collect()] == [(1, 2, 2.5, 0)]


def test_one_row_per_key_whatever_the_partitions(spark, sf_dir):
    """Also where a shuffle has far more partitions than the session's setting says."""
    stat_line = spark.read.parquet(f"{sf_dir}/stat_line.parquet")
    want = {tuple(r) for r in q.group_percentiles(stat_line, {"p50": 0.5}).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions in ("100", "3"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions)
            rows = q.group_percentiles(stat_line, {"p50": 0.5}).collect()
            assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    wrong = q.merge_summaries(q.summarise(q.measurements(stat_line).repartition(90), ["stat_name"], "uint_value", 0.1), ["stat_name"], 0.1, nodes=2)
    assert wrong.count() == wrong.select("stat_name").distinct().count()
