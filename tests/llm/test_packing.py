"""Best-fit layout of items."""

from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import packing

TUPLES = "tuple_id bigint, job_id bigint, stream_id int, key_length bigint, value_length bigint"


def _brute(sizes, capacity, sources, clusters):
    bins, out = [], []
    for s, a, c in zip(sizes, sources, clusters, strict=True):
        fits = [(left, i) for i, (left, sa, sc) in enumerate(bins) if left >= s and (a < 0 or a not in sa) and (c < 0 or c not in sc)]
        if fits:
            left, i = min(fits)
        else:
            bins.append((capacity, set(), set()))
            left, i = capacity, len(bins) - 1
        bins[i] = (left - s, bins[i][1] | {a}, bins[i][2] | {c})
        out.append(i)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(-1, 2), st.integers(-1, 3)), min_size=1, max_size=40), st.booleans())
def test_same_as_trying_every_bin(items, ordered):
    items = sorted(items, reverse=True) if ordered else items
    sizes, sources, clusters = map(list, zip(*items, strict=True))
    assert packing.best_fit(sizes, 20, sources, clusters) == _brute(sizes, 20, sources, clusters)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(-1, 2), st.integers(-1, 3)), min_size=1, max_size=40))
def test_conflicts_that_give_way_cost_no_bin(items):
    sizes, sources, clusters = map(list, zip(*sorted(items, reverse=True), strict=True))
    bins = packing.best_fit(sizes, 20, sources, clusters, strict=False)
    left: dict[int, int] = {}
    for s, b in zip(sizes, bins, strict=True):
        assert b in left or all(x < s for x in left.values())  # a bin is opened only if none fits
        left[b] = left.get(b, 20) - s
        assert left[b] >= 0


def test_one_source_in_all_bins_isnt_searched_for():
    n = 20_000
    assert packing.best_fit([1] * n, 2, [0] * n) == list(range(n))


def test_decreasing_best_fit_is_near_the_bound():
    import random

    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 400) for _ in range(3000)), reverse=True)
    assert max(packing.best_fit(sizes, 1000)) + 1 <= -(-sum(sizes) // 1000) + 1


def _jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id bigint, buffer_capacity bigint")


def test_layout_is_valid(spark, sf_dir):
    kv, jobs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("kv_tuple", "job_info"))
    rows = packing.pack_tuples(kv, jobs, shard_items=100).collect()
    fill, ids = Counter(), defaultdict(list)
    for r in rows:
        ids[r.tuple_id].append(r)
        if r.part_bytes is not None:
            assert 0 < r.part_bytes <= r.capacity
            fill[(r.job_id, r.shard, r.buffer_no)] += r.part_bytes
            assert fill[(r.job_id, r.shard, r.buffer_no)] <= r.capacity
    assert set(ids) == {r.tuple_id for r in kv.select("tuple_id").distinct().collect()}
    for parts in ids.values():
        assert sorted(p.part_no for p in parts) == list(range(len(parts)))
        if parts[0].part_bytes is not None:
            assert sum(p.part_bytes for p in parts) == parts[0].tuple_bytes
            assert (len(parts) > 1) == (parts[0].tuple_bytes > parts[0].capacity)
    assert len({r.shard for r in rows if r.shard is not None}) > 1


def test_odd_rows(spark):
    rows = [(1, 1, 0, 2, 90), (1, 1, 0, 2, 90), (2, 1, 0, 0, 0), (3, 1, 0, None, 5), (4, 1, 0, 5, None), (5, 9, 0, 1, 1), (6, None, 0, 1, 1), (7, 1, 0, 12, 280), (8, 1, 0, 100, 192), (9, 2, 0, 1, 1), (None, 1, 0, 1, 1), (10, 1, 0, -3, 5)]
    got = packing.pack_tuples(spark.createDataFrame(rows, TUPLES).selectExpr("*", "1 as shard", "2 as capacity"), _jobs(spark, [(1, 100), (2, 0), (3, 5)])).collect()
    by = defaultdict(list)
    for r in got:
        by[r.tuple_id].append(r.part_bytes)
    assert {k: sorted(v, key=str) for k, v in by.items()} == {1: [100], 2: [8], 3: [None], 4: [None], 5: [None], 6: [None], 7: [100, 100, 100], 8: [100, 100, 100], 9: [None], 10: [None]}
    packed = packing.pack_tuples(spark.createDataFrame(rows, TUPLES), _jobs(spark, [(1, 100)]))
    assert sorted(r[0] for r in packing.split_tuples(packed).collect()) == [7, 8]
    assert packing.pack_tuples(spark.createDataFrame([], TUPLES), _jobs(spark, [])).count() == 0


def test_rows_without_a_job_are_cut_into_shards(spark):
    rows = [(i, None, 0, 1, 1) for i in range(1000)]
    packed = packing.pack_tuples(spark.createDataFrame(rows, TUPLES), _jobs(spark, [(1, 100)]), shard_items=100)
    assert packed.count() == 1000 and packed.where("part_bytes is null and buffer_no is null").count() == 1000


def test_conflicts_are_kept_apart(spark):
    rows = [(i, 1, i % 5, 1, 1) for i in range(60)]
    got = packing.pack_tuples(spark.createDataFrame(rows, TUPLES), _jobs(spark, [(1, 1000)]), source=F.col("stream_id")).collect()
    per = defaultdict(list)
    for r in got:
        per[(r.shard, r.buffer_no)].append(r.tuple_id % 5)
    assert all(len(v) == len(set(v)) for v in per.values()) and len(per) == 12
    alone = packing.pack_tuples(spark.createDataFrame(rows, TUPLES), _jobs(spark, [(1, 1000)])).select("buffer_no").distinct().count()
    assert alone == 1
