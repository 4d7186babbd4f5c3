"""Fixed-size samples: size, distinctness and uniformity."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import sampling
from millrace.llm.sampling import GeometricFile, fixed_size_sample, hypergeometric

SCHEMA = "key_id bigint, job_id bigint, key_ptr binary"


def _file_sample(n: int, size: int, buffer: int, seed: int, piece: int = 37) -> list[int]:
    f, segments = GeometricFile(size, buffer, seed), {}
    for a in range(0, n, piece):
        for number, rows in f.add(pa.RecordBatch.from_pydict({"x": list(range(a, min(n, a + piece)))})):
            segments[number] = rows.column(0).to_pylist()
    if f.held:
        number, rows = f.flush()
        segments[number] = rows.column(0).to_pylist()
    return [x for i, live in enumerate(f.live) for x in segments[i][:live]]


@pytest.mark.parametrize(("n", "size", "buffer"), [(0, 5, 2), (3, 5, 2), (5, 5, 5), (200, 20, 4), (200, 20, 100), (200, 1, 1)])
def test_geometric_file_keeps_distinct_rows(n, size, buffer):
    got = _file_sample(n, size, buffer, 1)
    assert len(got) == len(set(got)) == min(n, size)


def test_geometric_file_is_uniform_and_its_segments_shrink():
    n, size, runs = 60, 12, 6000
    counts = np.zeros(n)
    for seed in range(runs):
        counts[_file_sample(n, size, 3, seed)] += 1
    expected = runs * size / n
    assert ((counts - expected) ** 2 / (expected * (1 - size / n))).sum() < 105  # chi square, 60 degrees, p = 0.0003
    f = GeometricFile(1000, 100, 1)
    for _ in f.add(pa.RecordBatch.from_pydict({"x": list(range(20_000))})):
        pass
    assert sum(f.live) <= 1000 and np.mean(f.live[-5:]) > 2 * np.mean(f.live[:5])


def test_hypergeometric_mean():
    rng, counts = random.Random(1), np.array([10, 0, 30, 60])
    drawn = np.array([hypergeometric(counts, 20, rng) for _ in range(3000)])
    assert (drawn.sum(1) == 20).all() and (drawn <= counts).all()
    assert np.abs(drawn.mean(0) - [2, 0, 6, 12]).max() < 0.2
    assert hypergeometric(np.array([10**15, 3 * 10**15]), 1000, rng).sum() == 1000
    assert hypergeometric(counts, 500, rng).tolist() == counts.tolist()


def test_every_job_and_copies_once(spark):
    rows = [(i, 1, b"x") for i in range(500)] * 2 + [(1000 + i, 2, None) for i in range(7)] + [(None, 1, b"n")] * 5 + [(5000, None, b"j")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as population", "2 as take")
    got = fixed_size_sample(df, 50, "key_id", "job_id", ["key_ptr", "take"], buffer=8).collect()
    assert sorted((r.job_id, r.population) for r in got) == [(1, 500)] * 50 + [(2, 7)] * 7
    assert len({r.key_id for r in got}) == 57 and {r.take for r in got} == {2}


def test_keys_are_equally_likely_over_skewed_shards(spark):
    df = spark.range(0, 40).selectExpr("id as key_id", "1L as job_id").cache()
    counts = np.zeros(40)
    for seed in range(60):
        for r in fixed_size_sample(df, 10, "key_id", "job_id", [], buffer=3, seed=seed, shards=3).collect():
            counts[r.key_id] += 1
    assert counts.sum() == 600 and ((counts - 15) ** 2 / (15 * 0.75)).sum() < 80  # chi square, 39 degrees, p = 0.0001


def test_same_seed_same_sample_and_empty(spark):
    df = spark.range(0, 300).selectExpr("id as key_id", "id % 2 as job_id")
    one, two = ({r.key_id for r in fixed_size_sample(df, 20, "key_id", "job_id", [], seed=5).collect()} for _ in range(2))
    assert one == two
    assert fixed_size_sample(spark.createDataFrame([], SCHEMA), 5, "key_id", "job_id", ["key_ptr"]).count() == 0
    with pytest.raises(ValueError):
        fixed_size_sample(df, 0, "key_id", "job_id", [])


def test_files_grow_with_the_rows_and_not_with_groups_times_tasks(spark, monkeypatch):
    logs, written = {}, sampling.written
    monkeypatch.setattr(sampling, "written", lambda df, name: logs.setdefault(name, written(df, name)))
    df = spark.range(0, 1200).selectExpr("id as key_id", "id % 60 as job_id")
    assert fixed_size_sample(df, 5, "key_id", "job_id", [], buffer=128).count() == 300
    assert logs["geometric-file"].where("__live is not null").select("__g", "__shard").distinct().count() == 60


def test_large_groups_are_spread_over_shards(spark, monkeypatch):
    logs, written = {}, sampling.written
    monkeypatch.setattr(sampling, "written", lambda df, name: logs.setdefault(name, written(df, name)))
    monkeypatch.setattr(sampling, "SHARD_ROWS", 100)
    df = spark.range(0, 1000).selectExpr("id as key_id", "if(id < 950, 1L, id) as job_id")
    got = fixed_size_sample(df.union(df), 5, "key_id", "job_id", [], buffer=2).collect()
    assert sorted((r.job_id, r.population) for r in got) == [(1, 950)] * 5 + [(i, 1) for i in range(950, 1000)]
    assert {r.job_id: r.n for r in logs["geometric-file"].groupBy("__g").agg({"__shard": "max"}).toDF("job_id", "n").where("n > 0").collect()} == {1: 18}


def test_sample_is_the_same_whatever_the_partitions(spark):
    df, found, before = spark.range(0, 400).selectExpr("id as key_id", "id % 3 as job_id"), [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("3", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append({r.key_id for r in fixed_size_sample(df, 10, "key_id", "job_id", [], buffer=4).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
