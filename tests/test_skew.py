"""Aggregates where a few keys hold most rows, and lookups of unknown size."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import lookup, skew

SCHEMA = "buffer_id bigint, job_id bigint, partition_id bigint, buffer_length bigint"


def test_counts_each_buffer_once(spark):
    rows = [(1, 1, 1, 10), (1, 1, 1, 10), (2, 1, 1, None), (3, 1, None, 5), (4, None, 1, 0), (None, 1, 1, 99), (None, 1, 1, 99)]
    got = {tuple(r) for r in skew.partition_stats(spark.createDataFrame(rows, SCHEMA)).select("job_id", "partition_id", "buffers", "known", "bytes", "least", "most").collect()}
    assert got == {(1, 1, 2, 1, 10, 10, 10), (1, None, 1, 1, 5, 5, 5), (None, 1, 1, 1, 0, 0, 0)}


def test_fifth_counts_exactly(spark):
    rows = [(i, 1, 0 if i < 20 else i, 1) for i in range(100)] + [(1000 + i, 2, 0 if i < 19 else i, 1) for i in range(100)] + [(2000 + i, 1, None, 1) for i in range(500)]
    assert [tuple(r) for r in skew.heavy_partitions(skew.partition_stats(spark.createDataFrame(rows, SCHEMA))).collect()] == [(1, 0)]


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert skew.heavy_partitions(skew.partition_stats(empty)).count() == 0
    clash = spark.createDataFrame([(1, 1, 1, 1)], SCHEMA).selectExpr("*", "7 as bytes", "8 as total", "9 as buffers")
    assert skew.partition_stats(clash).first()["bytes"] == 1


def test_hot_key_is_combined_before_the_shuffle(spark):
    df = spark.range(0, 100_000, 1, 8).select(F.lit(1).alias("k"), "id")
    plan = skew.skew_aggregate(df, ["k"], [F.sum("id").alias("s")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange")  # printed from the top: the partial sum is below the exchange
    with pytest.raises(ValueError):
        skew.skew_aggregate(df, ["k"], [F.collect_list("id")])


@pytest.mark.parametrize("limit", [100, 2])
def test_lookup_join_both_ways(spark, limit):
    big = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4), (9, 5)], "k bigint, id bigint")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k bigint, name string")
    got = sorted((r.id, r.name) for r in lookup.lookup_join(big, small, ["k"], F.col("id"), broadcast_rows=limit).collect())
    assert got == [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)]
