"""Numbers, sums and boundaries over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import partitioning as parts
from millrace.operators import sorting, stats
from millrace.plans import order
from tests import oracle


@pytest.fixture()
def apart(spark):
    """Partitions stay apart, as those of large tables do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _rows(spark, n=3000, nulls=True):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50) if not nulls or i % 17 else None, f"x{i}", rng.randint(0, 9) if i % 11 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, k int, text string, w int").repartition(7)


def test_numbers_have_no_gaps_whatever_the_columns(apart):
    got = parts.numbered(_rows(apart), ["k", "id"]).collect()
    assert sorted(r.nr for r in got) == list(range(1, 3001))
    by = sorted(got, key=lambda r: r.nr)
    assert [r.id for r in by] == [r.id for r in sorted(got, key=lambda r: (r.k is not None, r.k or 0, r.id))]
    assert all(r.text == f"x{r.id}" for r in got)
    down = parts.numbered(_rows(apart), [F.col("k").desc(), "id"]).where("nr = 1").first()
    assert down.k == 50


def test_running_sums(apart):
    got = sorted(parts.running_sum(_rows(apart), ["k", "id"], "w", "before").collect(), key=lambda r: (r.k is not None, r.k or 0, r.id))
    held = 0
    for r in got:
        assert r.before == held
        held += r.w or 0
    assert parts.running_sum(_rows(apart).where("id < 0"), ["k"], "w", "before").count() == 0
    assert parts.numbered(_rows(apart).where("id < 0"), ["k"]).count() == 0


@pytest.mark.parametrize("name", ["total_sort", "completion_rank", "systematic_sample", "range_boundaries", "range_partition_sizes", "median_boundaries", "range_filter", "top_percent", "sort_validate"])
def test_queries_with_partitions_apart(apart, sf_dir, name):
    if name in order.SQL:
        assert oracle.rows_of(order.QUERIES[name](apart, sf_dir)) == oracle.sql_rows(oracle.connect(sf_dir), order.SQL[name])


def test_medians_of_skewed_and_null_keys(apart):
    rows = _rows(apart).withColumn("g", F.expr("case when id % 3 > 0 then 'hot' when id % 6 = 0 then null else 'cold' end"))
    got = {r.g: r.median for r in stats.upper_median(rows, ["g"], "w").collect()}
    values = {}
    for r in rows.collect():
        if r.w is not None:
            values.setdefault(r.g, []).append(r.w)
    assert got == {g: sorted(v)[len(v) // 2] for g, v in values.items()}
    shares = stats.cdf(rows, ["g"], "w").collect()
    assert {(r.g, r.value): round(r.share, 9) for r in shares} == {(g, x): round(sum(y <= x for y in v) / len(v), 9) for g, v in values.items() for x in set(v)}


def test_variance_of_large_values_is_exact(spark):
    v = [10**12 + i for i in range(1000)]
    got = spark.createDataFrame([(x,) for x in v], "v bigint").repartition(5)
    assert got.agg(stats.exact_variance(got, "v").alias("x")).first().x == (1000**2 - 1) / 12
    huge = spark.createDataFrame([((1 << 63) - 1,), (-(1 << 63),)] * 3, "v bigint")
    assert huge.agg(stats.exact_variance(huge, "v").alias("x")).first().x == pytest.approx(2.0**126)


def test_boundaries_with_rows_heavier_than_a_part(apart):
    rows = apart.createDataFrame([(f"{i:03}", 1000 if i == 5 else 1) for i in range(40)], "k string, w int")
    got = [(r["index"], r["key"]) for r in parts.range_boundaries(rows, "k", "w", 8).orderBy("index").collect()]
    assert [i for i, _ in got] == list(range(len(got))) and len({k for _, k in got}) == len(got)
    assert got[0][1] > "000"


BOUNDS = [bytes([b]) * n for b, n in ((1, 3), (10, 2), (35, 1), (50, 5), (100, 2), (101, 2), (120, 4), (130, 1), (180, 2), (200, 1), (220, 80), (255, 1))]


def test_partition_of_a_key_is_that_of_the_last_boundary_not_above_it(spark):
    keys = [b"\x00", b"\x01", b"\x01\x01\x01", b"\x01\x01\x02", b"\x0a", b"\x0a\x0a\x00", b"\x23", b"\xff", b"\xff\xff", b""]
    got = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select(parts.partition_of(F.col("k"), BOUNDS).alias("p")).collect()
    assert [r.p for r in got] == [parts.partition_number(k, BOUNDS) for k in keys] == [0, 0, 0, 0, 0, 1, 2, 11, 11, 0]


def test_range_filter(spark):
    bounds = [bytes([b]) for b in range(1, 11)]
    ranges = [parts.partition_ranges(bounds, 0, 4), parts.partition_ranges(bounds, 6, 8)]
    assert ranges == [(b"\x01", b"\x06"), (b"\x07", b"\x0a")]
    keys = [b"\x03\x01\x02", b"\x08\xff\xff\xff", b"\x09", b"\x06", b"\x0a"]
    got = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select(parts.range_filter(F.col("k"), ranges).alias("x")).collect()
    assert [r.x for r in got] == [True, True, True, False, False]
    assert parts.partition_ranges(bounds, 8, 9) == (b"\x09", None)


def test_partition_count():
    assert parts.partition_count(0, 1.0, 2, 4, 4, 1, 100) == 8
    assert parts.partition_count(10_000, 1.0, 1, 4, 3, 2, 100) == 108


def test_validation_over_parts(apart):
    rows = _rows(apart, nulls=False)
    good = parts.numbered(rows, ["k", "id"], "nr")
    one = sorting.validate(good, "nr", "k", ["id"]).first()
    assert (one.unordered, one.first_unordered, one.records) == (0, 0, 3000) and one.duplicates == 3000 - rows.select("k").distinct().count()
    bad = sorting.validate(rows, "id", "k", ["id"]).first()
    ks = [r.k for r in rows.orderBy("id").collect()]
    breaks = [i for i in range(1, 3000) if ks[i] < ks[i - 1]]
    assert (bad.unordered, bad.first_unordered, bad.checksum) == (len(breaks), breaks[0], one.checksum)
    assert sorting.validate(rows.where("id < 0"), "id", "k", ["id"]).first().records == 0
