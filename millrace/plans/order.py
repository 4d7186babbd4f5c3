"""Queries over orders, partitions and samples of the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import hashed_key
from millrace.operators import partitioning as parts
from millrace.operators import sorting
from millrace.sources import kv
from millrace.tables import shared_folder, table

PARTITIONS, NODES = 16, 4


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a text key of twelve digits and their size in bytes."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"), "o_custkey", (F.length("o_orderpriority") + F.length("o_orderstatus") + 20).alias("bytes"))


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.range_boundaries(_keys(spark, sf_dir), "key", "bytes", PARTITIONS)


def _list(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r["key"] for r in _boundaries(spark, sf_dir).orderBy("index").collect()]


def total_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders sorted, with their place."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return parts.numbered(o, ["o_totalprice", "o_orderkey"], "place")


def secondary_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer by time, each with the one before."""
    o = sorting.secondary_sort(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate")
    return o.selectExpr("o_custkey", "o_orderkey", "lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before")


def _validated(summary: DataFrame) -> DataFrame:
    return summary.select("first_unordered", "unordered", "records", "duplicates", F.col("checksum").cast("bigint").alias("checksum"))


def sort_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are orders, in the order of their keys, sorted by customer? They aren't."""
    return _validated(sorting.validate(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", ["o_orderkey", "o_custkey"])).drop("checksum")


def sort_validate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the sorted table, from summaries of parts; and whether it has the checksum of the table as it was."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    rows = parts.numbered(orders, ["o_custkey", "o_orderkey"])
    done = _validated(sorting.merge_summaries(sorting.summarise(rows, "nr", "o_custkey", ["o_orderkey", "o_custkey"], 7)))
    before = sorting.checksum_by_partition(orders, ["o_orderkey", "o_custkey"]).agg(F.sum("checksum").alias("before"))
    return done.crossJoin(before).withColumn("kept", F.col("checksum") == F.col("before")).drop("checksum", "before")  # a row each


def gen_sort_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many records as orders, skewed: their lengths, and whether a few prefixes of a byte hold more than half of them."""
    n = table(spark, sf_dir, "orders").count()
    r = sorting.sort_records(spark, n, skewed=True)
    heads = r.groupBy(F.substring("key", 1, 1).alias("head")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.octet_length("key") + F.octet_length("payload")).cast("bigint")).alias("bytes"), F.sum((F.octet_length("key") == 10).cast("bigint")).alias("keys"))
    common = F.sum(F.when(F.col("n") * 32 > F.lit(n), F.col("n")).otherwise(0)) * 2 > F.sum("n")
    return heads.agg(F.sum("n").alias("records"), F.sum("keys").alias("keys"), F.sum("bytes").alias("bytes"), common.alias("skewed"))


def top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.top_percent(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 5, ["o_orderkey"])


def completion_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the time of their last order."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("done"))
    return sorting.completion_rank(last, "o_custkey", "done", ["o_custkey"])


def range_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boundaries(spark, sf_dir)


def range_partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(spark, sf_dir).withColumn("partition", parts.partition_of(F.col("key"), _list(spark, sf_dir)))
    return rows.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))


def median_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of four nodes cuts its part of the orders; the median of what they chose."""
    rows = _keys(spark, sf_dir)
    chosen = None
    for node in range(NODES):
        own = parts.range_boundaries(rows.where(F.col("o_custkey") % NODES == node), "key", "bytes", PARTITIONS)
        chosen = own if chosen is None else chosen.unionAll(own)
    return parts.median_boundaries(chosen, "index", "key")


def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of partitions 2 to 4 and of the last one."""
    b = _list(spark, sf_dir)
    ranges = [parts.partition_ranges(b, 2, 4), parts.partition_ranges(b, len(b) - 1, len(b) - 1)]
    return _keys(spark, sf_dir).where(parts.range_filter(F.col("key"), ranges)).select("key", "o_custkey")


def uniform_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(parts.uniform_partition(F.col("p_name"), PARTITIONS).alias("partition")).agg(F.count(F.lit(1)).alias("cnt"))


def hash_partition_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are orders, cut by boundaries of their keys' hashes, in as many parts as asked for, none of which has more than its share and a row?"""
    keys = _keys(spark, sf_dir)
    cut = [r["key"] for r in parts.hashed_boundaries(keys, "key", "bytes", PARTITIONS).orderBy("index").collect()]
    placed = keys.groupBy(parts.partition_of(hashed_key(F.col("key").cast("binary")), cut).alias("partition")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return placed.agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), (F.max("bytes") <= 2 * F.sum("bytes") / PARTITIONS + 64).alias("even"))


def merge_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of both kinds of partner, into one file."""
    c, s = (table(spark, sf_dir, t).select(F.col(f"{k}_name").alias("name"), F.col(f"{k}_nationkey").alias("nation")) for t, k in (("customer", "c"), ("supplier", "s")))
    return c.unionByName(s).coalesce(1)


def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 orders: how many there are, and whether all are orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sample = parts.reservoir_sample(orders, ["o_orderkey"], 100)
    known = sample.join(orders.withColumn("known", F.lit(True)), ["o_orderkey", "o_custkey"], "left")
    return known.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("distinct_keys"), F.min(F.coalesce("known", F.lit(False))).alias("known"))


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders from five stretches."""
    return parts.systematic_sample(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.1, 5)


def partition_count_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions per job for partitions of 650 MB on 4 nodes of 8 disks, 3 of them for output, in 2 groups."""
    rows = table(spark, sf_dir, "job_info").where(F.col("total_input_size").isNotNull())
    return rows.select("job_id", parts.partition_count_of(F.col("total_input_size"), 1.5, 4, 8, 3, 2, 650_000_000).alias("partitions"))


def sample_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the pieces of each job, each piece once."""
    m = table(spark, sf_dir, "sample_metadata").dropDuplicates(["piece_id"])
    return m.groupBy("job_id").agg(F.count(F.lit(1)).alias("pieces"), *[F.sum(c).alias(c) for c in ("tuples_in", "bytes_in", "tuples_out", "bytes_out", "bytes_mapped")])


def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part keys that follow each other within an order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lpad(F.hex("l_partkey"), 16, "0").alias("fragment"))
    return kv.consecutive_pairs(li, "l_orderkey", "l_linenumber", "fragment")


def _written(spark: SparkSession, sf_dir: str, headers: bool) -> str:
    """Customers as key/value files in a fresh folder of the shared one."""
    path = f"{shared_folder(spark)}/kv-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer").select(F.lpad(F.hex("c_custkey"), 16, "0").alias("key"), F.rpad("c_mktsegment", 12, " ").alias("value"))
    kv.write_kv(rows, path, headers)
    return path


def scan_kv_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as framed tuples and read again."""
    return kv.read_framed(spark, _written(spark, sf_dir, True)).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def scan_fixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without headers."""
    return kv.read_fixed(spark, _written(spark, sf_dir, False), 16, 12).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        total_sort, secondary_sort, sort_validate, sort_validate_merge, gen_sort_records, top_percent, completion_rank, range_boundaries, range_partition_sizes, median_boundaries, range_filter,
        uniform_partition, hash_partition_balance, merge_single, reservoir_sample, systematic_sample, partition_count_estimate, sample_metadata, consecutive_pairs, scan_kv_framed, scan_fixed_records,
    )
}

_KEYS = "select lpad(o_orderkey::varchar, 12, '0') as key, o_custkey, length(o_orderpriority) + length(o_orderstatus) + 20 as bytes from orders"


def _cut(rows: str) -> str:
    """Boundaries of a table: a row is one if the weight before it exceeds a multiple that the weight before the row before it doesn't."""
    return f"""
  select g as grp, passed - 1 as index, min(key) as key from (
    select g, key, case when b <= 0 then 0 when b <= rest * (size + 1) then ceil(b / (size + 1)) else rest + ceil((b - rest * (size + 1)) / size) end::bigint as passed
    from (select *, total // {PARTITIONS} as size, total % {PARTITIONS} as rest from (
      select *, coalesce(sum(bytes) over (partition by g order by key rows between unbounded preceding and 1 preceding), 0) as b, sum(bytes) over (partition by g) as total from ({rows}))))
  where passed > 0 group by g, passed"""


_CUT = f"with k as ({_KEYS}), b as ({_cut('select *, 0 as g from k')})"
_PARTITIONED = _CUT + ", r as (select k.*, greatest((select count(*) from b where b.key <= k.key) - 1, 0) as p from k)"

SQL = {
    "total_sort": "select o_orderkey, o_totalprice, o_orderdate, row_number() over (order by o_totalprice, o_orderkey) as place from orders",
    "secondary_sort": "select o_custkey, o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders",
    "sort_validate": """
with o as (select o_custkey, row_number() over (order by o_orderkey) - 1 as n, lag(o_custkey) over (order by o_orderkey) as before from orders)
select coalesce(min(n) filter (o_custkey < before), 0) as first_unordered, count(*) filter (o_custkey < before) as unordered, count(*) as records, count(*) filter (o_custkey = before) as duplicates from o""",
    "sort_validate_merge": "select 0::bigint as first_unordered, 0::bigint as unordered, count(*) as records, count(*) - count(distinct o_custkey) as duplicates, true as kept from orders",
    "gen_sort_records": "select count(*) as records, count(*) as keys, cast(count(*) * 100 as bigint) as bytes, true as skewed from orders",
    "hash_partition_balance": f"with k as ({_KEYS}) select {PARTITIONS}::bigint as parts, count(*) as rows, cast(sum(bytes) as bigint) as bytes, true as even from k",
    "reservoir_sample": "select least(100, count(*)) as n, least(100, count(*)) as distinct_keys, true as known from orders",
    "top_percent": "select o_orderkey, o_totalprice from (select *, row_number() over (order by o_totalprice desc, o_orderkey) as n from orders) where n <= (select count(*) * 5 // 100 from orders)",
    "completion_rank": "select o_custkey, done, row_number() over (order by done, o_custkey) - 1 as rank from (select o_custkey, max(o_orderdate) as done from orders group by 1)",
    "range_boundaries": _CUT + " select cast(index as integer) as index, key from b",
    "range_partition_sizes": _PARTITIONED + " select cast(p as integer) as partition, count(*) as rows, cast(sum(bytes) as bigint) as bytes from r group by p",
    "median_boundaries": f"with k as ({_KEYS}), b as ({_cut(f'select *, o_custkey % {NODES} as g from k')}) select cast(index as integer) as index, list_sort(list(key))[(count(*) - 1) // 2 + 1] as key from b group by index",
    "range_filter": _PARTITIONED + " select key, o_custkey from r where key >= (select min(key) from b) and (p between 2 and 4 or p = (select max(index) from b))",
    "uniform_partition": f"""
select cast(case when strlen(p_name) >= 3 then ((ascii(substr(p_name, 1, 1)) * 65536 + ascii(substr(p_name, 2, 1)) * 256 + ascii(substr(p_name, 3, 1))) * {PARTITIONS}) >> 24 end as integer) as partition, count(*) as cnt
from part group by 1""",
    "merge_single": "select c_name as name, c_nationkey as nation from customer union all select s_name, s_nationkey from supplier",
    "systematic_sample": """
select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as n, count(*) over () as total from orders)
where n // (total // 5) < 5 and n % (total // 5) < cast(floor(total * 0.1 / 5) as bigint)""",
    "partition_count_estimate": "select job_id, cast(ceil(greatest(ceil((cast(floor(total_input_size * 1.5::double) as bigint) // 32) / 650e6), 1) * 8 / 24) * 24 * 4 as bigint) as partitions from job_info where total_input_size is not null",
    "sample_metadata": """
with m as (select piece_id, any_value(job_id) as job_id, any_value(tuples_in) as tuples_in, any_value(bytes_in) as bytes_in, any_value(tuples_out) as tuples_out, any_value(bytes_out) as bytes_out, any_value(bytes_mapped) as bytes_mapped from sample_metadata group by piece_id)
select job_id, count(*) as pieces, cast(sum(tuples_in) as bigint) as tuples_in, cast(sum(bytes_in) as bigint) as bytes_in, cast(sum(tuples_out) as bigint) as tuples_out, cast(sum(bytes_out) as bigint) as bytes_out, cast(sum(bytes_mapped) as bigint) as bytes_mapped from m group by job_id""",
    "consecutive_pairs": """
with f as (select l_orderkey, l_linenumber, printf('%016X', l_partkey) as fragment from lineitem)
select * from (select l_orderkey, l_linenumber, fragment || lead(fragment) over (partition by l_orderkey order by l_linenumber, fragment) as key from f) where key is not null""",
    "scan_kv_framed": "select printf('%016X', c_custkey) as key, rpad(c_mktsegment, 12, ' ') as value from customer",
    "scan_fixed_records": "select printf('%016X', c_custkey) as key, rpad(c_mktsegment, 12, ' ') as value from customer",
}
