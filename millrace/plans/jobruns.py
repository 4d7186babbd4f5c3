"""Queries that run whole jobs of the library, and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import byteorder, paths
from millrace.functions.hashing import hashed_key
from millrace.operators import partitioning as parts
from millrace.operators import stats, text
from millrace.plans import jobs, order, words
from millrace.sources import files, kv
from millrace.sources.text import read_lines
from millrace.tables import shared_folder, table


def _run(spark: SparkSession, job: jobs.Job | list, rows: DataFrame | dict[str, DataFrame]) -> list[DataFrame]:
    """The results of jobs whose sources are these rows, or results of jobs before them."""
    known = rows if isinstance(rows, dict) else {"rows": rows}
    return jobs.run_batches(spark, job, lambda source: known[source] if source in known else spark.read.parquet(source))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders sorted by key into parts of equal size."""
    job = jobs.sort_job("rows", None, "key", "bytes", order.PARTITIONS, ["key"])
    return _run(spark, job, order._keys(spark, sf_dir))[0].select("partition", "key", "o_custkey")


def job_hashed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in parts of equal size by the hash of their key: how many parts there are, and whether each holds what lies between its boundaries and none is twice its share."""
    keys = order._keys(spark, sf_dir)
    job = jobs.Job("rows", partition="hashed_boundaries", params={"hashed_boundaries.key": "key", "hashed_boundaries.weight": "bytes", "hashed_boundaries.partitions": order.PARTITIONS})
    placed = _run(spark, job, keys)[0].withColumn("hash", F.hex(hashed_key(F.col("key").cast("binary"))))
    ranges = placed.groupBy("partition").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    pairs = ranges.alias("a").join(ranges.alias("b"), F.col("a.partition") + 1 == F.col("b.partition"), "left")
    apart = F.coalesce(F.col("a.high") < F.col("b.low"), F.lit(True))
    return pairs.agg(F.count(F.lit(1)).alias("parts"), F.sum("a.n").alias("rows"), F.min(apart).alias("apart"), (F.max("a.bytes") <= 2 * F.sum("a.bytes") / order.PARTITIONS + 64).alias("even"))


def job_fast_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the first bytes of their names."""
    job = jobs.fast_sort_job("rows", None, "p_name", order.PARTITIONS)
    return _run(spark, job, table(spark, sf_dir, "part").select("p_partkey", "p_name"))[0]


def job_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, jobs.word_count_job("rows", None, "doc_id", "text"), table(spark, sf_dir, "documents"))[0]


def job_ngram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, jobs.ngram_count_job("rows", None, "doc_id", "text", 3), table(spark, sf_dir, "documents"))[0]


def job_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, jobs.page_rank_job("rows", None, 3), words._edges(spark, sf_dir))[0].select("id", "degree", F.round("rank", 9).alias("rank"))


def job_click_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = jobs.click_sessions_job("rows", None, "user_id", "ts", "event_type", words.SESSION_US, ["event_id"])
    return _run(spark, job, table(spark, sf_dir, "events"))[0].withColumnRenamed("user", "user_id")


def job_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _run(spark, jobs.link_graph_job("rows", None, "line"), words._pages(spark, sf_dir))[0]
    return built.select(F.col("id").alias("page"), F.size("nbrs").alias("degree"), F.array_join("nbrs", "|").alias("targets"), "rank")


def job_text_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, jobs.text_extraction_job("rows", None, "line"), words._pages(spark, sf_dir))[0]


def job_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, written to many files and merged into one, which is read again."""
    many, one = _fresh(spark, "many"), _fresh(spark, "one")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(5).write.parquet(many)
    return _run(spark, jobs.merge_job(many, one), {})[0].withColumn("files", F.lit(files.list_files(spark, one).where("path like '%.parquet'").count()))


def job_sum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("bigint").alias("quantity"))
    return _run(spark, jobs.sum_values_job("rows", None, "quantity"), rows)[0]


def job_tuple_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = jobs.tuple_lengths_jobs("rows", _fresh(spark, "lengths"), _fresh(spark, "merged"), "c_name", "c_mktsegment")
    return _run(spark, steps, table(spark, sf_dir, "customer"))[1]


def job_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of quantities that follow each other within orders, and come more than once."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lpad(F.hex(F.col("l_quantity").cast("bigint")), 4, "0").alias("fragment"))
    return _run(spark, jobs.duplicates_jobs("rows", _fresh(spark, "pairs"), _fresh(spark, "merged"), "l_orderkey", "l_linenumber", "fragment"), li)[1]


def shared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three jobs of one batch over the same lines, which are scanned once: counts by return flag and line number, and the lengths of both."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("string").alias("line"))
    count = lambda c: jobs.Job("rows", map="bytes_count", reduce="sum_values", params={"bytes_count.key": c, "bytes_count.size": 8})
    lengths = jobs.Job("rows", map="tuple_lengths", reduce="sum_values", params={"tuple_lengths.key": "l_returnflag", "tuple_lengths.value": "line"})
    results = _run(spark, [count("l_returnflag"), count("line"), lengths], li)
    return reduce(DataFrame.unionByName, [r.select(F.lit(i).alias("job"), "key", "value") for i, r in enumerate(results)])


def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of each word of the inverted index as ordered lists, in blocks of 500 parts."""
    lists = text.postings(words.inverted_index(spark, sf_dir), 500)
    return lists.select("word", F.col("block").cast("bigint").alias("block"), F.array_join(F.transform("postings", lambda p: F.concat(p["doc"].cast("string"), F.lit(":"), p["cnt"].cast("string"))), " ").alias("docs"))


def sum_big_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of numbers given as bytes, of 4 or 8 of them, one of which is so large that the sum passes 2^64 and begins anew."""
    price = F.floor(F.col("o_totalprice") * 100).cast("bigint")
    value = F.when(F.col("o_orderkey") % 2 == 0, byteorder.to_big_endian(price, 4)).otherwise(byteorder.to_big_endian(price - F.lit(1 << 40)))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), value.alias("value"))
    return rows.groupBy("key").agg(byteorder.wrapping_sum(byteorder.from_big_endian(F.col("value"))).cast("string").alias("total"))


def partition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written to a file per partition, and read again: the partitions by the files' names, their tuples and bytes, and whether they came sorted."""
    path = _fresh(spark, "partitions")
    keys = order._keys(spark, sf_dir).withColumn("partition", parts.partition_of(F.col("key"), order._list(spark, sf_dir))).withColumn("value", F.col("o_custkey").cast("string"))
    kv.write_partitions(keys, "partition", order.PARTITIONS, path, 7, ["key"])
    found = files.list_files(spark, path)
    name = paths.partition_file(F.col("path"))
    sizes = found.select(name["job"].alias("job"), name["partition"].alias("partition"), F.col("length").alias("bytes"))
    tuples = kv.read_framed(spark, path).select(parts.partition_of(F.col("key").cast("string"), order._list(spark, sf_dir)).cast("bigint").alias("partition"))
    counts = tuples.groupBy("partition").agg(F.count(F.lit(1)).alias("tuples"))
    return sizes.join(counts, "partition").select("job", "partition", "tuples", "bytes")


def capped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in six files of two folders, of each of which only the first two files are read."""
    path = _fresh(spark, "folders")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.hex("c_custkey"), 16, "0").alias("key"), F.rpad("c_mktsegment", 12, " ").alias("value"))
    for i in range(2):
        kv.write_kv(rows.where(F.col("c_custkey") % 2 == i).withColumn("file", F.expr("cast(c_custkey % 6 div 2 as int)")).repartitionById(3, "file"), f"{path}/{'ab'[i]}", headers=False)
    return kv.read_fixed(spark, path, 16, 12, most_per_folder=2, split=280).select(F.col("key").cast("string").alias("key"))


def sampled_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the tuples of a file of customers, from four places of it."""
    path = _fresh(spark, "records")
    rows = table(spark, sf_dir, "customer").select(F.lpad(F.hex("c_custkey"), 16, "0").alias("key"), F.rpad("c_mktsegment", 12, " ").alias("value"))
    kv.write_kv(rows.coalesce(1).sortWithinPartitions("key"), path, headers=False)
    ranges = files.sample_ranges(files.list_files(spark, path), 0.1, 4, 28)
    return kv.read_ranges(ranges, (16, 12)).select(F.col("key").cast("string").alias("key"))


def text_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files and read by lines."""
    path = _fresh(spark, "texts")
    table(spark, sf_dir, "documents").where("text is not null").select("text").write.text(path)
    return read_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("cnt"))


def byte_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of orders that fill half a buffer of 16 kB, with their keys or their hashes: do they fill it, is each tuple's size right, and are all keys those of orders?"""
    rows = order._keys(spark, sf_dir).withColumn("value", F.col("o_custkey").cast("string"))
    sizes = rows.select(F.col("key"), hashed_key(F.col("key").cast("binary")).alias("hash"), (F.octet_length("key") + F.octet_length("value") + 8).cast("bigint").alias("size"))
    out = []
    for hashed, key in ((False, F.col("key").cast("binary")), (True, F.col("hash"))):
        sample = parts.byte_reservoir(rows, "key", "value", ["key"], 16 << 10, hashed=hashed)
        found = sample.join(sizes.select(key.alias("key"), "size"), "key", "left")
        used = F.sum(F.octet_length("key") + 16)
        out.append(found.agg(F.lit(hashed).alias("hashed"), F.count(F.lit(1)).alias("n"), ((used <= 8192) & (used > 8192 - 64)).alias("filled"), F.min(F.coalesce(F.col("size") == F.col("value"), F.lit(False))).alias("sizes")))
    return out[0].unionByName(out[1])


def size_histogram_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth buffer in a histogram: is it a tenth of all, but for one a task, and are its bins among those of all?"""
    b = table(spark, sf_dir, "net_buffer").where("buffer_length is not null").coalesce(1)
    every, all_ = stats.size_histogram(b, "buffer_length", 4096, 10), stats.size_histogram(b, "buffer_length", 4096).withColumnRenamed("cnt", "all")
    joined = all_.join(every, "bin", "full")
    return joined.agg(F.sum("cnt").alias("cnt"), F.min(F.coalesce(F.col("cnt"), F.lit(0)) <= F.coalesce(F.col("all"), F.lit(0))).alias("within"))


QUERIES = {
    f.__name__: f
    for f in (
        job_sort, job_hashed_sort, job_fast_sort, job_word_count, job_ngram_count, job_page_rank, job_click_sessions, job_link_graph, job_text_extraction, job_merge, job_sum_values, job_tuple_lengths, job_duplicates,
        shared_scan, posting_lists, sum_big_endian, partition_files, capped_listing, sampled_ranges, text_file_lines, byte_reservoir, size_histogram_every,
    )
}

_UNIFORM = f"""cast(case when strlen(p_name) >= 3 then ((ascii(substr(p_name, 1, 1)) * 65536 + ascii(substr(p_name, 2, 1)) * 256 + ascii(substr(p_name, 3, 1))) * {order.PARTITIONS}) >> 24 end as integer)"""
_RECORDS = "select c_custkey, printf('%016X', c_custkey) as key, (row_number() over (order by printf('%016X', c_custkey)) - 1) as n, count(*) over () as total from customer"

SQL = {
    "job_sort": order._PARTITIONED + " select cast(p as integer) as partition, key, o_custkey from r",
    "job_hashed_sort": f"select least({order.PARTITIONS}, count(*))::bigint as parts, count(*) as rows, true as apart, true as even from orders",
    "job_fast_sort": f"select p_partkey, p_name, {_UNIFORM} as partition from part",
    "job_word_count": words._WORDS + " select word as key, count(*) as value from w group by word",
    "job_ngram_count": words._ngrams(3).replace(" as ngram, count(*) as cnt", " as key, count(*) as value"),
    "job_page_rank": words._rounds(3),
    "job_click_sessions": words.SQL["click_sessions"],
    "job_link_graph": words.SQL["adjacency_build"],
    "job_text_extraction": words.SQL["text_extract"],
    "job_merge": "select c_custkey, c_name, cast(1 as integer) as files from customer",
    "job_sum_values": "select '' as key, cast(sum(cast(l_quantity as bigint)) as bigint) as value from lineitem",
    "job_tuple_lengths": """
with t as (select strlen(c_name) as k, strlen(c_mktsegment) as v from customer)
select kind || ':' || length as key, count(*) as value from (select 0 as kind, k as length from t union all select 1, v from t union all select 2, k + v + 8 from t) group by all""",
    "job_duplicates": """
with f as (select l_orderkey, l_linenumber, printf('%04X', cast(l_quantity as bigint)) as fragment from lineitem),
p as (select fragment || lead(fragment) over (partition by l_orderkey order by l_linenumber, fragment) as key from f)
select key, count(*) as cnt from p where key is not null group by key having count(*) > 1""",
    "shared_scan": """
with t as (select l_returnflag as k, l_linenumber::varchar as v from lineitem)
select 0 as job, k as key, count(*) as value from t group by all
union all select 1, v, count(*) from t group by all
union all select 2, kind || ':' || length, count(*) from (select 0 as kind, strlen(k) as length from t union all select 1, strlen(v) from t union all select 2, strlen(k) + strlen(v) + 8 from t) group by all""",
    "posting_lists": """
with p as (select word, doc, count(*) as cnt from (select p_partkey as doc, substr(p_name, cast(i as bigint), 4) as word from (select p_partkey, p_name, unnest(range(1, strlen(p_name) + 1, 4)) as i from part)) group by all)
select word, doc // 500 as block, string_agg(doc || ':' || cnt, ' ' order by doc) as docs from p group by all""",
    "sum_big_endian": """
with t as (select o_orderpriority as key, o_orderkey % 2 = 0 as small, cast(floor(o_totalprice * 100) as hugeint) as price from orders),
v as (select key, case when small then price % 4294967296 else price - 1099511627776 + (case when price < 1099511627776 then 18446744073709551616::hugeint else 0 end) end as value from t)
select key, cast(sum(value) % 18446744073709551616::hugeint as varchar) as total from v group by key""",
    "partition_files": order._PARTITIONED + " select cast(7 as bigint) as job, cast(p as bigint) as partition, count(*) as tuples, cast(sum(8 + 12 + strlen(o_custkey::varchar)) as bigint) as bytes from r group by p",
    "capped_listing": "select printf('%016X', c_custkey) as key from customer where c_custkey % 6 in (0, 1, 2, 3)",
    "sampled_ranges": f"with r as ({_RECORDS}) select key from r, range(4) as p(i) where n >= i * (total * 28 // 4 // 28) and n < i * (total * 28 // 4 // 28) + cast(floor(floor(total * 28 * 0.1 / 4) / 28) as bigint)",
    "text_file_lines": words._LINES + " select line, count(*) as cnt from l group by line",
    "byte_reservoir": "select hashed, least(8192 // size, n) as n, true as filled, true as sizes from (select count(*) as n from orders), (values (false, 28), (true, 24)) as t(hashed, size)",
    "size_histogram_every": "select cast(ceil(count(*) / 10) as bigint) as cnt, true as within from net_buffer where buffer_length is not null",
}
