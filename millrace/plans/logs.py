"""Queries of the log and statistics layer over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import stats
from millrace.operators.text import multi_regex_grep as grep_many
from millrace.tables import table

PATTERNS = ("phase_(one|two)\t.*", "[^\t]*\tsorter\t.*", ".*\tbytes_(in|out)")
BIN = 4096


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with evenly spelled names."""
    name = lambda c: F.translate(F.lower(F.trim(c)), "-", "_").alias(c)
    host = F.substring_index(F.lower(F.trim("hostname")), ".", 1).alias("hostname")
    return table(spark, sf_dir, "stat_line").where("uint_value >= 0").select("line_id", "line_type", "job_id", "phase_name", "epoch", host, name("stage_name"), "worker_id", name("stat_name"), "logged_at", "received_at", "uint_value")


def stat_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = stats.StatQuery({"line_type": "COLL", "phase_name": ["phase_one", "phase_two"], "stage_name": "s.*er", "worker_id": 3, "stat_name": None})
    return stats.stat_filter(_lines(spark, sf_dir), query).select("line_id", "stage_name", "stat_name", "uint_value")


def multi_regex_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("line_id", F.concat_ws("\t", F.coalesce("phase_name", F.lit("")), "stage_name", "stat_name").alias("line"))
    return grep_many(lines, "line", list(PATTERNS)).select("line_id", "pattern_no")


def stat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.summary(_lines(spark, sf_dir), ["stage_name", "stat_name"], "uint_value")
    return out.select("stage_name", "stat_name", "least", "most", "total", "n", "mean", "median", "variance")


def stat_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = [["stage_name"], ["hostname", "stage_name"], ["hostname", "stage_name", "worker_id"]]
    return stats.rollup(_lines(spark, sf_dir), levels, "uint_value").select("stage_name", "hostname", "worker_id", "level", "n", "total", "least", "most")


def derived_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    names = {"bytes_in": "bytes_in", "bytes_out": "bytes_out", "work_unit_us": "runtime", "queue_wait_us": "idle", "teardown_us": "teardown"}
    sums = stats.pivot_stats(lines, ["stage_name"], "stat_name", "uint_value", names)
    sizes = lines.groupBy("stage_name").agg(F.countDistinct("worker_id").alias("workers"), F.countDistinct("hostname").alias("nodes"))
    rows = stats.null_safe_join(sums, sizes, ["stage_name"]).withColumns({c: F.lit(0) for c in ("memory_wait", "enqueue_block", "saturation")})
    out = stats.derived_rates(rows)
    return out.select("stage_name", "bytes_in", "bytes_out", *[F.round(c, 6).alias(c) for c in ("io_multiplier", "share_waiting", "share_useful", "observed_rate", "ideal_rate", "observed_rate_per_worker", "ideal_rate_per_node")])


def throughput_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda s: F.when(F.col("stat_name") == s, F.col("uint_value"))
    out = stats.throughput(_lines(spark, sf_dir), ["job_id", "phase_name"], value("bytes_in"), value("bytes_out"), "logged_at", "received_at")
    return out.withColumn("mb_per_s", F.round("mb_per_s", 9))


def list_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.list_series(_lines(spark, sf_dir).where("line_type = 'COLL'"), "phase_name", "stage_name", "worker_id", "stat_name")


def time_series_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rebase(_lines(spark, sf_dir), ["job_id", "phase_name"], "logged_at").select("line_id", F.round("seconds", 6).alias("seconds"), "uint_value")


def value_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.cdf(_lines(spark, sf_dir), ["stat_name"], "uint_value")
    return out.select("stat_name", "value", F.round("share", 9).alias("share"))


def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_histogram(table(spark, sf_dir, "net_buffer"), "buffer_length", BIN)


def histogram_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms per host, merged."""
    b = table(spark, sf_dir, "net_buffer").where("buffer_length is not null")
    per_host = b.groupBy("sender_host", (F.floor(F.col("buffer_length") / BIN) * BIN).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    return stats.merge_histograms(per_host, "bin", "cnt")


def completion_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.completion_timeline(_lines(spark, sf_dir), "phase_name", ["hostname", "worker_id"], "logged_at")
    return out.select("phase_name", "hostname", "worker_id", F.round("start_s", 6).alias("start_s"), F.round("stop_s", 6).alias("stop_s"))


def value_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.moments(_lines(spark, sf_dir), ["stat_name"], "uint_value")
    return out.select("stat_name", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"), "median")


def flow_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers per sender, receiving group and partition."""
    b = table(spark, sf_dir, "net_buffer").where("buffer_length is not null").withColumn("sender", F.substring_index(F.lower(F.trim("sender_host")), ".", 1))
    flows = stats.flow_throughput(b, "sender", "partition_group", "job_id", "buffer_length", "received_at")[0]
    return flows.select("sender", "partition_group", "job_id", "bytes", F.round("seconds", 6).alias("seconds"), F.round("mb_per_s", 9).alias("mb_per_s"))


def peer_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per receiving group."""
    b = table(spark, sf_dir, "net_buffer").where("buffer_length is not null").withColumn("sender", F.substring_index(F.lower(F.trim("sender_host")), ".", 1))
    peers = stats.flow_throughput(b, "sender", "partition_group", "job_id", "buffer_length", "received_at")[1]
    return peers.select("partition_group", "bytes", F.round("seconds", 6).alias("seconds"), F.round("mb_per_s", 9).alias("mb_per_s"))


def completion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.completion_stats(_lines(spark, sf_dir), ["stage_name"], "uint_value")
    return out.select("stage_name", "n", F.round("mean", 6).alias("mean"), "median")


QUERIES = {
    f.__name__: f
    for f in (
        stat_filter, multi_regex_grep, stat_summary, stat_rollup, derived_rates, throughput_rate, list_series, time_series_rebase, value_cdf, size_histogram, histogram_merge,
        completion_timeline, value_moments, flow_throughput, peer_throughput, completion_stats,
    )
}

_LINES = """
with l as (select line_id, line_type, job_id, phase_name, epoch, split_part(lower(trim(hostname)), '.', 1) as hostname, translate(lower(trim(stage_name)), '-', '_') as stage_name, worker_id,
           translate(lower(trim(stat_name)), '-', '_') as stat_name, logged_at, received_at, uint_value from stat_line where uint_value >= 0)"""
_MEDIAN = "list_sort(list(uint_value))[count(*) // 2 + 1]"
_FLOWS = """
with f as (select split_part(lower(trim(sender_host)), '.', 1) as sender, partition_group, job_id, cast(sum(buffer_length) as bigint) as bytes, (epoch_us(max(received_at)) - epoch_us(min(received_at))) / 1e6 as seconds
           from net_buffer where buffer_length is not null group by all)"""

SQL = {
    "stat_filter": _LINES + " select line_id, stage_name, stat_name, uint_value from l where line_type = 'COLL' and phase_name in ('phase_one', 'phase_two') and regexp_full_match(stage_name, 's.*er') and worker_id = 3",
    "multi_regex_grep": _LINES + ", r as (select line_id, concat_ws(chr(9), coalesce(phase_name, ''), stage_name, stat_name) as line from l) " + " union all ".join(f"select line_id, {i} as pattern_no from r where regexp_full_match(line, '{p.replace(chr(9), chr(92) + 't')}')" for i, p in enumerate(PATTERNS)),
    "stat_summary": _LINES + f" select stage_name, stat_name, min(uint_value) as least, max(uint_value) as most, cast(sum(uint_value) as bigint) as total, count(*) as n, cast(floor(sum(uint_value) / count(*)) as bigint) as mean, {_MEDIAN} as median, (count(*)::hugeint * sum(uint_value::hugeint * uint_value) - sum(uint_value)::hugeint * sum(uint_value)::hugeint)::varchar::double / count(*) / count(*) as variance from l group by all",
    "stat_rollup": _LINES + " select stage_name, hostname, worker_id, cast(3 - grouping(stage_name) - grouping(hostname) - grouping(worker_id) as integer) as level, count(*) as n, cast(sum(uint_value) as bigint) as total, min(uint_value) as least, max(uint_value) as most from l group by grouping sets ((stage_name), (hostname, stage_name), (hostname, stage_name, worker_id))",
    "derived_rates": _LINES + """, s as (
  select stage_name, count(distinct worker_id) as workers, count(distinct hostname) as nodes,
         cast(coalesce(sum(uint_value) filter (stat_name = 'bytes_in'), 0) as bigint) as bytes_in, cast(coalesce(sum(uint_value) filter (stat_name = 'bytes_out'), 0) as bigint) as bytes_out,
         coalesce(sum(uint_value) filter (stat_name = 'work_unit_us'), 0)::double as run, coalesce(sum(uint_value) filter (stat_name = 'queue_wait_us'), 0)::double as idle, coalesce(sum(uint_value) filter (stat_name = 'teardown_us'), 0)::double as teardown,
         count(*) filter (stat_name in ('bytes_in', 'bytes_out', 'work_unit_us', 'queue_wait_us', 'teardown_us')) as n
  from l group by stage_name),
p as (select *, run + teardown + idle as processing, run + teardown as useful from s where n > 0),
q as (select *, case when processing > 0 and run > 0 then bytes_in / run else 0 end as observed from p),
r as (select *, case when processing > 0 and useful <> 0 then observed / (useful / processing) else 0 end as ideal from q)
select stage_name, bytes_in, bytes_out, round(case when bytes_in > 0 then bytes_out / bytes_in end, 6) as io_multiplier, round(case when processing > 0 then idle / processing else 0 end, 6) as share_waiting,
       round(case when processing > 0 then useful / processing else 0 end, 6) as share_useful, round(observed, 6) as observed_rate, round(ideal, 6) as ideal_rate,
       round(observed / workers, 6) as observed_rate_per_worker, round(ideal / nodes, 6) as ideal_rate_per_node from r""",
    "throughput_rate": _LINES + ", r as (select job_id, phase_name, cast(coalesce(sum(uint_value) filter (stat_name = 'bytes_in'), 0) as bigint) as input_bytes, cast(coalesce(sum(uint_value) filter (stat_name = 'bytes_out'), 0) as bigint) as output_bytes, epoch_us(max(received_at)) - epoch_us(min(logged_at)) as total_us from l group by all) select *, round(greatest(input_bytes, output_bytes) / nullif(total_us, 0), 9) as mb_per_s from r",
    "list_series": _LINES + " select distinct phase_name, stage_name, worker_id, stat_name from l where line_type = 'COLL'",
    "time_series_rebase": _LINES + " select line_id, round((epoch_us(logged_at) - min(epoch_us(logged_at)) over (partition by job_id, phase_name)) / 1e6, 6) as seconds, uint_value from l",
    "value_cdf": _LINES + " select distinct stat_name, uint_value as value, round(cume_dist() over (partition by stat_name order by uint_value), 9) as share from l",
    "size_histogram": f"select cast(floor(buffer_length / {BIN}) * {BIN} as bigint) as bin, count(*) as cnt from net_buffer where buffer_length is not null group by 1",
    "histogram_merge": f"select cast(floor(buffer_length / {BIN}) * {BIN} as bigint) as bin, count(*) as cnt from net_buffer where buffer_length is not null group by 1",
    "completion_timeline": _LINES + ", e as (select phase_name, hostname, worker_id, epoch_us(min(logged_at)) as a, epoch_us(max(logged_at)) as b from l group by all) select phase_name, hostname, worker_id, round((a - min(a) over (partition by phase_name)) / 1e6, 6) as start_s, round((b - min(a) over (partition by phase_name)) / 1e6, 6) as stop_s from e",
    "value_moments": _LINES + f""", m as (select *, avg(uint_value) over (partition by stat_name) as mu from l)
select stat_name, count(*) as n, round(avg(uint_value), 4) as mean, round(stddev_pop(uint_value), 4) as stddev, round(avg((uint_value - mu) ** 3) / nullif(stddev_pop(uint_value), 0) ** 3, 5) as skewness,
       round(avg((uint_value - mu) ** 4) / nullif(stddev_pop(uint_value), 0) ** 4 - 3, 5) as kurtosis, {_MEDIAN} as median from m group by stat_name""",
    "flow_throughput": _FLOWS + " select sender, partition_group, job_id, bytes, round(seconds, 6) as seconds, round(bytes / 1e6 / nullif(seconds, 0), 9) as mb_per_s from f",
    "peer_throughput": _FLOWS + ", p as (select partition_group, cast(sum(bytes) as bigint) as bytes, max(seconds) as seconds from f group by 1) select partition_group, bytes, round(seconds, 6) as seconds, round(bytes / 1e6 / nullif(seconds, 0), 9) as mb_per_s from p",
    "completion_stats": _LINES + " select stage_name, count(*) as n, round(avg(uint_value), 6) as mean, median(uint_value)::double as median from l group by 1",
}
