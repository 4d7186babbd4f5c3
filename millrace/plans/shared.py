"""Queries of the general operators for training data over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import skew, snapshots
from millrace.tables import table, written


def _shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(snapshots.shred_snapshots(table(spark, sf_dir, "monitor_snapshot")), "levels")


def p4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots, each once, and whether their payload could be read."""
    return snapshots.snapshot_table(table(spark, sf_dir, "monitor_snapshot"))


def p4_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.stage_table(snapshots.shred_snapshots(table(spark, sf_dir, "monitor_snapshot")))


def p4_trackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.tracker_table(snapshots.shred_snapshots(table(spark, sf_dir, "monitor_snapshot")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values held by trackers."""
    rows = snapshots.child_table(_shredded(spark, sf_dir))
    return rows.select("snapshot_id", "phase_name", "stage_name", "tracker_pos", "child_kind", "child_pos", "child_value").distinct()


def p5_partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and extremes per job and partition."""
    return skew.partition_stats(table(spark, sf_dir, "net_buffer"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions with at least a fifth of their job's buffers."""
    return skew.heavy_partitions(skew.partition_stats(table(spark, sf_dir, "net_buffer")))


QUERIES = {f.__name__: f for f in (p4_snapshots, p4_stages, p4_trackers, p4_found, p5_partition_stats, p5_found)}

_BUFFERS = """
with b as (select buffer_id, any_value(job_id) as job_id, any_value(partition_id) as partition_id, any_value(buffer_length) as buffer_length
           from net_buffer where buffer_id is not null group by buffer_id)"""

# Trackers by walking all of each payload's JSON: objects of type tracker in an array, named by the array's key or the object around it, under the nearest phase.
_TRACKERS = r"""
with one as (select snapshot_id, any_value(payload) as payload, any_value(hostname) as hostname, any_value(captured_at) as captured_at from monitor_snapshot where snapshot_id is not null group by snapshot_id),
tried as (select *, case when json_valid(payload) then case when json_type(payload) = 'VARCHAR' then payload::json ->> '$' else payload end end as inner_ from one),
snaps as (select snapshot_id, hostname, captured_at, case when json_valid(inner_) and json_type(inner_) = 'OBJECT' then inner_ end as payload from tried),
tree as materialized (select snapshot_id, t.key, t.type, t.fullkey, t.path, t.value from snaps, json_tree(payload) t where payload is not null),
phases as (select snapshot_id, path as at, value ->> '$' as phase_name from tree where key = 'phase_name' and type = 'VARCHAR'),
objects as (select snapshot_id, fullkey, path, cast(key as integer) as pos, value, path like '%.members' as listed from tree where type = 'OBJECT' and fullkey like '%]' and json_extract_string(value, '$.type') = 'tracker'),
named as (select o.snapshot_id, o.fullkey, o.path, o.pos, o.value, case when o.listed then s.value ->> '$.name' else trim(regexp_extract(o.path, '([^.]+)$', 1), '"') end as stage_name
          from objects o left join tree s on o.listed and s.snapshot_id = o.snapshot_id and s.fullkey = regexp_replace(o.path, '\.members$', '')),
trackers as (select n.snapshot_id, coalesce(arg_max(p.phase_name, length(p.at)), '') as phase_name, any_value(n.stage_name) as stage_name, any_value(n.pos) as tracker_pos, any_value(n.value) as value, n.fullkey
             from named n left join phases p on p.snapshot_id = n.snapshot_id and (starts_with(n.fullkey, p.at || '.') or starts_with(n.fullkey, p.at || '['))
             group by n.snapshot_id, n.fullkey)"""

SQL = {
    "p4_snapshots": _TRACKERS + " select snapshot_id, hostname, captured_at, payload is not null as readable from snaps",
    "p4_found": _TRACKERS + r""",
kinds as (select *, unnest(['prev_trackers', 'worker_queue_sizes', 'next_stages']) as child_kind from trackers),
fields as (select *, json_extract(value, '$.' || child_kind) as field from kinds),
listed as (select * exclude (field, value), unnest(case when json_type(field) = 'ARRAY' then json_extract(field, '$[*]') else [field] end) as entry, generate_subscripts(case when json_type(field) = 'ARRAY' then json_extract(field, '$[*]') else [field] end, 1) - 1 as child_pos from fields where field is not null)
select distinct snapshot_id, phase_name, stage_name, tracker_pos, child_kind, cast(child_pos as integer) as child_pos, entry ->> '$' as child_value from listed where json_type(entry) not in ('NULL', 'ARRAY', 'OBJECT') and entry ->> '$' <> ''""",
    "p5_partition_stats": f"""{_BUFFERS}
select job_id, partition_id, count(*) as buffers, count(buffer_length) as known, cast(sum(buffer_length) as bigint) as bytes,
       min(buffer_length) as least, max(buffer_length) as most from b group by job_id, partition_id""",
    "p5_found": f"""{_BUFFERS},
s as (select job_id, partition_id, count(*) as n from b where partition_id is not null and job_id is not null group by all)
select job_id, partition_id from (select *, sum(n) over (partition by job_id) as total from s) where 5 * n >= total""",
}
