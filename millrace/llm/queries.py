"""Queries of this package over the test tables, by name. Each passes whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import leakage, mixing, packing, quantiles, sampling, spam
from millrace.tables import table

SAMPLE_SIZE = 500
SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def p1_job_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAMPLE_SIZE records of each job."""
    out = sampling.fixed_size_sample(table(spark, sf_dir, "sample_key"), SAMPLE_SIZE, "key_id", "job_id", ["piece_id", "key_length", "key_ptr", "tuple_size"], buffer=128)
    return out.select("job_id", "key_id", "piece_id", "key_length", F.hex("key_ptr").alias("key_hex"), "tuple_size", "population")


def p1_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job: distinct records, and how many the sample has."""
    out = sampling.fixed_size_sample(table(spark, sf_dir, "sample_key"), SAMPLE_SIZE, "key_id", "job_id", [], buffer=128)
    return out.groupBy("job_id").agg(F.max("population").alias("population"), F.countDistinct("key_id").alias("sampled"))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per stage, statistic and host."""
    return quantiles.group_percentiles(table(spark, sf_dir, "stat_line"), SHARES)


def p2_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per stage and statistic, from the summaries of single days and hosts."""
    days = quantiles.daily_summaries(table(spark, sf_dir, "stat_line"))
    keys = ["stage_name", "stat_name"]
    parts = days.select(*keys, "v", "low", "high", F.pmod(F.xxhash64("day", "hostname"), F.lit(1024)).cast("int").alias("node"))
    return quantiles.percentiles(quantiles.merge_summaries(parts, keys, nodes=1024), keys, SHARES)


def p2_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per stage and statistic, which take much compressing, held against the lines themselves: is each within its rank_error, and are the errors above 0?"""
    rows, keys = quantiles.measurements(table(spark, sf_dir, "stat_line")), ["stage_name", "stat_name"]
    found = quantiles.group_percentiles(table(spark, sf_dir, "stat_line"), SHARES, 0.05, tuple(keys))
    checked = quantiles.rank_check(rows, found, keys, "uint_value", SHARES)
    return checked.select(*keys, "n", "within", (F.col("rank_error") <= F.ceil(0.05 * F.col("n"))).alias("bounded"), ((F.col("rank_error") > 0) | (F.col("n") < 200)).alias("compressed"))


def p3_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffer of each tuple. Tuples of one stream, and those of it with equal lengths (likely duplicates), go to different buffers where that takes no more of them."""
    rows = table(spark, sf_dir, "kv_tuple")
    return packing.pack_tuples(rows, table(spark, sf_dir, "job_info"), F.col("stream_id"), _duplicates(), strict=False)


def _duplicates() -> Column:
    return F.when(F.col("stream_id").isNotNull(), F.concat_ws(":", "stream_id", "key_length", "value_length"))


def p3_spread_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where tuples of one stream with equal lengths, likely duplicates, never share a buffer."""
    return packing.pack_tuples(table(spark, sf_dir, "kv_tuple"), table(spark, sf_dir, "job_info"), cluster=_duplicates())


def p3_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the buffers of each job get."""
    return packing.fill_report(p3_buffers(spark, sf_dir))


def p3_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job what was laid, and the fewest buffers that could hold it."""
    fill = p3_fill(spark, sf_dir)
    return fill.select("job_id", "tuples", "bytes", "least_buffers", (F.col("buffers") >= F.col("least_buffers")).alias("enough"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples that had to be split."""
    return packing.split_tuples(p3_buffers(spark, sf_dir))


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they leak, and how many words of them."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the mixture uses, and how often."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source is used, and the shares reached."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1]


def p7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of the report: their records, shares and limits, and whether no record is used too often and no source a block beyond its quota."""
    kept = (F.col("most_uses") <= F.col("max_repeats")) & (F.col("used_tokens") < F.col("quota_tokens") + 1024)
    return p7_report(spark, sf_dir).select("source", "records", F.round("target_share", 9).alias("target_share"), "max_repeats", kept.alias("kept"))


def p8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spam pages, with the share of their text that is spam."""
    return spam.spam_pages(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_pages(spark, sf_dir).select("doc_id").distinct()


def p2_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the percentiles are of: lines, least and greatest value per stage, statistic and host."""
    rows = quantiles.measurements(table(spark, sf_dir, "stat_line"))
    return rows.groupBy(*quantiles.KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("uint_value").alias("least"), F.max("uint_value").alias("most"))


def p3_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job: tuples and bytes laid, and tuples that can't be."""
    packed = p3_buffers(spark, sf_dir)
    return packed.groupBy("job_id").agg(
        F.sum(F.expr("if(part_no = 0 and part_bytes is not null or part_no > 0 and part_bytes is null, 1, 0)")).alias("first_parts"),
        F.countDistinct("tuple_id").alias("tuples"), F.coalesce(F.sum("part_bytes"), F.lit(0)).alias("bytes"), F.sum(F.expr("if(part_bytes is null, 1, 0)")).alias("not_laid"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        p1_job_sample, p1_sample_sizes, p2_percentiles, p2_merged_days, p2_measurements, p2_rank_check, p3_buffers, p3_spread_buffers, p3_fill, p3_least, p3_sizes, p3_found,
        p6_leaks, p6_found, p7_mixture, p7_report, p7_sources, p8_pages, p8_found,
    )
}
