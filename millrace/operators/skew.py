"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Aggregates whose state grows with the rows of a key.
_GATHERING = ("collect_list", "collect_set", "array_agg", "listagg", "string_agg", "percentile", "median", "mode", "percentile_cont", "percentile_disc", "histogram_numeric")


def once_per_id(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row per value of ``id_col``, of rows that may have been sent again. Copies are equal but for columns not
    asked for, so any of them will do. Rows are spread by id, hence evenly, whatever the keys look like.

    Rows without an id are left out: they can't be told from copies. An empty table gives no rows.
    """
    known = df.where(F.col(id_col).isNotNull())
    return known.groupBy(id_col).agg(*[F.first(c).alias(c) for c in columns])


def skew_aggregate(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """``aggregates`` (count, sum, min, max and others that can be merged) per ``keys``, null keys being a group.

    Each input partition first fills a hash table of states per key, which spills by sorting when it outgrows its memory;
    then only one row per key and partition is shuffled, so a key with a third of all rows costs its task no more
    than one with few. Only mergeable aggregates are taken: one that needs all rows of a key at once is refused.
    """
    if any(f"{name}(" in str(a) for a in aggregates for name in _GATHERING):
        raise ValueError("this aggregate gathers all rows of a key")
    return df.groupBy(*keys).agg(*aggregates)


def partition_stats(net_buffer: DataFrame) -> DataFrame:
    """Counts, sums and extremes of buffer_length per job and partition, each buffer counted once.

    ``buffers`` counts all buffers, ``known`` those with a length; sums and extremes are over the latter and null if there
    are none. Buffers without partition_id or job_id form groups of their own (a null key).
    """
    buffers = once_per_id(net_buffer, "buffer_id", ["job_id", "partition_id", "buffer_length"])
    length = F.col("buffer_length")
    return skew_aggregate(
        buffers,
        ["job_id", "partition_id"],
        [F.count(F.lit(1)).alias("buffers"), F.count(length).alias("known"), F.sum(length).alias("bytes"), F.min(length).alias("least"), F.max(length).alias("most")],
    )


def heavy_partitions(stats: DataFrame, share: tuple[int, int] = (1, 5)) -> DataFrame:
    """Job and partition ids of ``partition_stats`` rows with at least ``share`` (a fraction) of the job's buffers, those
    without partition_id left out. Reads only the compact aggregates."""
    named = stats.where(F.col("partition_id").isNotNull() & F.col("job_id").isNotNull())
    totals = named.groupBy("job_id").agg(F.sum("buffers").alias("total"))
    over = named.join(totals, "job_id").where(F.col("buffers") * share[1] >= F.col("total") * share[0])
    return over.select("job_id", "partition_id")
