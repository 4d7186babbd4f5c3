"""Total and secondary orders, sorted records to test with, and proof that an output is sorted."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.partitioning import numbered, numbered_and_counted


def total_sort(df: DataFrame, order: list[str]) -> DataFrame:
    """All rows in the order of the columns: ranged over tasks by sampled boundaries, and sorted in each."""
    return df.orderBy(*order)


def secondary_sort(df: DataFrame, key: str, secondary: str) -> DataFrame:
    """Rows whose keys are together and, within a key, in the order of ``secondary``; keys may be in any task, and a key's rows don't pass memory but sorted, spilling runs."""
    return df.repartition(key).sortWithinPartitions(key, secondary)


def validate(df: DataFrame, position: str, key: str, record: list[str]) -> DataFrame:
    """One row that tells whether rows, taken by ``position``, are sorted by ``key``: first_unordered (0 if none: the number of rows before it),
    unordered, records, duplicates (a key equal to the one before), checksum (of all records' crc32)."""
    return merge_summaries(summarise(df, position, key, record))


def summarise(df: DataFrame, position: str, key: str, record: list[str], parts: int | None = None) -> DataFrame:
    """The same per part (a task's range of positions), to be merged: with part, from (the first position), first_key and last_key.

    Rows are shuffled once, by ranges of position; each task then compares its rows batch by batch and gives one row. A null key is below all others.
    """
    ranged = (df.repartitionByRange(parts, position) if parts else df.repartitionByRange(position)).sortWithinPartitions(position)
    rows = ranged.select(F.col(position).alias("pos"), F.col(key).alias("key"), F.crc32(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in record])).alias("crc"))
    pos_type, key_type = rows.schema["pos"].dataType, rows.schema["key"].dataType
    count = ("first_unordered", "unordered", "records", "duplicates")
    out = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("from", pos_type), *[T.StructField(c, T.LongType()) for c in count], T.StructField("checksum", T.DecimalType(38, 0)), T.StructField("first_key", key_type), T.StructField("last_key", key_type)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, first, last, types = None, None, None, None
        n = bad = same = crc = first_bad = 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, types = b.column(1), (b.schema.field(0).type, b.schema.field(1).type)
            before = pa.concat_arrays([last if last is not None else keys[:1], keys[:-1]])
            less = pc.or_(pc.fill_null(pc.less(keys, before), False), pc.and_(pc.is_null(keys), pc.is_valid(before))).to_numpy(zero_copy_only=False)
            equal = pc.or_(pc.fill_null(pc.equal(keys, before), False), pc.and_(pc.is_null(keys), pc.is_null(before))).to_numpy(zero_copy_only=False).copy()
            if last is None:
                equal[0] = False
                start, first = b.column(0)[:1], keys[:1]
            if not bad and less.any():
                first_bad = n + int(np.argmax(less))
            n, bad, same, crc = n + b.num_rows, bad + int(less.sum()), same + int(equal.sum()), crc + int(pc.sum(b.column(2)).as_py())
            last = keys[-1:]
        if n:
            numbers = [pa.array([x], pa.int64()) for x in (first_bad, bad, n, same)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), start, *numbers, pa.array([Decimal(crc)], pa.decimal128(38, 0)), first, last], out.names)

    return rows.mapInArrow(run, out)


def merge_summaries(parts: DataFrame) -> DataFrame:
    """One summary of all parts, in which a part's first key is held against the last one of the part before."""
    w = Window.orderBy("from")  # one row per part
    rows = parts.withColumn("prev", F.lag("last_key").over(w)).withColumn("before", F.coalesce(F.sum("records").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    border = F.coalesce((F.col("first_key") < F.col("prev")).cast("bigint"), F.lit(0))
    same = F.coalesce((F.col("first_key") == F.col("prev")).cast("bigint"), F.lit(0))
    first = F.when(border == 1, F.col("before")).when(F.col("first_unordered") > 0, F.col("before") + F.col("first_unordered"))
    return rows.agg(
        F.coalesce(F.min(first), F.lit(0)).alias("first_unordered"), F.coalesce(F.sum(F.col("unordered") + border), F.lit(0)).alias("unordered"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.sum(F.col("duplicates") + same), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("checksum"), F.lit(0).cast("decimal(38,0)")).alias("checksum"),
    )


def sort_records(spark: SparkSession, records: int, skewed: bool = False, ascii_form: bool = False, seed: int = 0, first: int = 0, tasks: int | None = None) -> DataFrame:
    """Records of 100 bytes to sort: key (10 bytes, random), payload (90 bytes, which holds the record's number). Record i is the same in any run and split.

    ``skewed``: of three quarters of the records the first bytes of the key (up to 6, the more the greater the power of two below the record's number) are those of a few common prefixes. ``ascii_form``: printable keys.
    """
    i = F.col("id")
    byte = lambda k, lo, n: F.lpad(F.hex(F.pmod(F.xxhash64(F.lit(seed), i, F.lit(k)), F.lit(n)) + lo), 2, "0")
    lo, n = (32, 95) if ascii_form else (0, 256)
    key = F.concat(*[byte(k, lo, n) for k in range(10)])
    if skewed:
        depth = F.least(F.floor(F.log2(F.greatest(i, F.lit(1)))).cast("int") % 7, F.lit(6))
        common = F.concat(*[F.lpad(F.hex(F.pmod(F.xxhash64(F.lit(seed), depth, F.lit(100 + k)), F.lit(n)) + lo), 2, "0") for k in range(6)])
        cut = F.when(F.pmod(F.xxhash64(F.lit(seed), i, F.lit(99)), F.lit(4)) == 0, 0).otherwise(depth) * 2
        key = F.concat(F.substring(common, F.lit(1), cut), F.substring(key, cut + 1, F.lit(20)))
    payload = F.concat(F.lit("0011"), F.lpad(F.hex(i), 32, "0").cast("binary").cast("string"), F.repeat(F.lit("4"), 54))
    return spark.range(first, first + records, 1, tasks or spark.sparkContext.defaultParallelism).select(i, F.unhex(key).alias("key"), payload.cast("binary").alias("payload"))


def top_percent(df: DataFrame, by: str, percent: float, tie: list[str]) -> DataFrame:
    """The ``percent`` of rows with the greatest ``by``, rounded down. Rows are numbered in that order over all tasks, so no task holds the share."""
    rows, total = numbered_and_counted(df, [F.col(by).desc(), *tie], "__nr")
    return rows.where(F.col("__nr") <= int(total * percent / 100)).drop("__nr")


def completion_rank(df: DataFrame, group: str, by: str, tie: list[str]) -> DataFrame:
    """Rows of all groups with their rank from 0 in the order of ``by``, null group or not."""
    return numbered(df, [by, *tie], "nr").withColumn("rank", F.col("nr") - 1).drop("nr")


def checksum_by_partition(df: DataFrame, record: list[str]) -> DataFrame:
    """Rows and the sum of the records' crc32 per task: equal totals before and after show that nothing was lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = total = 0
        for b in batches:
            n, total = n + len(b), total + int(b["crc"].sum())
        yield pd.DataFrame({"records": [n], "checksum": [total]})

    return df.select(F.crc32(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in record])).alias("crc")).mapInPandas(run, "records bigint, checksum bigint")
