"""Sampled boundaries, and the partitions that keys belong to."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashing import hashed_key
from millrace.tables import written


def systematic_sample(df: DataFrame, order: list[str], rate: float, points: int = 1) -> DataFrame:
    """From each of ``points`` equal stretches of the ordered rows, the first ones, ``rate`` of all rows in total; whole rows only.

    Rows are numbered as by ``numbered``, so no task orders all of them.
    """
    rows, total = numbered_and_counted(df, order, "__nr")
    stretch = max(1, total // points)
    take = int(total * rate / points)
    return rows.where((F.floor((F.col("__nr") - 1) / stretch) < points) & (F.pmod(F.col("__nr") - 1, F.lit(stretch)) < take)).drop("__nr")


def numbered(df: DataFrame, order: list[str | Column], name: str = "nr") -> DataFrame:
    """Rows numbered from 1 in the order of the columns, without one task holding all.

    Rows are ranged over the tasks, sorted and written once, with their task and their number in it; the numbers of rows per task are then counted from
    that very table, so numbers and counts can't be of different ranges. One shuffle; what is added to each task's numbers is a row per task.
    """
    return numbered_and_counted(df, order, name)[0]


def numbered_and_counted(df: DataFrame, order: list[str | Column], name: str) -> tuple[DataFrame, int]:
    """The numbered rows, and how many there are."""
    # the id that Spark gives: the task's number in the upper bits, the row's number within it in the lower 33
    id_ = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", id_)
    rows = written(ranged, "numbered")
    sizes = rows.groupBy(F.shiftright("__id", 33).cast("int").alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before, total = _before(sizes)
    rows = rows.withColumn("__part", F.shiftright("__id", 33).cast("int"))
    own = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(before), "__part").withColumn(name, own + F.col("__sum")).drop("__part", "__id", "__sum"), total


def _before(sizes: DataFrame) -> tuple[DataFrame, int | float]:
    """Of a row per task (__part, __n): what the tasks before have together, and what all have. As many rows as tasks are read."""
    parts = sorted((r["__part"], r["__n"] or 0) for r in sizes.collect())
    rows, total = [], 0
    for part, n in parts:
        rows.append((part, total))
        total += n
    kind = sizes.schema["__n"].dataType.simpleString()
    return sizes.sparkSession.createDataFrame(rows, f"__part int, __sum {kind}"), total


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` (whole numbers or doubles; nulls count 0) over all rows before each, in the order of the columns; ranged, sorted and written once as ``numbered``."""
    kind = "double" if df.schema[value].dataType.simpleString() in ("float", "double") else "bigint"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__v", F.coalesce(F.col(value).cast(kind), F.lit(0).cast(kind)))
    out = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in ranged.schema], T.StructField("__part", T.IntegerType()), T.StructField("__own", ranged.schema["__v"].dataType)])
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            upto = held + np.cumsum(v)
            if len(v):
                own, held = upto - v, upto[-1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(own)], names)

    rows = written(ranged.mapInArrow(run, out), "running")
    before, _ = _before(rows.groupBy("__part").agg(F.sum("__v").alias("__n")))
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__own") + F.col("__sum")).drop("__part", "__own", "__v", "__sum")


def range_boundaries(df: DataFrame, key: str, weight: str, partitions: int, tie: list[str] | None = None) -> DataFrame:
    """Keys that cut the rows, sorted by key, into ``partitions`` parts of equal weight: index, key.

    A row is a boundary when the weight before it exceeds the next multiple of a part's weight (what doesn't divide evenly is spread over the first parts); one
    row can pass only one multiple. The first row is never a boundary, as nothing is before it: keys below the first boundary belong to partition 0.
    """
    order = [key, *(tie or [])]
    rows = df.select(*[F.col(c) for c in order], F.col(weight).cast("bigint").alias("__w"))
    total = rows.agg(F.sum("__w")).first()[0] or 0
    size, rest = divmod(total, partitions)
    rows = running_sum(rows, order, "__w", "__ahead")
    # multiples that lie below the weight before a row: i * size + min(i, rest) for i from 0
    w = F.col("__ahead")
    passed = F.when(w <= 0, F.lit(0)).when(w <= rest * (size + 1), F.ceil(w / (size + 1))).otherwise(F.lit(rest) + F.ceil((w - rest * (size + 1)) / max(1, size)))
    rows = rows.withColumn("__passed", passed.cast("bigint"))
    # the first row at which each multiple is passed; a row that passes several takes one, the rows after it the others
    ranged = rows.groupBy("__passed").agg(F.min(F.struct(*order)).alias("r"))
    many = ranged.agg(F.max("__passed"), F.countDistinct("__passed")).first()
    if many[0] is None or many[0] == many[1] - 1:  # no row passes more than one
        return ranged.where(F.col("__passed") > 0).select((F.col("__passed") - 1).cast("int").alias("index"), F.col(f"r.{key}").alias("key"))
    # rows heavier than a part: boundary i stands no earlier than one row after boundary i - 1
    at = numbered(rows, order)
    first = at.where(F.col("__passed") > 0).groupBy("__passed").agg(F.min("nr").alias("nr"))
    all_ = {r["__passed"]: r["nr"] for r in first.collect()}  # at most one per partition
    chosen, nr = [], 0
    for i in range(1, many[0] + 1):
        ahead = [n for p, n in all_.items() if p >= i]
        nr = max(nr + 1, min(ahead))
        chosen.append((i - 1, nr))
    picked = df.sparkSession.createDataFrame(chosen, "index int, nr bigint")
    return at.join(F.broadcast(picked), "nr").select("index", F.col(key).alias("key"))


def hashed_boundaries(df: DataFrame, key: str, weight: str, partitions: int) -> DataFrame:
    """Boundaries of the keys' hashes (index, key: 8 bytes), so that parts have equal weight whatever the keys look like: the hash's bytes are compared, not its number.
    A key's partition is ``partition_of(hashed_key(key), boundaries)``. Equal keys have equal hashes and stay together."""
    rows = df.select(hashed_key(F.col(key).cast("binary")).alias("key"), F.col(weight).alias("weight"))
    return range_boundaries(rows, "key", "weight", partitions)


def median_boundaries(boundaries: DataFrame, index: str, key: str) -> DataFrame:
    """Of the keys that several nodes chose for each boundary, the lower median: index, key. Per index there is a key per node."""
    return boundaries.groupBy(index).agg(F.expr(f"element_at(array_sort(collect_list({key})), cast((count({key}) - 1) div 2 as int) + 1)").alias(key))


def partition_of(key: Column, boundaries: list) -> Column:
    """The partition of a key: that of the last boundary not above it, 0 below the first. By binary search in a literal tree, so thousands of boundaries cost a dozen comparisons."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(key >= F.lit(boundaries[mid]), search(mid, hi)).otherwise(search(lo, mid - 1))

    return search(0, max(0, len(boundaries) - 1)).cast("int")


def partition_number(key, boundaries: list) -> int:
    return max(0, bisect_right(boundaries, key) - 1)


def node_of(partition: Column, per_node: int) -> Column:
    """The node that a partition, or the boundary with its number, belongs to, where each node has ``per_node`` of them one after another."""
    return F.floor(partition / per_node).cast("int")


def uniform_partition(key: Column, partitions: int) -> Column:
    """The partition of a key by its first three bytes, as if they were uniform; null for a key of fewer."""
    raw = key.cast("binary")
    number = F.conv(F.hex(F.substring(raw, 1, 3)), 16, 10).cast("bigint")
    return F.when(F.octet_length(raw) >= 3, F.shiftright(number * partitions, 24)).cast("int")


def range_filter(key: Column, ranges: list[tuple] | None) -> Column:
    """Whether a key is in one of ``ranges`` (from, to), the latter excluded and None for no end. Without ranges every key passes."""
    if ranges is None:
        return F.lit(True)
    tests = [(key >= F.lit(lo)) & (F.lit(True) if hi is None else key < F.lit(hi)) for lo, hi in ranges]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def partition_ranges(boundaries: list, first: int, last: int) -> tuple:
    """The key range of partitions ``first`` to ``last``; the last partition of all has no end."""
    return boundaries[first], boundaries[last + 1] if last + 1 < len(boundaries) else None


def partition_count(input_bytes: int, ratio: float, nodes: int, disks: int, output_disks: int, groups: int, partition_bytes: int) -> int:
    """How many partitions a job needs: per disk enough for its part of the intermediate data, and per node a multiple of its disks and groups."""
    per_disk = max(1, math.ceil(int(input_bytes * ratio) // (nodes * disks) / partition_bytes))
    multiple = math.lcm(disks, groups, output_disks)
    return -(-per_disk * disks // multiple) * multiple * nodes


def partition_count_of(input_bytes: Column, ratio: float, nodes: int, disks: int, output_disks: int, groups: int, partition_bytes: int) -> Column:
    """The same for a column of sizes."""
    per_disk = F.greatest(F.ceil(F.floor(F.floor(input_bytes * F.lit(float(ratio))) / (nodes * disks)) / F.lit(float(partition_bytes))), F.lit(1))
    multiple = math.lcm(disks, groups, output_disks)
    return (F.ceil(per_disk * disks / multiple) * multiple * nodes).cast("bigint")


def reservoir_sample(df: DataFrame, keys: list[str], size: int, seed: int = 7) -> DataFrame:
    """``size`` rows, each set of that size equally likely: those whose seeded hash is least. Each task keeps ``size`` rows, and only those are merged. Rows with equal ``keys`` share their fate, so the keys should be unique."""
    return df.withColumn("__h", F.xxhash64(F.lit(seed), *keys)).orderBy("__h", *keys).limit(size).drop("__h")


def byte_reservoir(df: DataFrame, key: str, value: str, unique: list[str], buffer_bytes: int, seed: int = 7, hashed: bool = False) -> DataFrame:
    """A sample of tuples that fills half a buffer of ``buffer_bytes``: key (or the 8 bytes of its hash), and as value the size of the tuple it came from, header and all.

    A sampled tuple takes 16 bytes, for its header and value, and its key. The tuples are those whose seeded hash of ``unique`` is least, as many as fit; as none takes less than its header and value, each task keeps no more
    than half the buffer could hold, and only those are merged.
    """
    k, half = F.col(key).cast("binary"), buffer_bytes // 2
    kept = hashed_key(k) if hashed else k
    rows = df.select(F.xxhash64(F.lit(seed), *unique).alias("__h"), *[F.col(c).alias(f"__u{i}") for i, c in enumerate(unique)], kept.alias("key"), (F.octet_length(k) + F.octet_length(F.col(value).cast("binary")) + 8).cast("bigint").alias("value"))
    order = ["__h", *[f"__u{i}" for i in range(len(unique))]]
    first = rows.where(F.col("key").isNotNull()).orderBy(*order).limit(max(1, half // 16))  # a buffer's worth, for one task
    upto = F.sum(F.octet_length("key") + 16).over(Window.orderBy(*order))
    return first.withColumn("__upto", upto).where(F.col("__upto") <= half).select("key", "value")


def into_partitions(df: DataFrame, partition: str, partitions: int, order: list[str] | None = None) -> DataFrame:
    """Rows moved to the task of their partition number, partition i to task i, sorted there if ``order`` is given."""
    out = df.repartitionById(partitions, partition)
    return out.sortWithinPartitions(*order) if order else out
