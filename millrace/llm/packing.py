"""Laying items into containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.runs import gathered, runs
from millrace.operators.lookup import lookup_join
from millrace.tables import written

#: Bytes of a tuple's header.
HEADER = 8


def best_fit(sizes: list[int], capacity: int, sources: list[int] | None = None, clusters: list[int] | None = None, strict: bool = True) -> list[int]:
    """The bin of each item, items being laid in the order given; no item may be larger than ``capacity``.

    Open bins are kept in order of the space they have left. The search starts at the bin that the item fills best and goes on to
    the next larger space until one fits that holds no item of the same source or duplicate cluster, which a bitmap per
    bin tells; if none does, a new bin is opened, or with ``strict`` off the item goes to the bin that it fills best, so that a conflict never costs a bin. A source or cluster
    of -1 conflicts with nothing. Bins too full for the smallest item still to come are closed.
    """
    least = sizes[:]
    for i in range(len(least) - 2, -1, -1):
        least[i] = min(least[i], least[i + 1])
    open_bins: list[tuple[int, int]] = []
    marks: list[tuple[int, int]] = []
    # open bins per source: where all hold the item's, none need be searched
    holding: dict[int, int] = {}
    held: list[set[int]] = []
    out = []

    def closed(bins: list[tuple[int, int]]) -> None:
        for _, k in bins:
            for x in held[k]:
                holding[x] -= 1
            held[k] = set()

    for i, size in enumerate(sizes):
        source = sources[i] if sources else -1
        own = (1 << source if source >= 0 else 0, 1 << clusters[i] if clusters and clusters[i] >= 0 else 0)
        first = at = bisect_left(open_bins, (size, -1))
        if source >= 0 and holding.get(source, 0) == len(open_bins):
            at = len(open_bins)
        while at < len(open_bins) and (own[0] | own[1]) and (marks[open_bins[at][1]][0] & own[0] or marks[open_bins[at][1]][1] & own[1]):
            at += 1
        if at == len(open_bins) and not strict:
            at = first
        if at < len(open_bins):
            left, bin_ = open_bins.pop(at)
            marks[bin_] = (marks[bin_][0] | own[0], marks[bin_][1] | own[1])
        else:
            left, bin_ = capacity, len(marks)
            marks.append(own)
            held.append(set())
        out.append(bin_)
        if source >= 0 and source not in held[bin_]:
            held[bin_].add(source)
            holding[source] = holding.get(source, 0) + 1
        if i + 1 == len(sizes):
            break
        if left - size >= least[i + 1]:
            insort(open_bins, (left - size, bin_))
        else:
            closed([(0, bin_)])
        if open_bins and open_bins[0][0] < least[i + 1]:
            full = bisect_left(open_bins, (least[i + 1], -1))
            closed(open_bins[:full])
            del open_bins[:full]
    return out


def pack_tuples(kv_tuple: DataFrame, job_info: DataFrame, source: Column | None = None, cluster: Column | None = None, shard_items: int = 50_000, strict: bool = True) -> DataFrame:
    """The buffer of each tuple of ``kv_tuple``, each tuple_id once: best fit of decreasing sizes within its job's buffer_capacity.

    Columns: tuple_id, job_id, tuple_bytes, part_no, part_bytes, shard, buffer_no, capacity. A tuple larger than the capacity is
    split: its first parts fill whole buffers, the rest is laid like a tuple; others have the one part 0. ``shard`` and
    ``buffer_no`` together name a buffer of the job. With ``source`` or ``cluster`` (columns of kv_tuple) no buffer holds two tuples
    of the same source or duplicate cluster; null there conflicts with nothing. With ``strict`` off that holds only where it costs no further buffer.

    A job (null is one too) of more than ``shard_items`` rows is laid in several shards of about that many tuples, chosen by tuple_id, so
    no task has a whole large job; each shard leaves at most its last few buffers partly empty. Copies of a tuple go to the same
    shard. Tuples whose lengths, job or capacity aren't known (or are negative, or a capacity under 1) can't be laid: they give a row with
    part_no 0 whose part_bytes, shard and buffer_no are null. Rows without tuple_id are left out.
    """
    known = kv_tuple.where(F.col("tuple_id").isNotNull())
    rows = known.select("tuple_id", "job_id", "key_length", "value_length", *[(c.cast("string") if c is not None else F.lit(None).cast("string")).alias(n) for c, n in ((source, "source"), (cluster, "cluster"))])
    sizes = known.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    jobs = sizes.join(job_info.groupBy("job_id").agg(F.max("buffer_capacity").alias("capacity")), "job_id", "left")
    jobs = written(jobs.select("job_id", "capacity", F.ceil(F.col("n") / shard_items).cast("int").alias("shards")), "jobs")
    bytes_ = F.when((F.col("key_length") >= 0) & (F.col("value_length") >= 0), F.col("key_length") + F.col("value_length") + HEADER)
    rows = lookup_join(rows, jobs, ["job_id"], F.col("tuple_id"), null_safe=True).select(
        "job_id",
        F.pmod(F.xxhash64("tuple_id"), F.col("shards")).cast("int").alias("shard"),
        "tuple_id", bytes_.alias("bytes"), F.when(F.col("capacity") > 0, F.col("capacity")).alias("capacity"), "source", "cluster",
    )
    rows = rows.repartition("job_id", "shard").sortWithinPartitions("job_id", "shard")
    use = source is not None, cluster is not None

    def lay(key, pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(pieces)
        ids, first = np.unique(table.column("tuple_id").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        capacity = table.column("capacity")[0].as_py()
        size = table.column("bytes").to_numpy(zero_copy_only=False).astype(float)
        job, shard = key
        lost = np.isnan(size) | (capacity is None)

        def out(at, part, part_bytes, bin_):
            n = len(at)
            nulls = part_bytes is None
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array([job] * n, pa.int64()), table.column("bytes").take(pa.array(at)).combine_chunks(), pa.array(part, pa.int64()), pa.nulls(n, pa.int64()) if nulls else pa.array(part_bytes, pa.int64()),
                 pa.nulls(n, pa.int32()) if nulls else pa.array([shard] * n, pa.int32()), pa.nulls(n, pa.int64()) if nulls else pa.array(bin_, pa.int64()), pa.array([capacity] * n, pa.int64())],
                names=[f.name for f in _PACKED],
            )

        if lost.any():
            at = np.flatnonzero(lost)
            yield out(at, np.zeros(len(at), np.int64), None, None)
        at = np.flatnonzero(~lost)
        if not len(at):
            return
        size = size[at].astype(np.int64)
        full = np.where(size > capacity, size // capacity, 0)
        rest = size - full * capacity
        starts = np.cumsum(full) - full
        for i in np.flatnonzero(full):
            for a in range(0, full[i], 100_000):
                part = np.arange(a, min(full[i], a + 100_000))
                yield out(np.full(len(part), at[i]), part, np.full(len(part), capacity), starts[i] + part)
        order = np.lexsort((ids[at], -rest))
        order = order[(rest[order] > 0)]
        if len(order):
            bits = [_numbers(table.column(c).take(pa.array(at[order]))) if u else None for c, u in zip(("source", "cluster"), use, strict=True)]
            bins = best_fit(rest[order].tolist(), capacity, *bits, strict=strict)
            yield out(at[order], full[order], rest[order], np.asarray(bins) + int(full.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, ready = None, [], []
        for key, piece in runs(batches, 2):
            if pieces and key != now:
                ready += lay(now, pieces)
                pieces = []
                yield from gathered(ready, 20_000)
            now = key
            pieces.append(piece)
        if pieces:
            ready += lay(now, pieces)
        yield from gathered(ready, 0, last=True)

    return rows.mapInArrow(run, T.StructType(_PACKED))


_PACKED = [T.StructField(n, T.IntegerType() if n == "shard" else T.LongType()) for n in ("tuple_id", "job_id", "tuple_bytes", "part_no", "part_bytes", "shard", "buffer_no", "capacity")]


def _numbers(column: pa.ChunkedArray) -> list[int]:
    """Small numbers for the values of a column, -1 for null and for values that come once and so conflict with nothing."""
    codes = column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    known = codes[codes >= 0]
    many = np.flatnonzero(np.bincount(known, minlength=1) > 1) if len(known) else np.array([], int)
    number = {int(c): i for i, c in enumerate(many)}
    return [number.get(c, -1) for c in codes.tolist()]


def split_tuples(packed: DataFrame) -> DataFrame:
    """Ids of the tuples that had to be split, as the layout has them: those with a part after part 0."""
    return packed.where(F.col("part_no") > 0).select("tuple_id").distinct()


def fill_report(packed: DataFrame) -> DataFrame:
    """Per job: tuples, bytes, buffers used, the fewest that could do, and the share of the space used."""
    laid = packed.where(F.col("part_bytes").isNotNull())
    bins = laid.groupBy("job_id", "shard", "buffer_no").agg(F.sum("part_bytes").alias("bytes"), F.max("capacity").alias("capacity"), F.sum(F.expr("if(part_no = 0, 1, 0)")).alias("tuples"))
    jobs = bins.groupBy("job_id").agg(F.sum("tuples").alias("tuples"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("buffers"), F.max("capacity").alias("capacity"))
    return jobs.select("job_id", "tuples", "bytes", "buffers", F.ceil(F.col("bytes") / F.col("capacity")).alias("least_buffers"), F.round(F.col("bytes") / (F.col("buffers") * F.col("capacity")), 6).alias("filled"))
