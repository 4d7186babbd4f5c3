"""Percentiles of large groups from summaries that can be merged, with a known bound of the rank error."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.lookup import lookup_join
from millrace.operators.skew import once_per_id
from millrace.tables import shuffle_partitions

# A summary is three arrays over some of the n values, ascending: the value, and bounds of its rank among all n, 1 for the least
# and n for the greatest. The first and the last value are always kept. Its error is half the widest gap between the lower bound of a
# value and the upper bound of the next.


def exact(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The summary that keeps all values."""
    rank = np.arange(1, len(values) + 1, dtype=np.int64)
    return np.sort(values), rank, rank.copy()


def merge(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The summary of both sets of values. Its widest gap is at most the sum of theirs: rank errors add up as the populations do, so the share stays that of the worse one."""
    if not len(a[0]):
        return b
    if not len(b[0]):
        return a

    def ranks(x, y, side):
        before = np.searchsorted(y[0], x[0], side=side)  # of y's kept values, those before x's in the merged order
        low = np.where(before > 0, y[1][np.maximum(before - 1, 0)], 0)
        high = np.where(before < len(y[0]), y[2][np.minimum(before, len(y[0]) - 1)] - 1, y[2][-1])
        return x[1] + low, x[2] + high

    (la, ha), (lb, hb) = ranks(a, b, "left"), ranks(b, a, "right")
    v = np.concatenate([a[0], b[0]])
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate([la, lb])[order], np.concatenate([ha, hb])[order]


def compress(s: tuple, uncertainty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drops values as long as the gap between neighbours stays within twice the permitted ``uncertainty`` (in ranks)."""
    v, low, high = s
    n = len(v)
    if n <= 2 or uncertainty < 1:
        return s
    room, keep, at = 2 * uncertainty, [0], 0
    while at < n - 1:
        # the farthest value whose upper bound is in reach of this one's lower bound, else the next
        at = min(max(int(np.searchsorted(high, low[at] + room, side="right")) - 1, at + 1), n - 1)
        keep.append(at)
    return v[keep], low[keep], high[keep]


def find(s: tuple, share: float) -> tuple[float, int, int, int]:
    """The value for a share of the ranks, the bounds of its rank, and by how many ranks it can be off."""
    v, low, high = s
    r = max(1, math.ceil(share * int(high[-1]) - 1e-9))
    off = np.maximum(high - r, r - low)
    i = int(np.argmin(off))
    return v[i], int(low[i]), int(high[i]), int(max(off[i], 0))


KEYS = ("stage_name", "stat_name", "hostname")
#: A merging task writes its summaries out once they came from so many kept values.
HELD = 1_000_000


def measurements(stat_line: DataFrame) -> DataFrame:
    """Lines with a measurement, each line_id once, names spelled evenly: lower case, trimmed, words joined by ``_``; a host is its first label.

    Lines without line_id, value or with a negative value (no measurement) are left out; names that are null stay null.
    """
    name = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    rows = stat_line.where(F.col("uint_value") >= 0).select(
        "line_id", name("stage_name").alias("stage_name"), name("stat_name").alias("stat_name"), F.substring_index(F.lower(F.trim("hostname")), ".", 1).alias("hostname"), F.to_date("logged_at").alias("day"), "uint_value"
    )
    return once_per_id(rows, "line_id", [*KEYS, "day", "uint_value"])


def _schema(keys: list[T.StructField], value: T.DataType) -> T.StructType:
    ranks = T.ArrayType(T.LongType())
    return T.StructType([*keys, T.StructField("v", T.ArrayType(value)), T.StructField("low", ranks), T.StructField("high", ranks), T.StructField("node", T.IntegerType())])


def _batch(names, keys_types, v_type, rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array([r[0][k] for r in rows], t) for k, t in enumerate(keys_types)]
    offsets = np.concatenate([[0], np.cumsum([len(r[1][0]) for r in rows])]).astype(np.int32)
    flat = lambda i, t: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[1][i] for r in rows]), t))
    return pa.RecordBatch.from_arrays([*cols, flat(0, v_type), flat(1, pa.int64()), flat(2, pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names)


def _emit(names, types, v_type, summaries: dict, node: int, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    items = list(summaries.items())
    for at in range(0, len(items), rows):
        yield _batch(names, types, v_type, [(k, s, node) for k, s in items[at : at + rows]])


def _group_codes(batch: pa.RecordBatch, n_keys: int) -> tuple[np.ndarray, list[tuple]]:
    """A number per row for its key, and the keys by number."""
    codes = np.zeros(batch.num_rows, np.int64)
    values = []
    for k in range(n_keys):
        d = batch.column(k).dictionary_encode()
        own = d.dictionary.to_pylist()
        codes = codes * (len(own) + 1) + d.indices.fill_null(len(own)).to_numpy(zero_copy_only=False)
        values.append([*own, None])
    found, inverse = np.unique(codes, return_inverse=True)
    keys = []
    for c in found.tolist():
        key = []
        for own in reversed(values):
            c, i = divmod(c, len(own))
            key.append(own[i])
        keys.append(tuple(reversed(key)))
    return inverse, keys


def summarise(rows: DataFrame, keys: list[str], value: str, epsilon: float = 0.002, block: int = 500_000) -> DataFrame:
    """A summary per key and partition of ``rows``, whose error is at most ``epsilon / 2`` of its count; columns: keys, ``v``, ``low``,
    ``high`` and ``node`` (the partition). At most ``block`` rows and the summaries so far are held. Null and NaN values are left out.

    The values of a block are sorted and given their exact ranks; a block's summary is merged into the partition's and compressed within
    half the uncertainty permitted in the end, as the merging of partitions needs room to compress in turn.
    """
    v_field = rows.schema[value]
    key_fields = [rows.schema[k] for k in keys]
    names = [*keys, "v", "low", "high", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, held, n, so_far = None, [], 0, {}

        def take():
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.filter(table.column(len(keys)).is_valid())
            for batch in table.to_batches():
                v = batch.column(len(keys)).to_numpy(zero_copy_only=False)
                ok = ~np.isnan(v) if v.dtype.kind == "f" else np.ones(len(v), bool)
                inverse, found = _group_codes(batch, len(keys))
                inverse, v = inverse[ok], v[ok]
                order = np.lexsort((v, inverse))
                inverse, v = inverse[order], v[order]
                ends = np.searchsorted(inverse, np.arange(len(found)), side="right")
                for i, key in enumerate(found):
                    own = v[ends[i - 1] if i else 0 : ends[i]]
                    if len(own):
                        s = exact(own)
                        s = merge(so_far[key], s) if key in so_far else s
                        so_far[key] = compress(s, epsilon / 2 * int(s[2][-1]))

        for batch in batches:
            types = [f.type for f in batch.schema]
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                take()
                held, n = [], 0
        if held:
            take()
        if so_far:
            yield from _emit(names, types[: len(keys)], types[len(keys)], so_far, TaskContext.get().partitionId())

    return rows.select(*keys, value).mapInArrow(run, _schema(key_fields, v_field.dataType))


def merge_summaries(summaries: DataFrame, keys: list[str], epsilon: float = 0.002, nodes: int | None = None, fan_in: int = 32) -> DataFrame:
    """One summary per key from many: ``fan_in`` of them at a time, level by level, so no task gets all summaries of a key.

    ``nodes``: about how many different ``node`` there are in ``summaries`` (by default found by reading that column); it decides the number of levels, of which the
    last gathers all that a key still has. The uncertainty permitted grows by level from
    ``epsilon / 2`` to ``epsilon`` of the count; the bounds in the result are those accumulated, whatever went into it.
    """
    if nodes is None:
        nodes = (summaries.agg(F.max("node")).first()[0] or 0) + 1
    levels = max(1, math.ceil(math.log(max(2, nodes), fan_in)))
    key_fields = [summaries.schema[k] for k in keys]
    v_type = summaries.schema["v"].dataType.elementType
    names = [*keys, "v", "low", "high", "node"]

    def level(df: DataFrame, permitted: float, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict = {}
            types, now, held = None, None, 0

            def close():
                done = {}
                for key, own in parts.items():
                    while len(own) > 1:  # pairwise, so that equally many values are gone through per round
                        own = [merge(*own[i : i + 2]) if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)]
                    done[key] = compress(own[0], permitted * int(own[0][2][-1]))
                parts.clear()
                return done

            for batch in batches:
                types = [f.type for f in batch.schema]
                lists = [batch.column(len(keys) + i) for i in range(3)]
                ends = [c.offsets.to_numpy() for c in lists]
                flat = [c.values.to_numpy(zero_copy_only=False) for c in lists]
                rows = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))], batch.column(len(keys) + 3).to_pylist(), strict=True))
                for i, row in enumerate(rows):
                    if row != now and held >= HELD:  # rows are sorted by key and node
                        yield from emit(close(), types)
                        held = 0
                    now = row
                    parts.setdefault(row, []).append(tuple(f[e[i] : e[i + 1]] for f, e in zip(flat, ends, strict=True)))
                    held += int(ends[0][i + 1] - ends[0][i])
            if parts:
                yield from emit(close(), types)

        def emit(done, types):
            yield _batch(names, types[: len(keys)], types[len(keys)].value_type, [(k[:-1], s, k[-1]) for k, s in done.items()])

        up = df.withColumn("node", F.lit(0) if last else F.expr(f"cast(node div {fan_in} as int)"))
        return up.repartition(*keys, "node").sortWithinPartitions(*keys, "node").mapInArrow(run, _schema(key_fields, v_type))

    for i in range(levels):
        summaries = level(summaries, epsilon * (0.5 + 0.5 * (i + 1) / levels), i + 1 == levels)
    return summaries


def percentiles(summaries: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Per summary: its keys, ``n``, a column per share with the value found, and ``rank_error``: by how many ranks any of them can be off at most."""
    key_fields = [summaries.schema[k] for k in keys]
    v_type = summaries.schema["v"].dataType.elementType
    out = T.StructType([*key_fields, T.StructField("n", T.LongType()), *[T.StructField(c, v_type) for c in shares], T.StructField("rank_error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(len(keys) + i) for i in range(3)]
            ends = [c.offsets.to_numpy() for c in lists]
            flat = [c.values.to_numpy(zero_copy_only=False) for c in lists]
            n, error, found = [], [], [[] for _ in shares]
            for i in range(batch.num_rows):
                s = tuple(f[e[i] : e[i + 1]] for f, e in zip(flat, ends, strict=True))
                n.append(int(s[2][-1]))
                worst = 0
                for k, share in enumerate(shares.values()):
                    v, _, _, off = find(s, share)
                    found[k].append(v)
                    worst = max(worst, off)
                error.append(worst)
            v_arrow = lists[0].type.value_type
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keys))], pa.array(n, pa.int64()), *[pa.array(f, v_arrow) for f in found], pa.array(error, pa.int64())], [f.name for f in out])

    return summaries.select(*keys, "v", "low", "high").mapInArrow(run, out)


def group_percentiles(stat_line: DataFrame, shares: dict[str, float], epsilon: float = 0.002, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Percentiles of uint_value per stage_name, stat_name and hostname: each found value's rank is off by at most ``epsilon`` of the
    group's count, and the bound really reached is in ``rank_error``. A group smaller than ``1 / epsilon`` is exact. The value for a share p is that of rank ceil(p n)."""
    parts = summarise(measurements(stat_line), list(keys), "uint_value", epsilon)
    whole = merge_summaries(parts, list(keys), epsilon, nodes=_tasks(stat_line))
    return percentiles(whole, list(keys), shares)


def _tasks(df: DataFrame) -> int:
    """How many tasks a shuffle has at most, as the session is set."""
    spark = df.sparkSession
    return max(shuffle_partitions(spark), int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 2), 2)


def rank_check(rows: DataFrame, found: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Holds percentiles against the rows they are of: keys, n, and whether each value found has a rank within ``rank_error`` of that asked for. Every row is compared with the values of its key."""
    both = lookup_join(rows.select(*keys, value), found.drop("n"), keys, F.col(value), "inner", null_safe=True)
    v = F.col(value)
    counts = both.groupBy(*keys).agg(
        F.count(v).alias("n"), F.first("rank_error").alias("rank_error"), *[F.sum((v < F.col(c)).cast("bigint")).alias(f"{c}_below") for c in shares], *[F.sum((v <= F.col(c)).cast("bigint")).alias(f"{c}_upto") for c in shares]
    )
    rank = lambda share: F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n") - 1e-9))
    ok = [(F.col(f"{c}_below") + 1 <= rank(s) + F.col("rank_error")) & (F.col(f"{c}_upto") >= rank(s) - F.col("rank_error")) for c, s in shares.items()]
    return counts.select(*keys, "n", "rank_error", reduce(lambda a, b: a & b, ok).alias("within"))


def daily_summaries(stat_line: DataFrame, epsilon: float = 0.002) -> DataFrame:
    """A summary per day (of logging) and group, to be kept and merged with those of other days by ``merge_summaries``."""
    parts = summarise(measurements(stat_line), ["day", *KEYS], "uint_value", epsilon)
    return merge_summaries(parts, ["day", *KEYS], epsilon, nodes=_tasks(stat_line))
