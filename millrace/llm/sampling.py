"""Fixed-size uniform samples of records that come in pieces of unknown number."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.runs import gathered, runs
from millrace.operators.lookup import lookup_join
from millrace.tables import shuffle_partitions, written

#: A group of more rows is spread over several shards, which have so many each (and 16 samples' worth at least).
SHARD_ROWS = 50_000


def hypergeometric(counts: np.ndarray, draws: int, rng: random.Random) -> np.ndarray:
    """How many of ``draws`` records, drawn without replacement, come from each stratum of ``counts`` records. Exact for any
    population: positions are drawn among all and counted by stratum; memory is one number per draw."""
    ends = np.cumsum(np.asarray(counts, dtype=np.int64))
    total = int(ends[-1]) if len(ends) else 0
    if draws >= total:
        return np.asarray(counts, dtype=np.int64)
    at = np.asarray(rng.sample(range(total), draws), dtype=np.int64)
    return np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(ends))


class GeometricFile:
    """A uniform sample of ``size`` records of one stream, of which at most ``buffer`` are held in memory.

    Accepted records wait in the buffer. When it is full they are written as one segment, in random order, and as many
    older records are overwritten, spread over the older segments by their sizes; as the order within a segment is
    random, overwriting means that a shorter beginning of it lives on, so segments shrink exponentially with age. Written rows
    go downstream (where Spark spills them); ``live`` has how long the living beginning of each segment is.
    """

    def __init__(self, size: int, buffer: int, seed: int):
        self.size, self.buffer = size, max(1, min(buffer, size))
        self.seen, self.live = 0, []
        self.held: list[tuple[pa.RecordBatch, int]] = []
        self.rng, self.draw = np.random.default_rng(seed), random.Random(seed)

    def add(self, rows: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        """Takes rows; yields the segments written meanwhile."""
        n = rows.num_rows
        order = self.seen + 1 + np.arange(n)
        taken = np.flatnonzero(self.rng.random(n) * order < self.size)
        self.seen += n
        for i, at in zip(taken.tolist(), order[taken].tolist(), strict=True):
            # a full sample loses one member at random: one still in the buffer is replaced there, any other later
            if at > self.size and self.draw.random() * self.size < len(self.held):
                self.held[self.draw.randrange(len(self.held))] = (rows, i)
            else:
                self.held.append((rows, i))
                if len(self.held) == self.buffer:
                    yield self.flush()

    def flush(self) -> tuple[int, pa.RecordBatch]:
        """Writes the buffer as the next segment: (its number, its rows in random order)."""
        excess = max(0, sum(self.live) + len(self.held) - self.size)
        if excess:
            self.live = (np.asarray(self.live) - hypergeometric(np.asarray(self.live), excess, self.draw)).tolist()
        of: dict[int, tuple[pa.RecordBatch, list[int]]] = {}
        for batch, i in self.held:
            of.setdefault(id(batch), (batch, []))[1].append(i)
        rows = pa.Table.from_batches([b.take(pa.array(i)) for b, i in of.values()])
        rows = rows.take(pa.array(self.rng.permutation(rows.num_rows))).combine_chunks().to_batches()[0]
        self.live.append(len(self.held))
        self.held = []
        return len(self.live) - 1, rows


def _seed(*of) -> int:
    return zlib.crc32(repr(of).encode())


def fixed_size_sample(df: DataFrame, size: int, key: str, group: str, columns: list[str], buffer: int = 4096, seed: int = 17, shards: int | None = None) -> DataFrame:
    """``size`` records of each ``group`` (all if there are fewer), every distinct ``key`` equally likely.

    Columns: ``group``, ``key``, ``columns``, ``population`` (distinct keys of the group). A group's records are spread by key
    over ``shards`` shards (by default as many as its rows need, see ``SHARD_ROWS``: one for most), so copies of a record meet
    and count once, a group that holds most records is shared by all tasks, and shards grow with the rows, not with groups
    times tasks. Each shard of a group has a ``GeometricFile``, and a task one open at a time. For groups of several shards a
    population-weighted hypergeometric draw says how many records each shard, and in it each segment, gives; as segments are in
    random order those are its first ones. A single shard gives all that lives. The same input, seed and ``shards`` give the
    same sample, whatever the session's partitions.

    Totals told elsewhere aren't used. Rows whose key or group is null are no records of a group and are left out; other
    nulls are kept. Records with other keys but equal content are different. An empty table gives no rows.
    """
    if size < 1:
        raise ValueError("size must be 1 or more")
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("__g"), F.col(key).alias("__k"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    if shards:
        rows = rows.withColumn("__of", F.lit(shards))
    else:
        large = rows.groupBy("__g").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(SHARD_ROWS, 16 * size))).cast("int").alias("__of")).where(F.col("__of") > 1)
        rows = lookup_join(rows, written(large, "large-groups"), ["__g"], F.col("__k")).fillna(1, ["__of"])
    rows = rows.select("__g", F.pmod(F.xxhash64("__k"), F.col("__of")).cast("int").alias("__shard"), "__of", "__k", *[f"__c{i}" for i in range(len(columns))])
    rows = rows.repartition(shuffle_partitions(spark), "__g", "__shard").sortWithinPartitions("__g", "__shard", "__k")
    payload = [T.StructField(f.name, f.dataType, True) for f in rows.schema]  # rows that tell of segments have nulls
    extra = [T.StructField("__segment", T.IntegerType()), T.StructField("__pos", T.LongType()), T.StructField("__live", T.LongType()), T.StructField("__seen", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, now, of, last, ready = None, None, None, None, []
        schema = None

        def batch(rows_, n, segment=None, pos=None, live=None, seen=None):
            cols = list(rows_.columns) if rows_ is not None else [pa.array([x] * n, f.type) for x, f in zip((*now, of), schema, strict=False)] + [pa.nulls(n, f.type) for f in list(schema)[3:]]
            whole = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
            cols += [whole(segment, pa.int32()), whole(pos, pa.int64()), whole(live, pa.int64()), whole(seen, pa.int64())]
            ready.append(pa.RecordBatch.from_arrays(cols, [*schema.names, *[f.name for f in extra]]))

        def segment(number, rows_):
            n = rows_.num_rows
            batch(rows_, n, [number] * n, range(n))

        def close():
            if file is not None:
                if file.held:
                    segment(*file.flush())
                batch(None, len(file.live), range(len(file.live)), None, file.live, [file.seen] * len(file.live))

        for (g, shard), piece in runs(batches, 2):
            schema = piece.schema
            if file is None or (g, shard) != now:
                close()
                file, now, of, last = GeometricFile(size, buffer, _seed(seed, shard, g)), (g, shard), piece.column(2)[0].as_py(), None
            keys = piece.column(3).to_numpy(zero_copy_only=False)
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            fresh[0] = last is None or keys[0] != last
            last = keys[-1]
            for number, written_rows in file.add(piece if fresh.all() else piece.filter(pa.array(fresh))):
                segment(number, written_rows)
                yield from gathered(ready, 20_000)
            yield from gathered(ready, 20_000)
        close()
        yield from gathered(ready, 0, last=True)

    log = written(rows.mapInArrow(run, T.StructType([*payload, *extra])), "geometric-file")

    def draw(key_: tuple, strata: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(_seed(seed, -1, key_[0]))
        strata = strata.sort_values(["__shard", "__segment"])
        first = strata.drop_duplicates("__shard")
        taken = hypergeometric(first["__seen"].to_numpy(), size, rng)
        take = []
        for n, (_, segments) in zip(taken.tolist(), strata.groupby("__shard", sort=False), strict=True):
            take += hypergeometric(segments["__live"].to_numpy(), n, rng).tolist()
        return strata[["__g", "__shard", "__segment"]].assign(take=take, population=int(first["__seen"].sum()))

    strata = log.where(F.col("__live").isNotNull()).select("__g", "__shard", "__segment", "__live", "__seen", "__of")
    drawn = (
        strata.where(F.col("__of") > 1).drop("__of").groupBy("__g")
        .applyInPandas(draw, T.StructType([*payload[:2], extra[0], T.StructField("take", T.LongType()), T.StructField("population", T.LongType())]))
    )
    whole = strata.where(F.col("__of") == 1).select("__g", "__shard", "__segment", F.col("__live").alias("take"), F.col("__seen").alias("population"))
    takes = written(whole.unionByName(drawn), "takes")
    found = lookup_join(log.where(F.col("__live").isNull()), takes, ["__g", "__shard", "__segment"], F.col("__k"), "inner").where(F.col("__pos") < F.col("take"))
    return found.select(F.col("__g").alias(group), F.col("__k").alias(key), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)], "population")
