"""k-means over integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre by squared distance in whole numbers; of equally near ones the first."""
    best, at = None, None
    for i, c in enumerate(centres):
        d = ((points - c) ** 2).sum(1)
        if best is None:
            best, at = d, np.zeros(len(points), np.int32)
        else:
            closer = d < best
            best[closer], at[closer] = d[closer], i
    return at


def assign(points: DataFrame, id_col: str, vector: str, centres: list[list[int]]) -> DataFrame:
    """The nearest centre of each point: id, centre (its number). The centres go along with the plan, k x dimension numbers; points aren't shuffled."""
    c = np.asarray(centres, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_nearest(_matrix(b.column(1)), c))], ["id", "centre"])

    return points.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), vector).mapInArrow(run, "id bigint, centre int")


def step(points: DataFrame, vector: str, centres: list[list[int]]) -> list[list[int]]:
    """New centres: per dimension the mean of a centre's points, cut to a whole number; a centre without points stays.

    Each task adds up its points per centre, so only k sums per task are shuffled.
    """
    c = np.asarray(centres, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                at = _nearest(m, c)
                np.add.at(sums, at, m)
                n += np.bincount(at, minlength=len(c))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["centre", "n", "sums"])

    parts = points.where(F.col(vector).isNotNull()).select(vector).mapInArrow(run, "centre int, n bigint, sums array<bigint>")
    n = parts.groupBy("centre").agg(F.sum("n").alias("n"))
    by_dim = parts.select("centre", F.posexplode("sums").alias("dim", "s")).groupBy("centre", "dim").agg(F.sum("s").alias("s"))
    out = [list(x) for x in centres]
    for r in by_dim.join(n, "centre").selectExpr("centre", "dim", "s div n as value").collect():  # k x dimension numbers
        out[r.centre][r.dim] = r.value
    return out


def iterate(points: DataFrame, vector: str, centres: list[list[int]], rounds: int) -> list[list[int]]:
    """``rounds`` steps, ended early when nothing changes any more."""
    for _ in range(rounds):
        new = step(points, vector, centres)
        if new == centres:
            break
        centres = new
    return centres


def first_centres(points: DataFrame, id_col: str, vector: str, k: int) -> list[list[int]]:
    """The vectors of the ``k`` least ids."""
    return [list(r[0]) for r in points.where(F.col(vector).isNotNull()).orderBy(id_col).limit(k).select(vector).collect()]


def as_table(spark: SparkSession, centres: list[list[int]]) -> DataFrame:
    """The centres as rows: centre, dim, value."""
    return spark.createDataFrame([(i, d, int(x)) for i, c in enumerate(centres) for d, x in enumerate(c)], "centre int, dim int, value bigint")


def random_points(spark: SparkSession, points: int, dimension: int, most: int, seed: int = 1) -> DataFrame:
    """Points with whole coordinates uniform below ``most``: id, coords. They don't depend on the number of tasks."""
    coords = F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda d: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), d), F.lit(most)))
    return spark.range(points).select("id", coords.alias("coords"))


def random_centres(k: int, dimension: int, most: int, seed: int = 1) -> list[list[int]]:
    """First centres for random points: ``k`` with whole coordinates uniform below ``most``."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, most, (k, dimension)).tolist()


def random_values(spark: SparkSession, data_bytes: int, dimension: int, seed: int = 1) -> DataFrame:
    """Tuples of random numbers that fill ``data_bytes``, each of 8 bytes for its header, 8 for its id and 8 per number: id, coords."""
    return random_points(spark, data_bytes // (8 * (dimension + 2)), dimension, 1 << 62, seed)
