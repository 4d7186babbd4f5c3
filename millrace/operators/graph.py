"""Building graphs and passing ranks along them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.lookup import lookup_join
from millrace.tables import bucketed, shuffle_partitions, written


def parse_adjacency(df: DataFrame, line: str, most: int) -> DataFrame:
    """Vertices from lines ``id n neighbour…``: id, nbrs (the first ``most``). A line whose n isn't its number of neighbours is an error."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    right = F.size(parts) - 2 == parts[1].cast("int")
    checked = F.when(right, parts).otherwise(F.raise_error(F.concat(F.lit("adjacency line with a wrong count: "), F.left(F.col(line), F.lit(80)))))
    return df.select(checked.alias("p")).select(F.col("p")[0].cast("bigint").alias("id"), F.transform(F.slice("p", 3, most), lambda x: x.cast("bigint")).alias("nbrs"))


def adjacency(edges: DataFrame, source: str, target: str, block: int = 100_000) -> DataFrame:
    """A vertex per source with the list of its targets, repeated ones kept: id, block, nbrs, rank (1).

    Lists are of about ``block`` targets at most: a source with more has several rows, numbered by ``block`` and filled by a hash of the target and the edge's place, so no task holds
    a list without bound. Most sources have the one block 0.
    """
    counts = edges.groupBy(source).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block).select(source, F.ceil(F.col("__n") / block).cast("int").alias("__blocks"))
    cut = lookup_join(edges, counts, [source], F.col(target))
    # copies of one edge are spread too
    own = F.pmod(F.xxhash64(target, F.monotonically_increasing_id()), F.coalesce("__blocks", F.lit(1))).cast("int")
    rows = cut.select(F.col(source).alias("id"), own.alias("block"), F.col(target).alias("__t"))
    return rows.groupBy("id", "block").agg(F.array_sort(F.collect_list("__t")).alias("nbrs"), F.lit(1.0).alias("rank"))


def page_rank(edges: DataFrame, vertices: DataFrame, iterations: int, checkpoint_every: int = 5, block_edges: int = 1_000_000) -> DataFrame:
    """Ranks after so many rounds, without damping: id, degree, rank. ``edges``: src, dst (repeated ones count each); ``vertices``: id, rank.

    A vertex gives its rank in equal parts to its neighbours, or to itself if it has none; one that is only pointed to becomes a
    vertex, one that nothing is given to has rank 0.

    Edges are written once, bucketed by source and block; a vertex of more than ``block_edges`` edges has several blocks, so that none with a third of all edges falls to one task. A round
    then reads them where they lie, sends only partial sums by target, together with a row of structure (degree) per vertex, and adds both up in one aggregate: the plan grows by one join and one
    aggregate a round. Every ``checkpoint_every`` rounds the ranks are written, which ends their lineage.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("out")).unionAll(edges.select("dst", F.lit(0))).unionAll(vertices.select("id", F.lit(0)))
    structure = written(ends.groupBy("id").agg(F.sum("out").cast("bigint").alias("degree")), "vertices")
    blocks = lambda degree: F.greatest(F.ceil(degree / block_edges), F.lit(1)).cast("int")
    placed = edges.select("src", "dst")
    hot = structure.where(F.col("degree") > block_edges).select(F.col("id").alias("src"), blocks(F.col("degree")).alias("blocks"))  # fewer than edges / block_edges
    placed = placed.join(F.broadcast(hot), "src", "left").select("src", F.pmod(F.xxhash64("dst"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), "dst")
    # a vertex without neighbours is its own
    alone = structure.where("degree = 0").select(F.col("id").alias("src"), F.lit(0).alias("block"), F.col("id").alias("dst"))
    placed = bucketed(placed.unionAll(alone), "edges", ["src", "block"], shuffle_partitions(spark))
    state = structure.join(vertices.select("id", "rank"), "id", "left").select("id", "degree", F.coalesce("rank", F.lit(0.0)).alias("rank"))
    for i in range(iterations):
        giving = state.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), blocks(F.col("degree")) - 1)).alias("block"), (F.col("rank") / F.greatest("degree", F.lit(1))).alias("part"))
        parts = placed.join(giving, ["src", "block"]).select(F.col("dst").alias("id"), "part", F.lit(0).cast("bigint").alias("degree"))
        every = structure.select("id", F.lit(0.0).alias("part"), "degree")
        state = parts.unionAll(every).groupBy("id").agg(F.max("degree").alias("degree"), F.sum("part").alias("rank"))
        if (i + 1) % checkpoint_every == 0 and i + 1 < iterations:
            state = written(state, "ranks")
    return state


def random_graph(spark: SparkSession, vertices: int, edge_probability: float, most: int, seed: int = 1, tasks: int | None = None) -> DataFrame:
    """Vertices with random neighbours: id, nbrs, rank (1 / vertices). The degree is binomial, but at most ``most`` and ``vertices``; with a probability of 1 it is
    just that. Neighbours are uniform and may repeat or be the vertex itself. All is drawn from hashes of the vertex, so the graph doesn't depend on the number of tasks."""
    cap = min(vertices, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            if edge_probability >= 1:
                n = np.full(len(ids), cap)
            else:
                # a binomial number from the uniform one that the vertex' hash is
                n = np.minimum(cap, np.searchsorted(upto, _uniform(ids, seed, np.zeros(len(ids), np.int64)), side="right"))
            offsets = np.append(0, np.cumsum(n))
            nth = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
            nbrs = (_uniform(np.repeat(ids, n), seed, nth + 1) * vertices).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.minimum(nbrs, vertices - 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(np.full(len(ids), 1.0 / vertices))], ["id", "nbrs", "rank"])

    upto = _binomial(vertices, edge_probability, cap)
    return spark.range(0, vertices, 1, tasks or spark.sparkContext.defaultParallelism).mapInArrow(run, "id bigint, nbrs array<bigint>, rank double")


def _binomial(n: int, p: float, most: int) -> np.ndarray:
    """The probabilities of at most 0, 1, … ``most`` - 1 hits among ``n``."""
    if not 0 < p < 1:
        return np.full(most, 1.0 if p <= 0 else 0.0)
    logs = [n * math.log1p(-p)]
    for k in range(1, most):
        logs.append(logs[-1] + math.log(n - k + 1) - math.log(k) + math.log(p) - math.log1p(-p))
    return np.cumsum(np.exp(logs))


def _uniform(ids: np.ndarray, seed: int, nth: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each id and place, the same in every task."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
        for shift, by in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        return ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def power_law_degrees(vertices: int, least: int, most: int) -> dict[int, int]:
    """Vertices per degree, in proportion to 1 / degree², rounded; what rounding leaves over goes to the least degree."""
    total = sum(1.0 / (d * d) for d in range(least, most + 1))
    out = {d: math.floor(1.0 / (d * d) / total * vertices + 0.5) for d in range(least, most + 1)}
    out[least] += vertices - sum(out.values())
    return out


def power_law_graph(spark: SparkSession, vertices: int, least: int, most: int, seed: int = 1, tasks: int | None = None) -> DataFrame:
    """Vertices whose numbers of incoming edges follow a power law: id, nbrs, rank.

    Each vertex of in-degree d draws d sources at random; gathered by source these are the neighbour lists, cut at ``most``. Edges are drawn in
    the plan (a range, exploded), so any number of vertices is spread over the tasks.
    """
    counts = power_law_degrees(vertices, least, most)
    ends, upto = [], 0
    for d, n in counts.items():
        upto += n
        ends.append((upto, d))
    v = F.col("id")
    degree = F.lit(0)
    for end, d in reversed(ends):
        degree = F.when(v < end, F.lit(d)).otherwise(degree)
    drawn = spark.range(0, vertices, 1, tasks or spark.sparkContext.defaultParallelism).select(v.alias("target"), F.explode(F.sequence(F.lit(1), degree)).alias("k"))
    edges = drawn.select(F.pmod(F.xxhash64(F.lit(seed), "target", "k"), F.lit(vertices)).alias("id"), "target")
    lists = gather_neighbours(edges, most)
    everyone = spark.range(0, vertices, 1)
    return everyone.join(lists, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"), F.lit(1.0 / vertices).alias("rank"))


def gather_neighbours(edges: DataFrame, most: int) -> DataFrame:
    """The first ``most`` targets of each id, in order: id, nbrs. Rows (id, target) are ranked and cut before a list is made of them, so that lists stay short whatever an id has."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("target"))
    return edges.withColumn("__nr", rank).where(F.col("__nr") <= most).groupBy("id").agg(F.array_sort(F.collect_list("target")).alias("nbrs"))
