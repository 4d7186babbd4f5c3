"""Jobs by name: a map, a reduce and a partition step, composed into one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tokens
from millrace.functions.hashing import hashed_key
from millrace.operators import graph, partitioning, sessions, sorting, text
from millrace.sources import kv
from millrace.sources.text import text_lines

Step = Callable[..., DataFrame]
MAPS: dict[str, Step] = {}
REDUCES: dict[str, Step] = {}
PARTITIONS: dict[str, Step] = {}


def register(kind: dict[str, Step], name: str) -> Callable[[Step], Step]:
    """Makes a step known by name: (DataFrame, **parameters) -> DataFrame."""

    def keep(f: Step) -> Step:
        if name in kind:
            raise ValueError(f"{name} is taken")
        kind[name] = f
        return f

    return keep


@dataclass(frozen=True)
class Job:
    """Where the rows come from and go to, and the steps between. Names that aren't registered are refused when the job is made. ``params`` has the steps' parameters as ``step.parameter``."""

    source: str
    sink: str | None = None
    map: str = "pass_through"
    reduce: str = "identity"
    partition: str = "hash"
    params: dict = field(default_factory=dict)
    format: str = "parquet"

    def __post_init__(self):
        for kind, name in ((MAPS, self.map), (REDUCES, self.reduce), (PARTITIONS, self.partition)):
            if name not in kind:
                raise ValueError(f"unknown step {name}; there are {sorted(kind)}")

    def plan(self, rows: DataFrame) -> DataFrame:
        own = lambda step: {k[len(step) + 1 :]: v for k, v in self.params.items() if k.startswith(step + ".")}
        mapped = MAPS[self.map](rows, **own(self.map))
        reduced = REDUCES[self.reduce](mapped, **own(self.reduce))
        return PARTITIONS[self.partition](reduced, **own(self.partition))


def run_batches(spark: SparkSession, jobs: Job | list, read: Callable[[str], DataFrame] | None = None) -> list[DataFrame]:
    """A job; a list of jobs that go together; or a list of lists that go one after another. Jobs of one batch that
    read the same source share one scan, which is kept for the batch. Results are written where a job has a sink."""
    batches = [[jobs]] if isinstance(jobs, Job) else [jobs] if jobs and isinstance(jobs[0], Job) else jobs
    read = read or (lambda path: spark.read.parquet(path))
    results = []
    for batch in batches:
        uses = [j.source for j in batch]
        sources = {}
        for s in set(uses):
            sources[s] = read(s).persist() if uses.count(s) > 1 else read(s)
        for job in batch:
            out = job.plan(sources[job.source])
            if job.sink:
                out.write.format(job.format).save(job.sink)
                out = spark.read.format(job.format).schema(out.schema).load(job.sink)
            results.append(out)
        if all(j.sink for j in batch):
            for s in sources.values():
                s.unpersist()
    return results


@register(MAPS, "pass_through")
def pass_through(df: DataFrame) -> DataFrame:
    return df


@register(MAPS, "zero_key")
def zero_key(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.lit("").alias("key"), F.col(value).alias("value"))


@register(MAPS, "bytes_count")
def bytes_count(df: DataFrame, key: str, size: int) -> DataFrame:
    return df.select(F.substring(F.col(key).cast("binary"), 1, size).cast("string").alias("key"), F.lit(1).cast("bigint").alias("value"))


@register(MAPS, "grep")
def grep(df: DataFrame, value: str, selectivity: float) -> DataFrame:
    return text.grep_selectivity(df, value, selectivity)


@register(MAPS, "word_count")
@register(MAPS, "combining_word_count")
def map_words(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.explode(tokens.words(F.col(value))).alias("key"), F.lit(1).cast("bigint").alias("value"))


@register(MAPS, "lines")
def map_lines(df: DataFrame, key: str, value: str) -> DataFrame:
    return text_lines(df, key, value).select("key", "line")


@register(MAPS, "line_words")
def map_line_words(df: DataFrame, key: str, value: str) -> DataFrame:
    return map_words(text_lines(df, key, value), "line")


@register(MAPS, "line_ngrams")
def map_line_ngrams(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    return map_ngrams(text_lines(df, key, value), "line", n)


@register(MAPS, "consecutive_pairs")
def map_pairs(df: DataFrame, stream: str, pos: str, fragment: str) -> DataFrame:
    return kv.consecutive_pairs(df, stream, pos, fragment)


@register(MAPS, "ngram")
def map_ngrams(df: DataFrame, value: str, n: int) -> DataFrame:
    return df.select(F.explode(tokens.word_ngrams(F.col(value), n)).alias("key"), F.lit(1).cast("bigint").alias("value"))


@register(MAPS, "inverted_index")
def map_index(df: DataFrame, doc: str, value: str, size: int) -> DataFrame:
    return text.inverted_index(df, doc, value, size)


@register(MAPS, "tuple_lengths")
def map_lengths(df: DataFrame, key: str, value: str) -> DataFrame:
    return text.tuple_length_count(df, key, value).select(F.concat_ws(":", "kind", "length").alias("key"), F.col("cnt").alias("value"))


@register(MAPS, "page_links")
def map_links(df: DataFrame, line: str) -> DataFrame:
    return text.page_links(df, line)


@register(MAPS, "page_texts")
def map_texts(df: DataFrame, line: str) -> DataFrame:
    return text.page_texts(df, line)


@register(MAPS, "parse_adjacency")
def map_adjacency(df: DataFrame, line: str, most: int) -> DataFrame:
    return graph.parse_adjacency(df, line, most)


@register(MAPS, "ratio")
@register(REDUCES, "ratio")
def ratio(df: DataFrame, keys: list[str], ratio: float, seed: int = 3) -> DataFrame:
    """Each row as often as ``ratio``: its whole part, and once more with its fraction as probability, told by a hash of the row's keys; each copy with a random key of its own."""
    whole = int(ratio)
    u = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.lit(whole) + F.when(u < ratio - whole, 1).otherwise(0)
    return df.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).withColumn("new_key", F.xxhash64(F.lit(seed + 1), *keys, "copy"))


@register(REDUCES, "identity")
def identity(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    return sorting.total_sort(df, order) if order else df


@register(REDUCES, "sum_values")
@register(REDUCES, "word_count")
def sum_values(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(F.sum("value").alias("value"))


@register(REDUCES, "page_rank")
def reduce_ranks(df: DataFrame, rounds: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rounds of ranks over the edges, all vertices being equal at first."""
    edges = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    ids = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct()
    return graph.page_rank(edges, ids.withColumn("rank", F.lit(1.0 / max(1, ids.count()))), rounds)


@register(REDUCES, "count_duplicates")
def count_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)


@register(REDUCES, "postings")
def reduce_postings(df: DataFrame) -> DataFrame:
    return text.postings(df)


@register(REDUCES, "neighbours")
def reduce_neighbours(df: DataFrame, most: int) -> DataFrame:
    return graph.gather_neighbours(df, most)


@register(REDUCES, "adjacency")
def reduce_adjacency(df: DataFrame, source: str = "page", target: str = "target") -> DataFrame:
    return graph.adjacency(df, source, target)


@register(REDUCES, "click_sessions")
def reduce_sessions(df: DataFrame, user: str, ts: str, url: str, threshold_us: int, tie: list[str] | None = None) -> DataFrame:
    return sessions.click_sessions(df, user, ts, url, threshold_us, tie=tie)


@register(PARTITIONS, "hash")
def hash_partition(df: DataFrame, key: str | None = None, partitions: int | None = None) -> DataFrame:
    return df.repartition(*[x for x in (partitions, key) if x is not None]) if key else df


@register(PARTITIONS, "range")
def range_partition(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    return df.repartitionByRange(*[x for x in (partitions, key) if x is not None])


@register(PARTITIONS, "boundaries")
def boundary_partition(df: DataFrame, key: str, weight: str, partitions: int, order: list[str] | None = None) -> DataFrame:
    """Parts of equal weight by boundaries of the keys, partition i in task i, sorted by ``order``."""
    return _by_boundaries(df, partitioning.range_boundaries(df, key, weight, partitions), F.col(key), partitions, order or [key])


@register(PARTITIONS, "hashed_boundaries")
def hashed_partition(df: DataFrame, key: str, weight: str, partitions: int, order: list[str] | None = None) -> DataFrame:
    """The same by boundaries of the keys' hashes."""
    return _by_boundaries(df, partitioning.hashed_boundaries(df, key, weight, partitions), hashed_key(F.col(key).cast("binary")), partitions, order or [key])


def _by_boundaries(df: DataFrame, boundaries: DataFrame, key, partitions: int, order: list[str]) -> DataFrame:
    cut = [r["key"] for r in boundaries.orderBy("index").collect()]  # at most one per partition
    return partitioning.into_partitions(df.withColumn("partition", partitioning.partition_of(key, cut)), "partition", partitions, order)


@register(PARTITIONS, "uniform")
def uniform(df: DataFrame, key: str, partitions: int, order: list[str] | None = None) -> DataFrame:
    numbered = df.withColumn("partition", partitioning.uniform_partition(F.col(key), partitions))
    return partitioning.into_partitions(numbered, "partition", partitions, order)


@register(PARTITIONS, "single")
def single(df: DataFrame) -> DataFrame:
    """All in one file; only for results that fit one."""
    return df.coalesce(1)


def sort_job(source: str, sink: str | None, key: str, weight: str, partitions: int, order: list[str] | None = None) -> Job:
    """All rows sorted: parts of equal weight by sampled boundaries, each sorted."""
    return Job(source, sink, partition="boundaries", params={"boundaries.key": key, "boundaries.weight": weight, "boundaries.partitions": partitions, "boundaries.order": order or [key]})


def fast_sort_job(source: str, sink: str | None, key: str, partitions: int, order: list[str] | None = None) -> Job:
    """The same for keys that are uniform in their first bytes: no rows are looked at beforehand."""
    return Job(source, sink, partition="uniform", params={"uniform.key": key, "uniform.partitions": partitions, "uniform.order": order or [key]})


def word_count_job(source: str, sink: str | None, key: str, text: str) -> Job:
    return Job(source, sink, "line_words", "word_count", params={"line_words.key": key, "line_words.value": text})


def ngram_count_job(source: str, sink: str | None, key: str, text: str, n: int) -> Job:
    return Job(source, sink, "line_ngrams", "word_count", params={"line_ngrams.key": key, "line_ngrams.value": text, "line_ngrams.n": n})


def page_rank_job(source: str, sink: str | None, rounds: int) -> Job:
    return Job(source, sink, reduce="page_rank", params={"page_rank.rounds": rounds})


def click_sessions_job(source: str, sink: str | None, user: str, ts: str, url: str, threshold_us: int, tie: list[str] | None = None) -> Job:
    return Job(source, sink, reduce="click_sessions", params={"click_sessions.user": user, "click_sessions.ts": ts, "click_sessions.url": url, "click_sessions.threshold_us": threshold_us, "click_sessions.tie": tie})


def link_graph_job(source: str, sink: str | None, line: str) -> Job:
    return Job(source, sink, "page_links", "adjacency", params={"page_links.line": line})


def text_extraction_job(source: str, sink: str | None, line: str) -> Job:
    return Job(source, sink, "page_texts", params={"page_texts.line": line})


def merge_job(source: str, sink: str | None) -> Job:
    """Many files as one."""
    return Job(source, sink, partition="single")


def sum_values_job(source: str, sink: str | None, value: str) -> Job:
    return Job(source, sink, "zero_key", "sum_values", "single", params={"zero_key.value": value})


def tuple_lengths_jobs(source: str, counts: str, sink: str | None, key: str, value: str) -> list[list[Job]]:
    """Lengths counted, then merged into one file."""
    return [[Job(source, counts, "tuple_lengths", "sum_values", params={"tuple_lengths.key": key, "tuple_lengths.value": value})], [merge_job(counts, sink)]]


def duplicates_jobs(source: str, counts: str, sink: str | None, stream: str, pos: str, fragment: str) -> list[list[Job]]:
    """Overlapping pairs of fragments that come more than once, then merged into one file."""
    params = {"consecutive_pairs.stream": stream, "consecutive_pairs.pos": pos, "consecutive_pairs.fragment": fragment, "count_duplicates.keys": ["key"]}
    return [[Job(source, counts, "consecutive_pairs", "count_duplicates", params=params)], [merge_job(counts, sink)]]
