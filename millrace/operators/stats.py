"""The log and statistics layer: filters, summaries, roll-ups, histograms, series and rates over stat lines.

A stat table has a row per logged value; the dimensions job, phase, epoch, host, stage and worker and the statistic's name are columns.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.lookup import lookup_join, null_safe_join
from millrace.operators.partitioning import running_sum

_TYPES = {"int": T.LongType(), "uint": T.LongType(), "str": T.StringType()}


@dataclass(frozen=True)
class LineType:
    """A kind of log line: its type, and the fields behind it with int, uint or str."""

    name: str
    fields: tuple[tuple[str, str], ...]

    @staticmethod
    def load(text: str) -> list[LineType]:
        """From JSON: a list of {type, fields: [{name, type}]}."""
        return [LineType(d["type"], tuple((f["name"], f["type"]) for f in d["fields"])) for d in json.loads(text)]

    def matches(self, names: list[str]) -> bool:
        """Whether ``names`` are the first fields."""
        return [n for n, _ in self.fields[: len(names)]] == names

    def read(self, df: DataFrame, line: str) -> DataFrame:
        """The typed columns of those tab-separated lines that are of this kind; a field that isn't of its type is null."""
        parts = F.split(F.col(line), "\t")
        rows = df.where((parts[0] == self.name) & (F.size(parts) == len(self.fields) + 1))
        return rows.select(*[parts[i + 1].try_cast(_TYPES[t]).alias(n) for i, (n, t) in enumerate(self.fields)])


@dataclass(frozen=True)
class StatQuery:
    """Conditions per field, all of which must hold: None for any value, a number for equality, text for a regular expression that
    matches the whole value, a list for any of several."""

    where: dict[str, object] = field(default_factory=dict)

    def line_type(self, kinds: list[LineType]) -> LineType:
        """The one kind of line whose first fields are this query's; ValueError if there is none or more than one."""
        found = [k for k in kinds if k.matches(list(self.where))]
        if len(found) != 1:
            raise ValueError(f"{len(found)} line types have the fields {list(self.where)}")
        return found[0]

    def condition(self) -> Column:
        out = F.lit(True)
        for name, wanted in self.where.items():
            out = out & _matches(F.col(name), wanted)
        return out

    def pattern(self, kind: LineType) -> str:
        """The regular expression for a whole raw line."""
        part = lambda x: "[^\t]*" if x is None else "(?:" + "|".join(map(part, x)) + ")" if isinstance(x, (list, tuple)) else str(x)
        return "\t".join([re.escape(kind.name), *[part(self.where.get(n)) for n, _ in kind.fields]])


def _matches(column: Column, wanted) -> Column:
    if wanted is None:
        return F.lit(True)
    if isinstance(wanted, (list, tuple)):
        out = F.lit(False)
        for w in wanted:
            out = out | _matches(column, w)
        return out
    return column == wanted if isinstance(wanted, int) else column.rlike(f"^(?:{wanted})$")


def plot_query(spec: str) -> StatQuery:
    """The query of host.phase.stage.worker.stat or host.phase.logger.stat, where * stands for any value or part of one. ValueError for any other number of parts."""
    parts = spec.split(".")
    names = {5: ("hostname", "phase_name", "stage_name", "worker_id", "stat_name"), 4: ("hostname", "phase_name", "logger", "stat_name")}.get(len(parts))
    if names is None:
        raise ValueError(f"no plot spec: {spec}")
    value = lambda p: None if p == "*" else int(p) if p.isdigit() else p.replace("*", ".*?")
    return StatQuery({n: value(p) for n, p in zip(names, parts, strict=True)})


def stat_filter(df: DataFrame, query: StatQuery) -> DataFrame:
    return df.where(query.condition())


def ranked_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distinct values of each key in order: keys, value, __n (how often it comes), __cum (values of the key at or below it) and __all (values of the key).

    Values are counted per key and value first, so a key with most rows sends only its distinct values. These are then ranged over the tasks by key and
    value and summed up across them, so a key with most of the distinct values is shared by many tasks. Null values don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    rows = running_sum(counts, [*keys, value], "__n", "__ahead")
    totals = rows.groupBy(*keys).agg(F.min("__ahead").alias("__start"), F.sum("__n").alias("__all"))
    joined = lookup_join(rows, totals, keys, F.col(value), "inner", null_safe=True)
    return joined.withColumn("__cum", F.col("__ahead") + F.col("__n") - F.col("__start")).drop("__ahead", "__start")


def _holds(at: Column) -> Column:
    """Whether the element number ``at``, from 0, of the key's ordered values has this value."""
    return (F.col("__cum") > at) & (F.col("__cum") - F.col("__n") <= at)


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The element at half the number of values, from 0, of the ordered values per key."""
    return ranked_values(df, keys, value).where(_holds(F.floor(F.col("__all") / 2))).select(*keys, F.col(value).alias(name))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """least, most, total, n, mean (cut to a whole number, as for whole values), median (the upper one) and population variance per key; null values don't count.

    The variance of whole values comes from exact sums, so it doesn't depend on the order of the rows.
    """
    rows = df.where(F.col(value).isNotNull())
    v = F.col(value)
    stats = rows.groupBy(*keys).agg(F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"), F.count(v).alias("n"), exact_variance(df, value).alias("variance"))
    stats = stats.withColumn("mean", F.floor(F.col("total") / F.col("n")))
    return null_safe_join(stats, upper_median(rows, keys, value), keys)


def exact_variance(df: DataFrame, value: str) -> Column:
    """The population variance. Of whole values it is (n Σv² - (Σv)²) / n² from exact sums, hence the same in any order of rows; where these pass 38 digits, and of doubles, the running one."""
    v = F.col(value)
    if df.schema[value].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return F.var_pop(v)
    d = v.cast("decimal(19,0)")
    n, s, q = F.count(v), F.try_sum(d).cast("decimal(38,0)"), F.try_sum(d * d)
    exact = F.try_subtract(F.try_multiply(q, n.cast("decimal(18,0)")), F.try_multiply(s, s)).cast("double") / n.cast("double") / n.cast("double")
    return F.coalesce(exact, F.var_pop(v))


def rollup(df: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """n, total, least and most at each of ``levels`` (lists of keys), with ``level`` for the number of keys; one pass and one shuffle of partial sums."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    v = F.col(value)
    out = df.where(v.isNotNull()).groupingSets([[F.col(k) for k in level] for level in levels], *keys)
    depth = sum((1 - F.grouping(k).cast("int") for k in keys), F.lit(0))
    return out.agg(depth.alias("level"), F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))


def pivot_stats(df: DataFrame, keys: list[str], stat: str, value: str, names: dict[str, str]) -> DataFrame:
    """One row per key with the sum of each statistic of ``names`` (its name -> column), 0 where it doesn't come."""
    return df.where(F.col(stat).isin(list(names))).groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(stat) == s, F.col(value))), F.lit(0)).cast("bigint").alias(c) for s, c in names.items()])


def derived_rates(df: DataFrame, pull: bool = False) -> DataFrame:
    """Adds to rows with bytes_in, bytes_out, runtime, idle, teardown, memory_wait, enqueue_block, saturation (times) and workers, nodes:

    io_multiplier (null without input), processing (of pull workers without idle and saturation), useful, the shares waiting for work, for memory, blocked and useful, the observed
    rate (bytes in per runtime), the ideal rate (what it would be if all time were useful), and both per worker and node. Without any processing time shares and rates are 0; nothing is below 0.
    """
    at_least_0 = lambda c: F.greatest(c, F.lit(0.0))
    c = {k: F.col(k).cast("double") for k in ("bytes_in", "bytes_out", "runtime", "idle", "teardown", "memory_wait", "enqueue_block", "saturation", "workers", "nodes")}
    processing = c["runtime"] + c["teardown"] + c["idle"]
    if pull:
        processing = processing - c["idle"] - c["saturation"]
    useful = processing - c["idle"] - c["memory_wait"] - c["enqueue_block"]
    part = lambda a: at_least_0(F.when(processing > 0, a / processing).otherwise(0.0))
    observed = F.when((processing > 0) & (c["runtime"] > 0), c["bytes_in"] / c["runtime"]).otherwise(0.0)
    ideal = F.when((processing > 0) & (useful != 0), observed / F.nullif(useful / processing, F.lit(0.0))).otherwise(0.0)
    per = lambda a, n: at_least_0(F.coalesce(a / F.nullif(c[n], F.lit(0.0)), F.lit(0.0)))
    return df.withColumns({
        "io_multiplier": F.when(c["bytes_in"] > 0, c["bytes_out"] / c["bytes_in"]),
        "processing": at_least_0(processing), "useful": at_least_0(useful),
        "share_waiting": part(c["idle"]), "share_memory": part(c["memory_wait"]), "share_blocked": part(c["enqueue_block"]), "share_useful": part(useful),
        "observed_rate": at_least_0(observed), "ideal_rate": at_least_0(ideal),
        "observed_rate_per_worker": per(observed, "workers"), "observed_rate_per_node": per(observed, "nodes"),
        "ideal_rate_per_worker": per(ideal, "workers"), "ideal_rate_per_node": per(ideal, "nodes"),
    })


def throughput(df: DataFrame, keys: list[str], read: Column, written: Column, start: str, stop: str) -> DataFrame:
    """Per key: input_bytes, output_bytes, the time from the first start to the last stop in microseconds, and MB/s of the larger (null if no time passed)."""
    out = df.groupBy(*keys).agg(F.coalesce(F.sum(read), F.lit(0)).cast("bigint").alias("input_bytes"), F.coalesce(F.sum(written), F.lit(0)).cast("bigint").alias("output_bytes"), (F.max(micros(stop)) - F.min(micros(start))).alias("total_us"))
    return out.withColumn("mb_per_s", F.greatest("input_bytes", "output_bytes") / F.nullif(F.col("total_us"), F.lit(0)))


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def size_histogram(df: DataFrame, value: str, bin_size: int, every: int = 1) -> DataFrame:
    """Values per bin of ``bin_size``, named by its lower end: bin, cnt. With ``every`` only each so-manieth row of a task counts, from its first; no row moves for that."""
    if every > 1:
        df = df.withColumn("__id", F.monotonically_increasing_id()).where(F.pmod(F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(every)) == 0)
    return df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / bin_size) * bin_size).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def merge_histograms(df: DataFrame, bin_: str, count: str) -> DataFrame:
    """Histograms of several hosts and workers as one: the counts of each bin added up."""
    return df.groupBy(bin_).agg(F.sum(count).alias(count))


def list_series(df: DataFrame, phase: str, stage: str, worker: str, stat: str) -> DataFrame:
    """The series there are, ordered by phase, stage, statistic and worker."""
    return df.select(phase, stage, worker, stat).distinct().orderBy(phase, stage, stat, worker)


def rebase(df: DataFrame, keys: list[str], ts: str, name: str = "seconds") -> DataFrame:
    """Adds the seconds since the first time of the row's key. First times are aggregated and joined back, so no key's rows are gathered."""
    first = df.groupBy(*keys).agg(F.min(micros(ts)).alias("__first"))
    return null_safe_join(df, first, keys).withColumn(name, (micros(ts) - F.col("__first")) / 1e6).drop("__first")


def cdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key and distinct value the share of values at or below it: keys, value, share."""
    return ranked_values(df, keys, value).select(*keys, F.col(value).alias("value"), (F.col("__cum") / F.col("__all")).alias("share"))


def completion_timeline(df: DataFrame, phase: str, keys: list[str], ts: str) -> DataFrame:
    """Per phase and key the first and last time, in seconds from the phase's first: phase, keys, start_s, stop_s."""
    ends = df.groupBy(phase, *keys).agg(F.min(micros(ts)).alias("a"), F.max(micros(ts)).alias("b"))
    first = ends.groupBy(phase).agg(F.min("a").alias("__first"))
    return null_safe_join(ends, first, [phase]).select(phase, *keys, ((F.col("a") - F.col("__first")) / 1e6).alias("start_s"), ((F.col("b") - F.col("__first")) / 1e6).alias("stop_s"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, population standard deviation, skewness, excess kurtosis and upper median per key."""
    v = F.col(value)
    stats = df.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    return null_safe_join(stats, upper_median(df, keys, value), keys)


def flow_throughput(df: DataFrame, sender: str, peer: str, flow: str, size: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """Per flow its bytes, seconds and MB/s; per peer all its bytes over the seconds of its longest flow. Flows that took no time have no rate."""
    flows = df.groupBy(sender, peer, flow).agg(F.sum(size).alias("bytes"), ((F.max(micros(ts)) - F.min(micros(ts))) / 1e6).alias("seconds"))
    rate = lambda b, s: b / 1e6 / F.nullif(s, F.lit(0.0))
    peers = flows.groupBy(peer).agg(F.sum("bytes").alias("bytes"), F.max("seconds").alias("seconds"))
    return flows.withColumn("mb_per_s", rate(F.col("bytes"), F.col("seconds"))), peers.withColumn("mb_per_s", rate(F.col("bytes"), F.col("seconds")))


def completion_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and interpolated median per key; both from counts per value."""
    rows = ranked_values(df, keys, value)
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    return rows.groupBy(*keys).agg(
        F.sum("__n").alias("n"), (F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"),
        ((F.max(F.when(_holds(low), F.col(value))) + F.max(F.when(_holds(high), F.col(value)))) / 2).alias("median"),
    )


def read_log(spark: SparkSession, path: str, kinds: list[LineType]) -> dict[str, DataFrame]:
    """Log files as a typed table per kind of line."""
    lines = spark.read.text(path)
    return {k.name: k.read(lines, "value") for k in kinds}
