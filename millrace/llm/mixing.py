"""Mixing sources to target shares of all tokens."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.runs import runs
from millrace.operators.lookup import lookup_join
from millrace.tables import spread, written

#: Where the public tokenizers' files are.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict = {}


def _encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content, made once per process."""
    key = zlib.crc32(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("millrace", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def clean_source(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (spelled evenly), tokens of the whole text; a null text has 0. The vocabulary file (some 100 kB) is read by the driver and sent along."""
    with open(tokenizer, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value).encode_ordinary_batch
        for b in batches:
            n = [len(x) for x in encode([t or "" for t in b.column(2).to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return spread(documents.where(F.col("doc_id").isNotNull()).select("doc_id", clean_source("source").alias("source"), "text")).mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def sainte_lague(weights: list[float] | np.ndarray, seats: int) -> np.ndarray:
    """``seats`` awarded one by one to the highest quotient weight / (2 k + 1), k being the seats a party has; ties go to the first.

    Instead of awarding them singly, a divisor is searched for with which rounding weight / divisor awards no more than
    ``seats``; the few that are left then go by highest quotient. Weights of 0 get none.
    """
    w = np.asarray(weights, float)
    out = np.zeros(len(w), np.int64)
    if seats <= 0 or not (w > 0).any():
        return out
    awarded = lambda d: np.floor(w / d + 0.5)
    low, high = w.sum() / (seats + len(w) + 1), w.sum() / max(seats - len(w), 0.25) + w.max() * 4
    for _ in range(200):
        d = (low + high) / 2
        if awarded(d).sum() <= seats:
            high = d
        else:
            low = d
    out = np.minimum(awarded(high * (1 + 1e-12)), seats).astype(np.int64)
    quotients = [(-x / (2 * k + 1), i) for i, (x, k) in enumerate(zip(w.tolist(), out.tolist(), strict=True)) if x > 0]
    heapq.heapify(quotients)
    for _ in range(int(seats - out.sum())):
        _, i = quotients[0]
        out[i] += 1
        heapq.heapreplace(quotients, (-w[i] / (2 * out[i] + 1), i))
    return out


def chosen(tokens: np.ndarray, quota: int, block_tokens: int) -> np.ndarray:
    """Which of the records, in their seeded order, fill ``quota`` tokens. The order is cut into blocks of about ``block_tokens``, a record belonging to the block in which it starts, and whole
    blocks are taken as long as they fit. What is left is filled with single records of the blocks behind, in order, each that still fits, and last with the shortest one left out if half of it fits: so the quota is met to within half a record."""
    start = np.cumsum(tokens) - tokens
    ends = np.flatnonzero(np.append(start[1:] // block_tokens != start[:-1] // block_tokens, True)) if len(tokens) else np.array([], int)
    upto = (start + tokens)[ends]
    blocks = int(np.searchsorted(upto, quota, side="right"))
    out = np.zeros(len(tokens), bool)
    out[: int(ends[blocks - 1]) + 1 if blocks else 0] = True
    left = quota - (int(upto[blocks - 1]) if blocks else 0)
    rest = np.flatnonzero(~out)
    while left > 0:
        rest = rest[tokens[rest] <= left]
        if not len(rest):
            break
        n = int(np.searchsorted(np.cumsum(tokens[rest]), left, side="right"))
        out[rest[:n]] = True
        left -= int(tokens[rest[:n]].sum())
        rest = rest[n:]
    rest = np.flatnonzero(~out)
    if len(rest):
        least = rest[np.argmin(tokens[rest])]
        out[least] = tokens[least] <= 2 * left
    return out


def mixture(documents: DataFrame, mix_target: DataFrame, block_tokens: int = 1024, shard_tokens: int = 5_000_000, seed: int = 11, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Which documents to use how often, so that each source of ``mix_target`` gives its share of as many tokens as all documents have, and a report.

    The uses: doc_id, source, tokens, uses (1 or more; a document not used has no row). The report, a row per source of
    mix_target: records, tokens, target_share, quota_tokens, used_tokens, share (of the mixture), share_of_all (of all tokens), records_used, most_uses, mean_uses (tokens used per token there is).

    All tokens are cut into blocks of ``block_tokens``, which Sainte-Laguë apportionment gives to the sources. A source's blocks are apportioned in the same way to its shards, which documents fall into by a
    seeded hash of their id, by the shards' tokens. Within a shard all documents are used as often as the quota holds the whole shard; for the rest, in
    seeded order, blocks of documents are chosen, and single ones for what they leave, until it is met to within half a document. No document is used more than max_repeats times; a source with too little to meet its quota falls short,
    and no other is given its part, which the report shows.

    Only counts are shuffled: texts are read once to count tokens. A shard has about ``shard_tokens`` tokens, whatever the size of its source. Sources are spelled evenly (lower case, ``_``); documents of other sources or none count among all tokens but aren't used. Null or empty
    texts have no tokens; with them a document is used as often as its shard is whole. Without documents the report has zeros; max_repeats null or under 1 means never.
    """
    counts = written(token_counts(documents, tokenizer), "tokens")
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    targets = mix_target.where(F.col("source").isNotNull()).groupBy(clean_source("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sources = targets.orderBy("source").collect()  # the sources of a mixture are written by hand
    blocks = sainte_lague([r.target_share or 0.0 for r in sources], round(total / block_tokens * min(1.0, sum(r.target_share or 0.0 for r in sources))))
    plan = {r.source: (int(b) * block_tokens, max(0, r.max_repeats or 0)) for r, b in zip(sources, blocks, strict=True)}
    spark = documents.sparkSession
    shards = max(1, -(-total // shard_tokens))
    named = counts.where(F.col("source").isin(list(plan))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)).cast("int"))
    sizes = named.groupBy("source", "shard").agg(F.sum("tokens").alias("there"))

    def quotas(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        quota, repeats = plan[key[0]]
        pdf = pdf.sort_values("shard")
        there = pdf["there"].to_numpy()
        want = np.minimum(sainte_lague(there, min(quota, int(there.sum()) * repeats) // block_tokens) * block_tokens, there * repeats)
        if int(there.sum()) * repeats <= quota:
            want = there * repeats
        full = np.minimum(np.where(there > 0, want // np.maximum(there, 1), 0), repeats)
        return pdf.assign(full=full, rest=want - full * there, repeats=repeats)

    given = sizes.groupBy("source").applyInPandas(quotas, "source string, shard int, there bigint, full bigint, rest bigint, repeats bigint")
    # a row per shard and source: the shards of any corpus are its tokens / shard_tokens
    placed = lookup_join(named, given.select("source", "shard", "full", "rest", "repeats"), ["source", "shard"], F.col("doc_id"), "inner")
    placed = placed.withColumn("order", F.xxhash64(F.lit(seed + 1), "doc_id"))
    whole = placed.where((F.col("tokens") == 0) | (F.col("full") >= F.col("repeats"))).select("doc_id", "source", "tokens", F.col("full").alias("uses"))
    ordered = placed.where((F.col("tokens") > 0) & (F.col("full") < F.col("repeats"))).repartition("source", "shard").sortWithinPartitions("source", "shard", "order", "doc_id")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, []

        def done():
            rows = pa.Table.from_batches(pieces).combine_chunks()
            tokens, full = rows.column("tokens").to_numpy(), rows.column("full").to_numpy()
            uses = full + chosen(tokens, int(rows.column("rest")[0].as_py()), block_tokens)
            table = rows.select(["doc_id", "source", "tokens"]).append_column("uses", pa.array(uses, pa.int64()))
            return table.filter(pa.array(uses > 0)).combine_chunks().to_batches()

        for key, piece in runs(batches, 2):
            if pieces and key != now:
                yield from done()
                pieces = []
            now = key
            pieces.append(piece)
        if pieces:
            yield from done()

    columns = ordered.select("source", "shard", "doc_id", "tokens", "full", "rest")
    uses = columns.mapInArrow(choose, "doc_id bigint, source string, tokens bigint, uses bigint").unionByName(whole.where(F.col("uses") > 0))
    uses = written(uses, "uses")

    wanted = spark.createDataFrame([(r.source, r.target_share, plan[r.source][0], plan[r.source][1]) for r in sources], "source string, target_share double, quota_tokens bigint, max_repeats int")
    there = counts.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("tokens"))
    used = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("records_used"), F.max("uses").alias("most_uses"))
    report = wanted.join(F.broadcast(there.where(F.col("source").isin(list(plan)))), "source", "left").join(F.broadcast(used), "source", "left").na.fill(0)
    mixed = F.sum("used_tokens").over(Window.partitionBy())  # over the sources of mix_target only
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    report = report.select(
        "source", "records", "tokens", "target_share", "max_repeats", "quota_tokens", "used_tokens",
        share(F.col("used_tokens"), mixed).alias("share"), (F.col("used_tokens") / F.lit(max(1, total))).alias("share_of_all"), "records_used", "most_uses", share(F.col("used_tokens"), F.col("tokens")).alias("mean_uses"),
    )
    return uses, report
