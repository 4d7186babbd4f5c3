"""Counting and extracting from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import tokens


def word_count(df: DataFrame, text: str) -> DataFrame:
    """How often each word comes: word, cnt. Counted within each task first."""
    return df.select(F.explode(tokens.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def with_zero_words(counts: DataFrame, words: tuple[str, ...] = tokens.STOP_WORDS) -> DataFrame:
    """The counts, in which each of ``words`` has a row, of 0 if it doesn't come."""
    zeros = counts.sparkSession.createDataFrame([(w, 0) for w in words], "word string, cnt bigint")
    return counts.unionByName(zeros).groupBy("word").agg(F.sum("cnt").alias("cnt"))


def ngram_count(df: DataFrame, text: str, n: int) -> DataFrame:
    """How often each run of ``n`` words comes, as it stands in the text: ngram, cnt."""
    return df.select(F.explode(tokens.word_ngrams(F.col(text), n)).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("cnt"))


def inverted_index(df: DataFrame, doc: str, text: str, size: int) -> DataFrame:
    """How often each word of ``size`` bytes comes in each document: word, doc, cnt. A row per posting, so a word that all
    documents hold never has to be in memory whole."""
    return df.select(F.explode(tokens.fixed_words(F.col(text), size)).alias("word"), F.col(doc).alias("doc")).groupBy("word", "doc").agg(F.count(F.lit(1)).alias("cnt"))


def postings(index: DataFrame, block: int = 100_000) -> DataFrame:
    """The postings of each word as an ordered list, in blocks by document so that a list stays bounded: word, block, postings."""
    by = index.withColumn("block", F.floor(F.col("doc") / block))
    return by.groupBy("word", "block").agg(F.array_sort(F.collect_list(F.struct("doc", "cnt"))).alias("postings"))


def page_links(df: DataFrame, line: str, pattern: str = r"<link><target>([^<]*)<") -> DataFrame:
    """The links of page lines (tab separated: id, page, date, xml, text): page, target. A line with fewer than three tabs is an error."""
    parts = F.split(F.col(line), "\t")
    checked = F.when(F.size(parts) >= 4, parts).otherwise(F.raise_error(F.concat(F.lit("page line with too few fields: "), F.left(F.col(line), F.lit(80)))))
    return df.select(checked.alias("p")).select(F.col("p")[1].alias("page"), F.explode(F.regexp_extract_all(F.col("p")[3], F.lit(pattern), F.lit(1))).alias("target"))


def page_texts(df: DataFrame, line: str) -> DataFrame:
    """Of page lines the text behind the fourth tab, further tabs included, where it isn't empty: page, text."""
    fields = r"(?s)^[^\t]*\t([^\t]*)\t[^\t]*\t[^\t]*\t(.+)$"
    part: Column = F.col(line)
    return df.select(F.regexp_extract(part, fields, 1).alias("page"), F.regexp_extract(part, fields, 2).alias("text")).where(F.col("text") != "")


def key_prefix_count(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows per first ``size`` bytes of the key: prefix, cnt."""
    return df.groupBy(F.substring(F.col(key).cast("binary"), 1, size).cast("string").alias("prefix")).agg(F.count(F.lit(1)).alias("cnt"))


def grep_selectivity(df: DataFrame, value: str, selectivity: float) -> DataFrame:
    """Rows whose first value byte is at most ``selectivity`` of 255; empty and null values are left out."""
    return df.where(tokens.first_byte(F.col(value)) <= int(selectivity * 255))


def tuple_length_count(df: DataFrame, key: str, value: str) -> DataFrame:
    """How often each key length (kind 0), value length (1) and tuple length with its header of 8 (2) comes: kind, length, cnt."""
    k, v = F.octet_length(F.col(key)).cast("bigint"), F.octet_length(F.col(value)).cast("bigint")
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), x.alias("length")) for i, x in enumerate((k, v, k + v + 8))])).alias("r"))
    return rows.groupBy("r.kind", "r.length").agg(F.count(F.lit(1)).alias("cnt"))


def multi_regex_grep(df: DataFrame, line: str, patterns: list[str]) -> DataFrame:
    """One row per line and pattern that matches the whole line: pattern_no, and the columns of ``df``. One pass, whatever the number of patterns."""
    hits = F.array_compact(F.array(*[F.when(F.col(line).rlike(f"^(?:{p})$"), F.lit(i)) for i, p in enumerate(patterns)]))
    return df.select("*", F.explode(hits).alias("pattern_no"))
