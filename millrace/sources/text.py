"""Text files as keyed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tokens import lines


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of text files: file, line. Split at line feeds, before which one carriage return goes too (that of an unfinished last line as well); empty lines are left out, an unfinished last one is kept. Files are split among tasks."""
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.regexp_replace("value", "\r$", "")
    return raw.select(F.input_file_name().alias("file"), line.alias("line")).where(F.col("line") != "")


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """The lines of texts in a column: key, pos (from 1, empty lines counted), line. Empty lines are left out."""
    return df.select(F.col(key).alias("key"), F.posexplode(lines(F.col(text))).alias("pos", "line")).where(F.col("line") != "").select("key", (F.col("pos") + 1).alias("pos"), "line")
