"""Listing input files, cutting them into ranges, and reading such ranges in tasks."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGES = "path string, offset bigint, length bigint"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Works in the driver and in tasks; a path without a scheme is one that all machines share."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def list_files(spark: SparkSession, path: str, most_per_folder: int | None = None) -> DataFrame:
    """Files below ``path``: path, folder, length. With ``most_per_folder`` only the first so many of each folder, in the order of their names. Empty files aren't listed. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length")
    if most_per_folder is None:
        return files
    rank = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    return files.withColumn("__nr", rank).where(F.col("__nr") <= most_per_folder).drop("__nr")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row: path, content. For files of up to 2 GB that make sense only whole; others are read by ranges."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def whole_ranges(files: DataFrame, record: int | None = None, split: int = 128 << 20) -> DataFrame:
    """Ranges that cover the files: path, offset, length. Files of records of ``record`` bytes are cut into about ``split`` bytes at record borders (a file that isn't a whole number
    of them is an error); others, whose records are found only from the start, stay whole. Empty files give none."""
    if record is None:
        return files.where(F.col("length") > 0).select("path", F.lit(0).cast("bigint").alias("offset"), "length")
    step = max(1, split // record) * record
    checked = F.when(F.col("length") % record == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("not a whole number of records: "), F.col("path"))))
    rows = files.select("path", checked.alias("all")).where(F.col("all") > 0)
    cut = rows.select("path", "all", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("all") - 1, F.lit(step).cast("bigint"))).alias("offset"))
    return cut.select("path", "offset", F.least(F.lit(step).cast("bigint"), F.col("all") - F.col("offset")).alias("length"))


def sample_ranges(files: DataFrame, rate: float, points: int = 1, record: int = 0) -> DataFrame:
    """Ranges to sample the files by: path, offset, length. Of each of ``points`` equal stretches of a file the beginning, ``rate`` of all bytes in total; with ``record`` both are whole records.
    More than one point needs to know the records; rates above 1 are an error."""
    if rate > 1 or (points > 1 and not record):
        raise ValueError("a rate of at most 1, and the records' size for more than one point")
    whole = lambda c: c - c % record if record else c
    stretch, take = whole(F.floor(F.col("length") / points)), whole(F.floor(F.col("length") * F.lit(rate) / points))
    rows = files.select("path", stretch.alias("stretch"), take.alias("take"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    return rows.select("path", (F.col("i") * F.col("stretch")).cast("bigint").alias("offset"), F.col("take").cast("bigint").alias("length")).where(F.col("length") > 0)


def spread(ranges: DataFrame) -> DataFrame:
    """The ranges over as many tasks as there are, up to ten thousand; they are counted first. A number given by hand isn't coalesced, small as the rows are."""
    return ranges.repartition(max(1, min(10_000, ranges.count())))
