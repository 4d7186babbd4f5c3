"""Parsing URLs and names of partition files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([^:/]+)://([^:/]*)(?::(\d+))?(/.*)?$"
_PARTITION = r"job_(\d+)/(\d{8,})\.partition(?:\.(large|chunk_(\d+)))?$"


def url_parts(url: Column) -> Column:
    """scheme, host, port (null if none) and path of a URL; nulls if it isn't one."""
    part = lambda i: F.nullif(F.regexp_extract(url, _URL, i), F.lit(""))
    return F.struct(part(1).alias("scheme"), part(2).alias("host"), part(3).cast("int").alias("port"), part(4).alias("path"))


def partition_file(path: Column) -> Column:
    """job, partition, whether it is large, and the chunk of a partition file; nulls if the name is no partition file's."""
    part = lambda i: F.nullif(F.regexp_extract(path, _PARTITION, i), F.lit(""))
    return F.struct(part(1).cast("bigint").alias("job"), part(2).cast("bigint").alias("partition"), (part(3) == "large").alias("large"), part(4).cast("bigint").alias("chunk"))


def partition_name(job: int, partition: int, suffix: str = "") -> str:
    """The name of a partition's file below the output folder."""
    return f"job_{job}/{partition:08d}.partition{suffix}"
