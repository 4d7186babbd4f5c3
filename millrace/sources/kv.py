"""Binary key/value files: header-framed or of fixed lengths, read and written.

A framed tuple is two 32-bit little-endian lengths, then the key's and the value's bytes; without headers the lengths are given.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.paths import partition_name
from millrace.sources.files import file_system, list_files, spread, whole_ranges

KV = "key binary, value binary"
HEADER = struct.Struct("<II")
#: Bytes read at a time.
PIECE = 4 << 20


def tuple_size(key: Column, value: Column, headers: bool = True) -> Column:
    return F.octet_length(key) + F.octet_length(value) + (HEADER.size if headers else 0)


class Decoder:
    """Tuples from pieces of a byte stream, cut anywhere: what is unfinished waits for the next piece."""

    def __init__(self, lengths: tuple[int, int] | None = None):
        self.lengths, self.held = lengths, b""

    def feed(self, piece: bytes) -> Iterator[tuple[bytes, bytes]]:
        data, at = self.held + piece, 0
        head = 0 if self.lengths else HEADER.size
        while at + head <= len(data):
            k, v = self.lengths or HEADER.unpack_from(data, at)
            end = at + head + k + v
            if end > len(data) or end == at:
                break
            yield data[at + head : at + head + k], data[at + head + k : end]
            at = end
        self.held = data[at:]

    def batch(self, piece: bytes) -> pa.RecordBatch | None:
        """The tuples of a piece as rows; those of fixed lengths are cut out all at once."""
        if self.lengths and sum(self.lengths):
            k, v = self.lengths
            data = self.held + piece
            n = len(data) // (k + v)
            self.held = data[n * (k + v) :]
            records = np.frombuffer(data, np.uint8, n * (k + v)).reshape(n, k + v)
            columns = [_binary(records[:, :k]), _binary(records[:, k:])]
        else:
            tuples = list(self.feed(piece))
            n = len(tuples)
            columns = [pa.array([t[i] for t in tuples], pa.binary()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["key", "value"]) if n else None

    def close(self) -> None:
        if self.held:
            raise ValueError(f"{len(self.held)} bytes at the end are no whole tuple")


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of rows of bytes."""
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def encode(key: bytes, value: bytes, headers: bool = True) -> bytes:
    return (HEADER.pack(len(key), len(value)) if headers else b"") + key + value


def read_framed(spark: SparkSession, path: str, most_per_folder: int | None = None) -> DataFrame:
    """Tuples of header-framed files: key, value. Only a scan from a file's start finds its tuples, so a file goes to one task, which streams it in pieces; there should be as many files as tasks."""
    return read_ranges(whole_ranges(list_files(spark, path, most_per_folder)))


def read_fixed(spark: SparkSession, path: str, key_length: int, value_length: int, most_per_folder: int | None = None, split: int = 128 << 20) -> DataFrame:
    """Tuples of files without headers, of fixed lengths; a file is shared by as many tasks as it has ``split`` bytes. A file that isn't a whole number of tuples is an error."""
    return read_ranges(whole_ranges(list_files(spark, path, most_per_folder), key_length + value_length, split), (key_length, value_length))


def read_ranges(ranges: DataFrame, lengths: tuple[int, int] | None = None, whole: bool = True) -> DataFrame:
    """The tuples in ranges of files (path, offset, length): key, value, read in pieces of 4 MB. With ``whole`` off a tuple unfinished at a range's end is left out, as in samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, offset, length in zip(*[c.to_pylist() for c in b.columns], strict=True):
                files, name = file_system(path)
                decoder = Decoder(lengths)
                with files.open_input_file(name) as f:
                    f.seek(offset)
                    left = length
                    while left > 0 and (piece := f.read(min(PIECE, left))):
                        left -= len(piece)
                        if out := decoder.batch(piece):
                            yield out
                if whole:
                    decoder.close()

    return spread(ranges).select("path", "offset", "length").mapInArrow(run, KV)


def write_kv(df: DataFrame, path: str, headers: bool = True) -> list[str]:
    """Writes key and value of each row in the order of its task, a file per task, to a folder that all executors can write to; the files' paths.

    The folder may be on any file system that Arrow knows by its URI. A task writes under a name of its own and renames when done, so a task that runs again leaves one whole file; a folder that
    holds files already is refused. Null keys and values are written empty.
    """
    rows = df.select(F.lit(None).cast("int").alias("partition"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    return _write(rows, path, headers, lambda task, _: f"part-{task:08d}.kv")


def write_partitions(df: DataFrame, partition: str, partitions: int, path: str, job: int, order: list[str] | None = None, headers: bool = True) -> list[str]:
    """Writes each partition's tuples to a file of its own, named by job and partition: the rows are moved to the task of their partition (a whole number from 0, nulls left out) and sorted there
    by ``order``. As ``write_kv`` otherwise; partitions without rows have no file."""
    rows = df.where(F.col(partition).isNotNull()).repartitionById(partitions, partition).sortWithinPartitions(partition, *(order or []))
    rows = rows.select(F.col(partition).cast("int").alias("partition"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    return _write(rows, path, headers, lambda _, number: partition_name(job, number))


def _write(rows: DataFrame, path: str, headers: bool, name_of) -> list[str]:
    files, folder = file_system(path)
    if any(x.is_file for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))):
        raise ValueError(f"{path} holds files already")
    files.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(path)
        task, now, out, done = TaskContext.get().partitionId(), (), None, []

        def close():
            if out is not None:
                out.close()
                files.move(partial, name)
                done.append(name)

        for b in batches:
            numbers = b.column(0).to_pylist()
            keys, values = ([x or b"" for x in b.column(i).to_pylist()] for i in (1, 2))
            edges = [0, *[i for i in range(1, len(numbers)) if numbers[i] != numbers[i - 1]], len(numbers)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if out is None or numbers[i] != now:
                    close()
                    now = numbers[i]
                    name = f"{folder}/{name_of(task, now)}"
                    partial = f"{name}.{uuid.uuid4().hex}"
                    files.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(partial)
                out.write(b"".join(encode(k, v, headers) for k, v in zip(keys[i:j], values[i:j], strict=True)))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    return sorted(r.file for r in rows.mapInArrow(run, "file string").collect())  # a name per file


def consecutive_pairs(df: DataFrame, stream: str, pos: str, fragment: str, tie: list[str] | None = None) -> DataFrame:
    """Each fragment joined with the next one of its stream: stream, pos, key. The last of a stream begins no pair. Fragments at one place are taken by ``tie``, then by themselves."""
    w = Window.partitionBy(stream).orderBy(pos, *(tie or []), fragment)
    rows = df.select(stream, pos, fragment, F.lead(fragment).over(w).alias("__next"))
    return rows.where(F.col("__next").isNotNull()).select(stream, pos, F.concat(F.col(fragment), F.col("__next")).alias("key"))
