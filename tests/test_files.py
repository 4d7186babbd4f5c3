"""Binary and text files: read in any cut, written by partition, listed and sampled."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.paths import partition_file, partition_name, url_parts
from millrace.sources import files, kv
from millrace.sources.text import read_lines, text_lines

TUPLES = [(b"key", b"value"), (b"", b""), (b"k2", b""), (b"", b"v" * 300), (b"\x00\xff", b"\x01")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=9), st.binary(max_size=20)), max_size=8), st.data())
def test_framed_tuples_whatever_the_cut(tuples, data):
    stream = b"".join(kv.encode(*t) for t in tuples)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(stream)), max_size=6)))
    decoder, got = kv.Decoder(), []
    for a, b in zip([0, *cuts], [*cuts, len(stream)], strict=True):
        got += decoder.feed(stream[a:b])
    decoder.close()
    assert got == tuples


@pytest.mark.parametrize("cut", [5, 8, 13, 16, 17])
def test_unfinished_tuples_are_an_error(cut):
    decoder = kv.Decoder()
    list(decoder.feed(kv.encode(b"12345", b"abcde")[:cut]))
    with pytest.raises(ValueError):
        decoder.close()


def test_fixed_tuples_across_pieces():
    data = bytes(range(60))
    decoder, got = kv.Decoder((2, 4)), []
    for a, b in ((0, 1), (1, 6), (6, 20), (20, 60)):
        if batch := decoder.batch(data[a:b]):
            got += list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    decoder.close()
    assert got == [(data[i : i + 2], data[i + 2 : i + 6]) for i in range(0, 60, 6)] == list(kv.Decoder((2, 4)).feed(data))


def _pairs(df):
    return sorted((bytes(r.key), bytes(r.value)) for r in df.collect())


def test_written_files_are_read_again(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in TUPLES] + [(None, None)], "key binary, value binary").repartition(3)
    kv.write_kv(rows, str(tmp_path / "framed"))
    assert _pairs(kv.read_framed(spark, str(tmp_path / "framed"))) == sorted([*TUPLES, (b"", b"")])
    with pytest.raises(ValueError):
        kv.write_kv(rows, str(tmp_path / "framed"))
    fixed = [(bytes([i] * 3), bytes([i, 255 - i])) for i in range(200)]
    kv.write_kv(spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in fixed], "key binary, value binary").repartition(2), f"file://{tmp_path}/fixed", headers=False)
    assert _pairs(kv.read_fixed(spark, f"file://{tmp_path}/fixed", 3, 2, split=64)) == sorted(fixed)
    monkeypatch.setattr(kv, "PIECE", 7)
    assert _pairs(kv.read_framed(spark, f"file://{tmp_path}/framed")) == sorted([*TUPLES, (b"", b"")])
    assert _pairs(kv.read_fixed(spark, str(tmp_path / "fixed"), 3, 2)) == sorted(fixed)
    with pytest.raises(Exception, match="whole number"):
        kv.read_fixed(spark, str(tmp_path / "fixed"), 3, 3).count()


def test_a_file_per_partition(spark, tmp_path):
    rows = spark.range(0, 100).selectExpr("cast(id % 7 as int) as p", "cast(cast(99 - id as string) as binary) as key", "cast('v' as binary) as value").unionByName(spark.sql("select cast(null as int) p, cast('x' as binary) key, cast('y' as binary) value"))
    kv.write_partitions(rows, "p", 9, str(tmp_path / "out"), 3, ["key"])
    got = files.list_files(spark, str(tmp_path / "out")).select(partition_file(F.col("path")).alias("f"), "length").collect()
    assert sorted((r.f.job, r.f.partition) for r in got) == [(3, i) for i in range(7)]
    for i in range(7):
        keys = [k for k, _ in kv.Decoder().feed((tmp_path / "out" / partition_name(3, i)).read_bytes())]
        assert keys == sorted(str(99 - x).encode() for x in range(100) if x % 7 == i)


def test_listing_with_a_cap(spark, tmp_path):
    for folder, n in (("a", 3), ("b", 1), ("c/d", 4)):
        os.makedirs(tmp_path / folder)
        for i in range(n):
            (tmp_path / folder / f"f{i}").write_bytes(b"x" * (10 + i))
        (tmp_path / folder / "empty").write_bytes(b"")  # holds nothing and isn't listed
    assert files.list_files(spark, str(tmp_path)).count() == 8
    got = files.list_files(spark, str(tmp_path), 2).collect()
    assert sorted((os.path.basename(r.folder), os.path.basename(r.path), r.length) for r in got) == [("a", "f0", 10), ("a", "f1", 11), ("b", "f0", 10), ("d", "f0", 10), ("d", "f1", 11)]


def test_ranges_for_samples_and_for_all(spark):
    table = spark.createDataFrame([("A", 1000), ("B", 3000), ("C", 0), ("D", 90)], "path string, length bigint")
    rows = {tuple(r) for r in files.sample_ranges(table, 0.1, 2, 100).collect()}
    assert rows == {("B", 0, 100), ("B", 1500, 100)}  # of the others less than a record
    assert {tuple(r) for r in files.sample_ranges(table, 0.5).collect()} == {("A", 0, 500), ("B", 0, 1500), ("D", 0, 45)}
    for bad in ((1.5, 1, 0), (0.1, 2, 0)):
        with pytest.raises(ValueError):
            files.sample_ranges(table, *bad)
    assert {tuple(r) for r in files.whole_ranges(table).collect()} == {("A", 0, 1000), ("B", 0, 3000), ("D", 0, 90)}
    cut = files.whole_ranges(table, 10, 1024).collect()
    assert {tuple(r) for r in cut if r.path == "B"} == {("B", 0, 1020), ("B", 1020, 1020), ("B", 2040, 960)}


def test_lines_of_files_and_of_columns(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"one\r\ntwo\n\n\r\nthree\rfour\nlast\r")
    got = read_lines(spark, str(tmp_path / "x.txt")).collect()
    # one carriage return at a line's end goes, also that of an unfinished last line
    assert [r.line for r in got][:3] == ["one", "two", "three\rfour"] and len(got) == 4
    rows = text_lines(spark.createDataFrame([(1, "a\n\nb\r\nc"), (2, ""), (3, None)], "k int, t string"), "k", "t")
    assert [tuple(r) for r in rows.orderBy("key", "pos").collect()] == [(1, 1, "a"), (1, 3, "b"), (1, 4, "c")]


def test_names_and_urls(spark):
    urls = spark.createDataFrame([("local://host:80/a/b",), ("hdfs://n/x",), ("nothing",), (None,)], "u string").select(url_parts(F.col("u")).alias("p")).collect()
    assert [tuple(r.p) for r in urls] == [("local", "host", 80, "/a/b"), ("hdfs", "n", None, "/x"), (None,) * 4, (None,) * 4]
    names = ["/o/job_4/00000012.partition", "/o/job_4/00000012.partition.large", "job_1/00000003.partition.chunk_5", "job_1/3.partition"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(partition_file(F.col("n")).alias("p")).collect()
    assert [(r.p.job, r.p.partition, bool(r.p.large), r.p.chunk) for r in got] == [(4, 12, False, None), (4, 12, True, None), (1, 3, False, 5), (None, None, False, None)]
    assert partition_name(4, 12) == "job_4/00000012.partition"


def test_whole_files(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"a\x00b")
    assert [(os.path.basename(r.path), bytes(r.content)) for r in files.read_whole(spark, str(tmp_path)).collect()] == [("x", b"a\x00b")]
