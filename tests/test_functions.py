"""Functions over words, bytes and units, and the queries' conditions."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import byteorder, hashing, tokens, units
from millrace.operators import stats, text


def _one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


EGG = "Well, there's egg and bacon; egg sausage and bacon; egg and spam"


def test_words_and_separators(spark):
    assert _one(spark, EGG, tokens.words)[:4] == ["Well", "there's", "egg", "and"]
    assert _one(spark, r"a\nb c\d-e", tokens.words) == ["a", "nb", r"c\d-e"]
    assert _one(spark, "", tokens.words) == [] and _one(spark, None, tokens.words) is None


def test_combined_counts_are_those_of_words(spark):
    df = spark.createDataFrame([(EGG,)] * 3, "x string").repartition(3)
    got = {r.word: r.cnt for r in text.word_count(df, "x").collect()}
    assert got == {"Well": 3, "there's": 3, "egg": 9, "and": 9, "bacon": 6, "sausage": 3, "spam": 3}
    zeros = {r.word: r.cnt for r in text.with_zero_words(text.word_count(df, "x")).collect()}
    assert zeros["and"] == 9 and zeros["The"] == 0 and len(zeros) == len(set(tokens.STOP_WORDS) | set(got))


def test_ngrams_as_they_stand(spark):
    pangram = "the quick brown fox jumps over the lazy dog"
    w = pangram.split()
    assert _one(spark, pangram, lambda c: tokens.word_ngrams(c, 3)) == [" ".join(w[i : i + 3]) for i in range(7)]
    assert _one(spark, "a, b (c).", lambda c: tokens.word_ngrams(c, 2)) == ["a, b", "b (c"]
    assert _one(spark, "a, b c.", lambda c: tokens.word_ngrams(c, 2)) == ["a, b", "b c."]
    assert _one(spark, "a b", lambda c: tokens.word_ngrams(c, 1)) == ["a", "b"]
    assert _one(spark, "a b", lambda c: tokens.word_ngrams(c, 3)) == [] and _one(spark, "", lambda c: tokens.word_ngrams(c, 1)) == []


def test_pieces_of_bytes(spark):
    assert _one(spark, "abcdefghij", lambda c: tokens.fixed_words(c, 4)) == ["abcd", "efgh", "ij"]
    assert _one(spark, "", lambda c: tokens.fixed_words(c, 4)) == [] and _one(spark, "x" * 50_000, lambda c: F.size(tokens.fixed_words(c, 1))) == 50_000
    assert _one(spark, "", tokens.first_byte) is None and _one(spark, "é", tokens.first_byte) == 195


# Published hashes of these keys by the algorithm (first 64 bits).
HASHES = {b"": 0, b"hello": 0xCBD8A7B341BD9B02, b"The quick brown fox jumps over the lazy dog": 0xE34BBC7BBC071B6C}


def test_murmur3(spark):
    assert hashing.murmur3_64(list(HASHES)).tolist() == list(HASHES.values())
    df = spark.createDataFrame([(bytearray(k),) for k in HASHES] + [(None,)], "x binary")
    signed = [h - (1 << 64) if h >> 63 else h for h in HASHES.values()]
    assert [r.h for r in df.select(hashing.murmur3(F.col("x")).alias("h")).collect()] == [*signed, None]
    assert [r.h and bytes(r.h) for r in df.select(hashing.hashed_key(F.col("x")).alias("h")).collect()] == [h.to_bytes(8, "little") for h in HASHES.values()] + [None]


def test_numbers_as_bytes(spark):
    big = [b"\xff" * 8, b"\x00\x00\x00\x02", b"\x00" * 7 + b"\x05", None]
    df = spark.createDataFrame([(None if b is None else bytearray(b),) for b in big], "x binary")
    assert [None if r.n is None else int(r.n) for r in df.select(byteorder.from_big_endian(F.col("x")).alias("n")).collect()] == [(1 << 64) - 1, 2, 5, None]
    assert int(df.agg(byteorder.wrapping_sum(byteorder.from_big_endian(F.col("x"))).alias("s")).first().s) == 6
    assert bytes(_one(spark, bytearray(b"\x01\x02\x03"), byteorder.reverse_bytes, "binary")) == b"\x03\x02\x01" and bytes(_one(spark, bytearray(b""), byteorder.reverse_bytes, "binary")) == b""
    assert bytes(_one(spark, 300, lambda c: byteorder.to_big_endian(c, 4), "bigint")) == b"\x00\x00\x01\x2c" and bytes(_one(spark, -1, byteorder.to_big_endian, "bigint")) == b"\xff" * 8
    with pytest.raises(Exception, match="as many bytes"):
        _one(spark, bytearray(b"abc"), byteorder.from_big_endian, "binary")


def test_units():
    assert units.convert(100, "MBps", "Gbps") == pytest.approx(0.8) and units.convert(100, "MBps", "MiBps") == pytest.approx(95.367431640625)
    assert units.convert(2, "min", "us") == pytest.approx(120_000_000) and units.convert(1, "R", "B") == 100
    assert units.parse("10 MBps") == (10.0, "MBps") and units.parse("ten MB") is None
    assert units.parse_and_convert("1.5GB", "MB") == pytest.approx(1500) and units.parse_and_convert("x", "MB") is None
    with pytest.raises(ValueError):
        units.factor("s", "MB")


LINES = '[{"type": "DATM", "fields": [{"name": "phase", "type": "str"}, {"name": "n", "type": "uint"}]}, {"type": "COLL", "fields": [{"name": "stage", "type": "str"}, {"name": "n", "type": "int"}, {"name": "v", "type": "str"}]}]'


def test_kinds_of_lines(spark, tmp_path):
    kinds = stats.LineType.load(LINES)
    assert stats.StatQuery({"phase": None}).line_type(kinds).name == "DATM" and stats.StatQuery({"stage": "x", "n": 3}).line_type(kinds).name == "COLL"
    for bad in ({"n": 1}, {}):
        with pytest.raises(ValueError):
            stats.StatQuery(bad).line_type(kinds)
    assert stats.StatQuery({"stage": ["a", "b.*"], "n": 3}).pattern(kinds[1]) == "COLL\t(?:a|b.*)\t3\t[^\t]*"
    (tmp_path / "log").write_text("DATM\tone\t5\nCOLL\tsorter\t7\tx\nCOLL\tsorter\tseven\tx\nDATM\tshort\nOTHER\ta\t1\n")
    read = stats.read_log(spark, str(tmp_path / "log"), kinds)
    assert [tuple(r) for r in read["DATM"].collect()] == [("one", 5)] and [tuple(r) for r in read["COLL"].collect()] == [("sorter", 7, "x"), ("sorter", None, "x")]


def test_plot_specs_and_conditions(spark):
    query = stats.plot_query("host1.*.sort*.3.bytes_in")
    assert query.where == {"hostname": "host1", "phase_name": None, "stage_name": "sort.*?", "worker_id": 3, "stat_name": "bytes_in"}
    assert list(stats.plot_query("*.one.logger.x").where) == ["hostname", "phase_name", "logger", "stat_name"]
    with pytest.raises(ValueError):
        stats.plot_query("a.b.c")
    rows = spark.createDataFrame([("host1", "p", "sorter", 3, "bytes_in"), ("host1", "p", "resorter", 3, "bytes_in"), ("host1", "p", "sorter", 4, "bytes_in"), ("host11", None, "sorter", 3, "bytes_in")], "hostname string, phase_name string, stage_name string, worker_id int, stat_name string")
    assert stats.stat_filter(rows, query).count() == 1


def test_pull_workers_and_derived_rates(spark):
    row = dict(bytes_in=1000, bytes_out=500, runtime=100, idle=20, teardown=0, memory_wait=5, enqueue_block=5, saturation=10, workers=2, nodes=1)
    df = spark.createDataFrame([row])
    push, pull = (stats.derived_rates(df, p).first() for p in (False, True))
    assert (push.processing, push.useful, push.observed_rate, push.io_multiplier) == (120, 90, 10, 0.5) and push.ideal_rate == pytest.approx(10 / 0.75)
    assert pull.processing == 90 and push.observed_rate_per_worker == 5
    idle = stats.derived_rates(spark.createDataFrame([{k: 0 for k in row}])).first()
    assert idle.io_multiplier is None and idle.ideal_rate == 0 and idle.share_waiting == 0
