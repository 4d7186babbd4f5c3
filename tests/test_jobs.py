"""Jobs, batches, graphs and sessions."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, partitioning, sessions, sorting
from millrace.plans import jobs


def test_unknown_steps_are_refused():
    with pytest.raises(ValueError, match="unknown step"):
        jobs.Job("x", map="no such map")
    with pytest.raises(ValueError, match="is taken"):
        jobs.register(jobs.MAPS, "pass_through")(lambda df: df)


def test_batches_share_scans_and_feed_each_other(spark, tmp_path):
    reads = []

    def read(source):
        reads.append(source)
        return spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, value int") if source == "rows" else spark.read.parquet(source)

    out = str(tmp_path / "sums")
    sums, counts = jobs.Job("rows", out, reduce="sum_values"), jobs.Job("rows", reduce="count_duplicates", params={"count_duplicates.keys": ["key"]})
    done = jobs.run_batches(spark, [[sums, counts], [jobs.merge_job(out, None)]], read)
    assert reads == ["rows", out] and [sorted(tuple(r) for r in d.collect()) for d in done] == [[("a", 3), ("b", 3)], [("a", 2)], [("a", 3), ("b", 3)]]
    assert jobs.run_batches(spark, sums.__class__("rows"), read)[0].count() == 3 and done[2].rdd.getNumPartitions() == 1


def test_parts_of_a_sorted_job_are_ordered(spark):
    rows = spark.range(0, 2000).selectExpr("lpad(cast(pmod(xxhash64(id), 100000) as string), 6, '0') as key", "10 as bytes")
    for kind in ("boundaries", "hashed_boundaries"):
        job = jobs.Job("rows", partition=kind, params={f"{kind}.key": "key", f"{kind}.weight": "bytes", f"{kind}.partitions": 5})
        got = jobs.run_batches(spark, job, lambda _: rows)[0].withColumn("task", F.spark_partition_id()).collect()
        assert all(r.task == r.partition for r in got) and {r.partition for r in got} == set(range(5))
        if kind == "boundaries":
            assert [r.key for r in got] == sorted(r.key for r in got)
    uniform = jobs.fast_sort_job("rows", None, "key", 4)
    assert jobs.run_batches(spark, uniform, lambda _: rows)[0].where("partition is null").count() == 0


def test_ranks_keep_their_mass(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 1), (4, 5), (6, 1)], "src bigint, dst bigint")
    vertices = spark.createDataFrame([(i, 1 / 6) for i in range(1, 7)], "id bigint, rank double")
    want = {i: 1 / 6 for i in range(1, 7)}
    out = {}
    for s, d in [(1, 2), (1, 2), (1, 3), (2, 1), (4, 5), (6, 1)]:
        out.setdefault(s, []).append(d)
    for _ in range(3):
        new = dict.fromkeys(want, 0.0)
        for v, r in want.items():
            for d in out.get(v, [v]):
                new[d] += r / len(out.get(v, [v]))
        want = new
    for block in (1_000_000, 2):  # the edges of vertex 1 in one block, and in two
        got = {r.id: r for r in graph.page_rank(edges, vertices, 3, 2, block).collect()}
        assert {i: pytest.approx(r.rank) for i, r in got.items()} == want and sum(r.rank for r in got.values()) == pytest.approx(1)
        assert {i: r.degree for i, r in got.items()} == {i: len(out.get(i, [])) for i in want}
    start = graph.page_rank(edges, vertices.where("id < 3"), 0).collect()
    assert {r.id: r.rank for r in start if r.id > 2} == {3: 0, 4: 0, 5: 0, 6: 0}


def test_long_lists_come_in_blocks(spark):
    edges = spark.range(0, 1000).selectExpr("if(id < 900, 'hot', cast(id as string)) as page", "cast(id % 10 as string) as target")
    rows = graph.adjacency(edges, "page", "target", 100).collect()
    hot = [r for r in rows if r.id == "hot"]
    assert len(hot) == 9 and max(len(r.nbrs) for r in hot) < 200 and sum(len(r.nbrs) for r in rows) == 1000
    assert {r.block for r in rows if r.id != "hot"} == {0} and all(r.rank == 1 for r in rows)


def test_random_graphs_dont_depend_on_tasks(spark):
    one, many = ({r.id: r.nbrs for r in graph.random_graph(spark, 300, 0.02, 9, tasks=t).collect()} for t in (1, 5))
    assert one == many and max(map(len, one.values())) <= 9
    full = graph.random_graph(spark, 50, 1.0, 7).collect()
    assert {len(r.nbrs) for r in full} == {7} and graph.random_graph(spark, 5, 0.0, 3).selectExpr("max(size(nbrs)) m").first().m == 0
    assert sum(graph.power_law_degrees(1000, 2, 40).values()) == 1000


def test_adjacency_lines(spark):
    lines = spark.createDataFrame([("3 2 7 9",), ("5 0",)], "l string")
    assert [(r.id, r.nbrs) for r in graph.parse_adjacency(lines, "l", 1).collect()] == [(3, [7]), (5, [])]
    with pytest.raises(Exception, match="wrong count"):
        graph.parse_adjacency(spark.createDataFrame([("3 2 7",)], "l string"), "l", 5).collect()


def test_sessions_are_anchored(spark):
    clicks = [(1, t, f"u{t}") for t in (0, 4, 9, 10, 11, 25, 30)] + [(2, 5, "x"), (None, 1, "n"), (3, None, "n")]
    rows = spark.createDataFrame(clicks, "who int, s int, url string").selectExpr("who", "timestamp_micros(s) as ts", "url")
    got = sorted(tuple(r) for r in sessions.click_sessions(rows, "who", "ts", "url", 10).collect())
    assert got == [(1, 0, "u0", 10, "u10"), (1, 11, "u11", 25, "u25")]
    opened = sessions.click_sessions(rows, "who", "ts", "url", 10, emit_open=True)
    assert sorted(tuple(r) for r in opened.collect())[2:] == [(1, 30, "u30", 30, "u30"), (2, 5, "x", 5, "x")]


def test_reservoirs(spark):
    rows = spark.range(0, 5000).selectExpr("lpad(cast(id as string), 10, '0') as key", "repeat('v', 300) as value", "id")
    sample = partitioning.byte_reservoir(rows, "key", "value", ["id"], 52_000).collect()
    assert len(sample) == 1000 and {r.value for r in sample} == {318}
    hashed = partitioning.byte_reservoir(rows, "key", "value", ["id"], 48_000, hashed=True).collect()
    assert len(hashed) == 1000 and {len(r.key) for r in hashed} == {8} and {r.value for r in hashed} == {318}
    small = partitioning.byte_reservoir(rows.limit(3), "key", "value", ["id"], 1 << 20)
    assert small.count() == 3


def test_orders_of_tasks(spark):
    rows = spark.range(0, 3000).selectExpr("id", "pmod(xxhash64(id), 40) as key", "pmod(xxhash64(id, 1), 1000) as second").repartition(5)
    got = sorting.secondary_sort(rows, "key", "second").withColumn("task", F.spark_partition_id()).collect()
    assert len({(r.key, r.task) for r in got}) == 40 and [(r.task, r.key, r.second) for r in got] == sorted((r.task, r.key, r.second) for r in got)
    whole = jobs.run_batches(spark, jobs.Job("rows", params={"identity.order": ["second", "id"]}), lambda _: rows)[0].collect()
    assert [(r.second, r.id) for r in whole] == sorted((r.second, r.id) for r in whole)
    nodes = spark.range(0, 8).select(partitioning.node_of(F.col("id"), 3).alias("n")).collect()
    assert [r.n for r in nodes] == [0, 0, 0, 1, 1, 1, 2, 2]


def test_neighbours_are_cut_before_they_are_listed(spark):
    edges = spark.range(0, 500).selectExpr("id % 2 as id", "500 - id as target")
    got = {r.id: r.nbrs for r in jobs.REDUCES["neighbours"](edges, most=3).collect()}
    assert got == {0: [2, 4, 6], 1: [1, 3, 5]}


def test_sessions_over_batches_are_those_of_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    clicks = [(rng.randint(0, 6) if rng.random() < 0.6 else 99, rng.randint(0, 5000), f"u{i}") for i in range(4000)]
    want = []
    for who in {c[0] for c in clicks}:
        start = None
        for _, t, url in sorted(c for c in clicks if c[0] == who):
            if start is None:
                start = t, url
            elif t - start[0] >= 37:
                want.append((who, *start, t, url))
                start = None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame(clicks, "who int, s int, url string").selectExpr("who", "timestamp_micros(s) as ts", "url")
        assert sorted(tuple(r) for r in sessions.click_sessions(rows, "who", "ts", "url", 37).collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
