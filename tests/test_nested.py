"""Shredding and assembling nested records."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import nested, snapshots
from millrace.operators.nested import Field, _place, _Shredder, leaves

FIELDS = (Field("name"), Field("groups", True, (Field("title"), Field("items", True, (Field("kind"), Field("tags", True))))))


def test_levels_of_a_known_record():
    s = _Shredder(FIELDS)
    s.add({"name": "n", "groups": [{"title": "a", "items": [{"kind": "k", "tags": ["x", None, "y"]}, None]}, {"title": None, "items": []}, None]})
    s.add({})
    r, d, v = s.columns["groups.items.tags"]
    assert v == ["x", None, "y", None, None, None, None]
    assert r == [0, 3, 3, 2, 1, 1, 0]
    assert d == [9, 8, 9, 5, 4, 2, 0]


items = st.none() | st.fixed_dictionaries({}, optional={"kind": st.none() | st.text(max_size=2), "tags": st.none() | st.lists(st.none() | st.text(max_size=2), max_size=3)})
groups = st.none() | st.fixed_dictionaries({}, optional={"title": st.none() | st.text(max_size=2), "items": st.none() | st.lists(items, max_size=3)})
records = st.lists(st.fixed_dictionaries({}, optional={"name": st.none() | st.text(max_size=2), "groups": st.none() | st.lists(groups, max_size=3)}), max_size=4)


@settings(max_examples=200, deadline=None)
@given(records)
def test_places_from_levels_are_those_of_the_records(rs):
    columns = {leaf.path: ([], [], []) for leaf in leaves(FIELDS)}
    for rec in rs:
        s = _Shredder(FIELDS)
        s.add(rec)
        for p, parts in s.columns.items():
            for into, part in zip(columns[p], parts, strict=True):
                into.extend(part)
    r, d, v = (np.array(x, dtype=object) for x in columns["groups.items.tags"])
    r, d = r.astype(int), d.astype(int)
    got = [(int(n), int(a), int(b), int(c), t) for n, a, b, c, t in zip(np.cumsum(r == 0) - 1, _place(r, 1), _place(r, 2), _place(r, 3), v, strict=True) if t is not None] if len(r) else []
    want = []
    for n, rec in enumerate(rs):
        for a, g in enumerate(rec.get("groups") or []):
            for b, i in enumerate((g or {}).get("items") or []):
                want += [(n, a, b, c, t) for c, t in enumerate((i or {}).get("tags") or []) if t is not None]
    assert got == want


def _found(spark, payloads):
    rows = [(i, "h", None, p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "snapshot_id bigint, hostname string, captured_at timestamp_ntz, payload string")
    shredded = snapshots.shred_snapshots(df).cache()
    return {tuple(r) for r in snapshots.child_table(shredded).select("snapshot_id", "phase_name", "stage_name", "tracker_pos", "child_kind", "child_pos", "child_value").collect()}


def test_every_layout(spark):
    tracker = {"type": "tracker", "prev_trackers": "2", "worker_queue_sizes": [1, None, 3], "next_stages": "b"}
    members = [{"type": "worker", "pending": [{"disk": 0}]}, tracker]
    one = {("prev_trackers", 0, "2"), ("worker_queue_sizes", 0, "1"), ("worker_queue_sizes", 2, "3"), ("next_stages", 0, "b")}
    phased = {"meta": {"warnings": []}, "phases": [{"phase_name": "p", "stages": {"a": members}}]}
    payloads = [{"a": members}, {"x": {"stages": {"a": members, "e": []}}}, {"stages": [{"name": "a", "members": members}]}, phased, {"phases": [{"phase_name": "p", "stages": [{"name": "a", "members": members}]}]}]
    texts = [json.dumps(p) for p in payloads] + [json.dumps(json.dumps(phased))]
    want = {(i, "p" if i >= 3 else "", "a", 1, *x) for i in range(6) for x in one}
    assert _found(spark, texts) == want


def test_unreadable_and_empty(spark):
    t = '{"type":"tracker","prev_trackers":null,"worker_queue_sizes":[],"next_stages":["",null]}'
    bad = [None, "", "null", "[1]", "3", '{"a":[' + t, '"{\\"a\\": ["', '{"a":[' + t + "]}", '{"a":[{"type":"tracker","next_stages":["x"]}]} trailing', '{"a":[{"type":"tracker","prev_trackers":NaN}]}', "[" * 100_000]
    assert _found(spark, bad) == set()


def test_tables_keep_parents_and_resent_once(spark):
    p = json.dumps({"stages": {"a": [{"type": "pool"}, {"type": "tracker", "spawned": True}], "b": []}})
    df = spark.createDataFrame([(1, "h", None, p)] * 3 + [(2, None, None, None)], "snapshot_id bigint, hostname string, captured_at timestamp_ntz, payload string").selectExpr("*", "1 as id", "2 as value")
    shredded = snapshots.shred_snapshots(df)
    assert sorted(map(tuple, snapshots.stage_table(shredded).collect())) == [(1, 0, "", 0, "a"), (1, 0, "", 1, "b")]
    assert [tuple(r)[:9] for r in snapshots.tracker_table(shredded).collect()] == [(1, 0, "", 0, "a", 1, "true", None, None)]
    assert sorted(tuple(r) for r in snapshots.snapshot_table(df).select("snapshot_id", "readable").collect()) == [(1, True), (2, False)]


def test_empty_table_and_wrong_path(spark):
    df = spark.createDataFrame([], "snapshot_id bigint, hostname string, captured_at timestamp_ntz, payload string")
    shredded = snapshots.shred_snapshots(df)
    assert snapshots.child_table(shredded).count() == 0
    with pytest.raises(ValueError):
        nested.assemble(shredded, snapshots.FIELDS, "phases.phase_name")
