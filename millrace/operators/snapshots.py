"""Snapshots of the resource monitor as flat tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.nested import Field, assemble, shred

MEMBER_KINDS = ("worker", "pool", "tracker")
CHILDREN = ("prev_trackers", "worker_queue_sizes", "next_stages")
FIELDS = (
    Field("layout"),
    Field("phases", True, (
        Field("phase_name"),
        Field("stages", True, (
            Field("name"),
            Field("members", True, (Field("type"), Field("spawned"), Field("teardown_initiated"), Field("teardown_complete"), Field("completed_prev_trackers"), *[Field(c, True) for c in CHILDREN])),
        )),
    )),
)


def _members(value) -> bool:
    return isinstance(value, list) and any(isinstance(x, dict) and x.get("type") in MEMBER_KINDS for x in value)


def _find(node, phase: str, into: dict[str, list[dict]]) -> None:
    """Gathers the stages below ``node``, whichever way they are laid out, under the phase they stand in."""
    if isinstance(node, list):
        for x in node:
            _find(x, phase, into)
    elif isinstance(node, dict):
        if isinstance(node.get("phase_name"), str):
            phase = node["phase_name"]
        if isinstance(node.get("members"), list) and "name" in node:
            into.setdefault(phase, []).append({"name": node["name"], "members": node["members"]})
            return
        keyed = any(map(_members, node.values()))
        for key, value in node.items():
            if _members(value) or keyed and value == []:
                into.setdefault(phase, []).append({"name": key, "members": value})
            elif key == "stages" and isinstance(value, dict):
                for name, members in value.items():
                    if isinstance(members, list):
                        into.setdefault(phase, []).append({"name": name, "members": members})
                    else:
                        _find(members, phase, into)
            else:
                _find(value, phase, into)


def _no_constant(name: str):
    raise ValueError(name)


def parse_snapshot(payload: str) -> dict | None:
    """The payload as a record of ``FIELDS``, numbers as their text. None if it isn't JSON in full or no object; text that itself
    encodes a payload is decoded once more."""
    load = lambda s: json.loads(s, parse_int=str, parse_float=str, parse_constant=_no_constant)
    try:
        node = load(payload)
        layout = "plain"
        if isinstance(node, str):
            node, layout = load(node), "encoded"
        if not isinstance(node, dict):
            return None
        found: dict[str, list[dict]] = {}
        _find(node, "", found)
    except (ValueError, RecursionError):
        return None
    return {"layout": layout, "phases": [{"phase_name": p, "stages": s} for p, s in found.items()]}


def shred_snapshots(monitor_snapshot: DataFrame) -> DataFrame:
    """Level columns of each snapshot, sent again or not, once. Snapshots without an id or a readable payload give no row."""
    one = monitor_snapshot.where(F.col("snapshot_id").isNotNull() & F.col("payload").isNotNull()).select("snapshot_id", "payload").dropDuplicates(["snapshot_id"])
    return shred(one, "snapshot_id", "payload", FIELDS, parse_snapshot)


_KEYS = {"id": "snapshot_id", "phases_pos": "phase_pos", "stages_pos": "stage_pos", "members_pos": "tracker_pos", "phases_phase_name": "phase_name", "stages_name": "stage_name"}


def _table(shredded: DataFrame, path: str) -> DataFrame:
    return assemble(shredded, FIELDS, path).withColumnsRenamed(_KEYS)


def snapshot_table(monitor_snapshot: DataFrame) -> DataFrame:
    """snapshot_id, hostname, captured_at, and whether the payload could be read."""
    ids = shred_snapshots(monitor_snapshot).select(F.col("id").alias("snapshot_id"), F.lit(True).alias("readable"))
    rows = monitor_snapshot.where(F.col("snapshot_id").isNotNull()).select("snapshot_id", "hostname", "captured_at").dropDuplicates(["snapshot_id"])
    return rows.join(ids, "snapshot_id", "left").withColumn("readable", F.coalesce("readable", F.lit(False)))


def stage_table(shredded: DataFrame) -> DataFrame:
    """A row per stage: its snapshot, phase ('' without phases) and places."""
    return _table(shredded, "phases.stages").select("snapshot_id", "phase_pos", "phase_name", "stage_pos", "stage_name")


def tracker_table(shredded: DataFrame) -> DataFrame:
    """A row per tracker, with its place among all objects of its stage."""
    rows = _table(shredded, "phases.stages.members").where(F.col("members_type") == "tracker")
    flags = {f"members_{c}": c for c in ("spawned", "teardown_initiated", "teardown_complete", "completed_prev_trackers")}
    return rows.select("snapshot_id", "phase_pos", "phase_name", "stage_pos", "stage_name", "tracker_pos", *[F.col(k).alias(v) for k, v in flags.items()])


def child_table(shredded: DataFrame) -> DataFrame:
    """A row per value in prev_trackers, worker_queue_sizes or next_stages of a tracker; null and empty values give none but keep their place."""
    parts = []
    for kind in CHILDREN:
        rows = _table(shredded, f"phases.stages.members.{kind}").where((F.col("members_type") == "tracker") & (F.col("value") != ""))
        parts.append(rows.select("snapshot_id", "phase_pos", "phase_name", "stage_pos", "stage_name", "tracker_pos", F.lit(kind).alias("child_kind"), F.col(f"{kind}_pos").alias("child_pos"), F.col("value").alias("child_value")))
    return reduce(DataFrame.union, parts)
