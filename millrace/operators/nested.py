"""Deeply nested records to flat tables, by repetition and definition levels.

``shred`` turns each record into one column of levels per leaf path: for every value, or every place where a value is
missing, the repetition level (which list on the path starts a new entry here, 0 for a new record), the definition
level (how much of the path exists) and the value as text. ``assemble`` rebuilds from such columns, with array
arithmetic over whole Arrow batches, the table of any repeated ancestor: one row per entry, with its place in each list
above it and the values of all single fields on its way. Both run inside one task per record, so neither shuffles.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A field of a nested record: ``repeated`` (a list) or not; without ``children`` it is a leaf.

    A single field adds one definition level (it is there); a list adds three (it is there, it has an entry, the
    entry isn't null) and one repetition level.
    """

    name: str
    repeated: bool = False
    children: tuple[Field, ...] = field(default=())


@dataclass(frozen=True)
class Leaf:
    """What is fixed for a leaf path: ``lists`` are the paths of the lists on it, with the definition level at which the list has an entry."""

    path: str
    lists: tuple[tuple[str, int], ...]
    defined: int


def leaves(fields: Iterable[Field], path: str = "", lists: tuple[tuple[str, int], ...] = (), level: int = 0) -> list[Leaf]:
    out = []
    for f in fields:
        p = f"{path}.{f.name}" if path else f.name
        inside = (*lists, (p, level + 2)) if f.repeated else lists
        d = level + (3 if f.repeated else 1)
        out += leaves(f.children, p, inside, d) if f.children else [Leaf(p, inside, d)]
    return out


def column(path: str) -> str:
    return path.replace(".", "__")


def text(value) -> str:
    """A scalar as text; a value that isn't one is written as JSON."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode()
    return "true" if value is True else "false" if value is False else json.dumps(value)


class _Shredder:
    def __init__(self, fields: tuple[Field, ...]):
        self.columns: dict[str, tuple[list[int], list[int], list[str | None]]] = {leaf.path: ([], [], []) for leaf in leaves(fields)}
        self.fields, self.under = fields, {}
        self._index(fields, "")

    def _index(self, fields, path):
        for f in fields:
            p = f"{path}.{f.name}" if path else f.name
            self.under[p] = [c for k, c in self.columns.items() if k == p or k.startswith(p + ".")]
            self._index(f.children, p)

    def add(self, record: dict | None) -> None:
        for f in self.fields:
            self._field(f, f.name, record.get(f.name) if isinstance(record, dict) else None, 0, 0, 0)

    def _none(self, path, r, d):
        for rs, ds, vs in self.under[path]:
            rs.append(r)
            ds.append(d)
            vs.append(None)

    def _field(self, f, path, value, r, d, depth):
        if value is None:
            self._none(path, r, d)
        elif not f.repeated:
            self._entry(f, path, value, r, d + 1, depth)
        else:
            entries = value if isinstance(value, list) else [value]  # a scalar is a list of one
            if not entries:
                self._none(path, r, d + 1)
            for entry in entries:
                if entry is None:
                    self._none(path, r, d + 2)
                else:
                    self._entry(f, path, entry, r, d + 3, depth + 1)
                r = depth + 1

    def _entry(self, f, path, value, r, d, depth):
        if not f.children:
            for column_, x in zip(self.columns[path], (r, d, text(value)), strict=True):
                column_.append(x)
        elif isinstance(value, dict):
            for child in f.children:
                self._field(child, f"{path}.{child.name}", value.get(child.name), r, d, depth)
        else:
            self._none(path, r, d - 1)


LEVELS = pa.struct([("r", pa.list_(pa.int8())), ("d", pa.list_(pa.int8())), ("v", pa.list_(pa.string()))])
_SPARK_LEVELS = T.StructType([T.StructField("r", T.ArrayType(T.ByteType())), T.StructField("d", T.ArrayType(T.ByteType())), T.StructField("v", T.ArrayType(T.StringType()))])


def shred(df: DataFrame, id_col: str, payload: str, fields: tuple[Field, ...], parse: Callable[[str], dict | None]) -> DataFrame:
    """One row per record of ``df``: its id and, per leaf path of ``fields``, the levels ``struct<r, d, v>``.

    ``parse`` makes a nested record of the payload, or None if it can't be read; such records and null payloads give no row.
    Fields unknown to ``fields`` are passed over. A record is handled whole in one task; nothing is shuffled.
    """
    paths = [leaf.path for leaf in leaves(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, rows = [], {p: [] for p in paths}
                for id_, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    record = parse(raw) if raw is not None else None
                    if record is None:
                        continue
                    one = _Shredder(fields)
                    one.add(record)
                    ids.append(id_)
                    for p, (r, d, v) in one.columns.items():
                        rows[p].append({"r": r, "d": d, "v": v})
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *[pa.array(rows[p], LEVELS) for p in paths]], ["id", *map(column, paths)])

    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), *[T.StructField(column(p), _SPARK_LEVELS) for p in paths]])
    return df.select(id_col, payload).mapInArrow(run, out)


def _place(r: np.ndarray, level: int) -> np.ndarray:
    """Place within its list, at repetition level ``level``, of the entry each position belongs to."""
    count = np.cumsum(r <= level)
    first = np.maximum.accumulate(np.where(r < level, count, 0))
    return count - first


def assemble(shredded: DataFrame, fields: tuple[Field, ...], ancestor: str, nulls: bool = False) -> DataFrame:
    """The table of the list at path ``ancestor``: id, ``<list>_pos`` for each list from the outermost to this one,
    and a text column for every single field on the way or in the entry, named by its last names.

    Entries that are null are left out (``nulls=True`` keeps them); they keep their place in either case. Only the levels of
    the columns needed are read.
    """
    all_leaves = leaves(fields)
    inside = [x for x in all_leaves if any(p == ancestor for p, _ in x.lists)]
    if not inside:
        raise ValueError(f"{ancestor} is no list")
    lists = inside[0].lists[: [p for p, _ in inside[0].lists].index(ancestor) + 1]
    above = {p for p, _ in lists}
    shown = [x for x in all_leaves if all(p in above for p, _ in x.lists) and (x.path == ancestor or any(x.path.startswith(a + ".") for a in above) or not x.lists)]
    base = min(inside, key=lambda x: (len(x.lists), x.path))
    used = list(dict.fromkeys([base, *shown]))
    last = lambda p: p.rpartition(".")[2]
    names = {x.path: "value" if x.path == ancestor else last(x.path.rpartition(".")[0]) + "_" + last(x.path) if "." in x.path else x.path for x in shown}
    id_type = shredded.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {x.path: batch.column(1 + k) for k, x in enumerate(used)}
            levels = {p: [c.field(i).flatten() for i in (0, 1, 2)] for p, c in cols.items()}
            r, d = (levels[base.path][i].to_numpy(zero_copy_only=False) for i in (0, 1))
            depth, there = len(lists), lists[-1][1] + (0 if nulls else 1)
            start = (r <= depth) & (d >= there)
            out = [batch.column(0).take(pa.array(np.cumsum(r == 0)[start] - 1))]
            out += [pa.array(_place(r, k)[start].astype(np.int32)) for k in range(1, depth + 1)]
            for x in shown:
                out.append(levels[x.path][2].take(pa.array(np.cumsum(r <= len(x.lists))[start] - 1)))
            yield pa.RecordBatch.from_arrays(out, ["id", *[f"{last(p)}_pos" for p, _ in lists], *names.values()])

    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(f"{last(p)}_pos", T.IntegerType()) for p, _ in lists], *[T.StructField(n, T.StringType()) for n in names.values()]])
    return shredded.select("id", *[column(x.path) for x in used]).mapInArrow(run, schema)
