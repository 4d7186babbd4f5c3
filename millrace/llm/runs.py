"""Reading sorted Arrow batches of a partition group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Of batches sorted by their first ``keys`` columns: (key, rows) in order; a group goes on while the key stays the
    same, so a group may come in several pieces and never has to be in memory whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        change[0] = True
        for k in range(keys):
            c = batch.column(k)
            if n > 1:
                same = pc.or_kleene(pc.and_kleene(pc.is_null(c[1:]), pc.is_null(c[:-1])), pc.fill_null(pc.equal(c[1:], c[:-1]), False))
                change[1:] |= ~same.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(change).tolist() + [n]
        for i, j in zip(at, at[1:], strict=False):
            yield tuple(batch.column(k)[i].as_py() for k in range(keys)), batch.slice(i, j - i)


def gathered(parts: list[pa.RecordBatch], least: int, last: bool = False) -> Iterator[pa.RecordBatch]:
    """Joins small batches in ``parts`` into one once they hold ``least`` rows, and empties the list."""
    if parts and (last or sum(p.num_rows for p in parts) >= least):
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
        parts.clear()
