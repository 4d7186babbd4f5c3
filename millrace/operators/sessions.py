"""Sessions of clicks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Fold:
    """The session that is open, if any, and those that closed. A session is anchored at its first click: the first click ``threshold`` or more after that closes it, and the next one opens another.

    Clicks come in runs of one user, in order of time. What closes a session is searched for by bisection among the times of the run, so a run costs a step per session, not per click."""

    def __init__(self, threshold: int, emit_open: bool):
        self.threshold, self.emit_open = threshold, emit_open
        self.user = self.start = self.last = None
        self.begun = False
        self.done: list[tuple] = []

    def run(self, user, times: np.ndarray, urls: pa.Array) -> None:
        """Takes a run of clicks, of the user of the run before or of another."""
        if not self.begun or user != self.user:
            self.end()
            self.user, self.begun = user, True
        at, n = 0, len(times)
        while at < n:
            if self.start is None:
                self.start = int(times[at]), urls[at].as_py()
                at += 1
            at += int(np.searchsorted(times[at:], self.start[0] + self.threshold))
            if at < n:
                self.done.append((user, *self.start, int(times[at]), urls[at].as_py()))
                self.start = None
                at += 1
        self.last = int(times[-1]), urls[n - 1].as_py()

    def end(self) -> None:
        """No more clicks of this user come."""
        if self.emit_open and self.start is not None:
            self.done.append((self.user, *self.start, *self.last))
        self.start = None

    def taken(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def click_sessions(df: DataFrame, user: str, ts: str, url: str, threshold_us: int, emit_open: bool = False, tie: list[str] | None = None) -> DataFrame:
    """Closed sessions per user: user, start_us, start_url, end_us, end_url. A session still open at a user's last click gives a row only with
    ``emit_open`` (whose end is its last click). Clicks at one time are taken by url, then ``tie``.

    Clicks are hashed to tasks by user and sorted there by time, which spills; the fold then holds one open session and one batch at a time, so
    a user's clicks never have to be in memory, and goes from session to session by bisection. Users or times that are null are left out.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(F.col(user).alias("user"), micros.alias("ts"), F.col(url).alias("url"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(tie or [])])
    rows = rows.repartition("user").sortWithinPartitions("user", "ts", "url", *[f"tie{i}" for i in range(len(tie or []))]).select("user", "ts", "url")
    out = T.StructType([rows.schema["user"], *[T.StructField(n, t) for n, t in (("start_us", T.LongType()), ("start_url", T.StringType()), ("end_us", T.LongType()), ("end_url", T.StringType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, types = Fold(threshold_us, emit_open), None

        def ready(rows):
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], out.names)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            users, times = b.column(0), b.column(1).to_numpy()
            types = (users.type, pa.int64(), pa.string(), pa.int64(), pa.string())
            new = pc.not_equal(users[1:], users[:-1]).to_numpy(zero_copy_only=False) if n > 1 else np.array([], bool)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
            for i, j in zip(edges, edges[1:], strict=False):
                fold.run(users[i].as_py(), times[i:j], b.column(2).slice(i, j - i))
            if rows := fold.taken():
                yield from ready(rows)
        fold.end()
        if rows := fold.taken():
            yield from ready(rows)

    return rows.mapInArrow(run, out)
