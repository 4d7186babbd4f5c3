"""Joining a large table with a lookup table whose size isn't known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup table of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys of which nulls equal each other."""
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(other, on, how).drop(*[f"__{k}" for k in keys])


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "left", salts: int = 16, broadcast_rows: int = BROADCAST_ROWS, null_safe: bool = False) -> DataFrame:
    """``big`` joined with ``small``, which has each key of ``on`` once.

    A small table of at most ``broadcast_rows`` rows (counted first, stopping there) is broadcast. Beyond that both are
    shuffled by key and salt, where ``small`` is repeated ``salts`` times and ``spread`` (a column of ``big`` with many
    values) chooses the salt, so that a key that holds a third of all rows goes to several tasks. A null key finds nothing, or
    with ``null_safe`` the null key of ``small``; ``left`` keeps its row.
    """
    if small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return null_safe_join(big, F.broadcast(small), on, how) if null_safe else big.join(F.broadcast(small), on, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return (null_safe_join(salted, copies, [*on, "__salt"], how) if null_safe else salted.join(copies, [*on, "__salt"], how)).drop("__salt")
