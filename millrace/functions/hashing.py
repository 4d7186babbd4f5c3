"""The 64-bit hash that binary keys are partitioned by: the first half of Murmur3 x64-128, seed 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of the published algorithm.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_N1, _N2, _FIVE = np.uint64(0x52DCE729), np.uint64(0x38495AB5), np.uint64(5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(k: np.ndarray) -> np.ndarray:
    k = (k ^ (k >> np.uint64(33))) * _F1
    k = (k ^ (k >> np.uint64(33))) * _F2
    return k ^ (k >> np.uint64(33))


def _same_length(words: np.ndarray, length: int) -> np.ndarray:
    """The hashes of keys of one length, given as rows of 64-bit words, zeros behind their ends."""
    h1 = np.zeros(len(words), np.uint64)
    h2 = h1.copy()
    whole = length // 16
    for i in range(-(-length // 16)):
        k1, k2 = _rotl(words[:, 2 * i] * _C1, 31) * _C2, _rotl(words[:, 2 * i + 1] * _C2, 33) * _C1
        h1 = h1 ^ k1
        if i < whole:
            h1 = (_rotl(h1, 27) + h2) * _FIVE + _N1
        h2 = h2 ^ k2
        if i < whole:
            h2 = (_rotl(h2, 31) + h1) * _FIVE + _N2
    n = np.uint64(length)
    h1, h2 = h1 ^ n, h2 ^ n
    h1 = h1 + h2
    h2 = h2 + h1
    return _mix(h1) + _mix(h2)


def murmur3_64(keys: list[bytes | None]) -> np.ndarray:
    """The hashes as unsigned numbers, 0 for None; keys of equal length are hashed together."""
    out = np.zeros(len(keys), np.uint64)
    lengths = np.array([-1 if k is None else len(k) for k in keys])
    with np.errstate(over="ignore"):
        for n in np.unique(lengths[lengths >= 0]).tolist():
            at = np.flatnonzero(lengths == n)
            wide = -(-n // 16) * 16
            raw = np.zeros((len(at), wide), np.uint8)
            raw[:, :n] = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), n)
            out[at] = _same_length(raw.view("<u8").astype(np.uint64), n)
    return out


@F.pandas_udf(LongType())
def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        keys = [None if k is None else bytes(k) for k in s]
        yield pd.Series(murmur3_64(keys).view(np.int64)).astype("Int64").mask(pd.Series([k is None for k in keys], dtype=bool))


def murmur3(key: Column) -> Column:
    """The hash of a binary column as a signed bigint. Only for parity with such hashes; ``xxhash64`` is the fast way to spread keys."""
    return _signed(key)


def hashed_key(key: Column) -> Column:
    """The hash of a binary key as the 8 bytes that hashed boundaries are compared with: the number's bytes, least first."""
    big = F.lpad(F.hex(murmur3(key)), 16, "0")
    return F.unhex(F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(8)]))
