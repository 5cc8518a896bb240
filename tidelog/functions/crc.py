"""CRC32-Castagnoli, which Spark SQL lacks: a table from its polynomial, and a column function in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1)
def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


def crc32c(data: bytes, crc: int = 0) -> int:
    table, crc = _table(), crc ^ 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def crc32c_of_all(values: list[bytes]) -> np.ndarray:
    """Checksums of many values: one step for each byte place, over all values that reach it."""
    order = np.argsort([-len(v) for v in values], kind="stable")
    sizes = np.array([len(values[i]) for i in order])
    data = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    at, table = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64), np.array(_table(), np.uint32)
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    for place in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -place, "left"))  # sizes over place come first
        crc[:n] = crc[:n] >> np.uint32(8) ^ table[(crc[:n] ^ data[at[:n] + place]) & np.uint32(255)]
    out = np.empty(len(values), np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(T.LongType())
def crc32c_col(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        there = s.notna()
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        out[there] = crc32c_of_all([x.encode() if isinstance(x, str) else bytes(x) for x in s[there]])
        yield out
