"""MurmurHash3 (x86, 32 bits) of strings, as signed integers. Spark's own hash differs in its tail bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quern.session import ship

SESSION_SEED = 104729

_U = np.uint32


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(32 - r))


def murmur3_many(texts: pa.Array, seed: int = SESSION_SEED) -> np.ndarray:
    """Hash of each text's UTF-8 bytes: all texts take each four-byte step together."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.concatenate([np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    start, size = offsets[:-1], np.diff(offsets)
    mixed = lambda k: _rotl(k * _U(0xCC9E2D51), 15) * _U(0x1B873593)
    h = np.full(len(texts), seed, np.uint32)
    rows, step = np.flatnonzero(size >= 4), 0
    while len(rows):
        p = start[rows] + 4 * step
        k = raw[p] | raw[p + 1] << _U(8) | raw[p + 2] << _U(16) | raw[p + 3] << _U(24)
        h[rows] = _rotl(h[rows] ^ mixed(k), 13) * _U(5) + _U(0xE6546B64)
        step += 1
        rows = rows[size[rows] >= 4 * (step + 1)]
    p, rest = start + size // 4 * 4, size % 4
    k = np.zeros(len(texts), np.uint32)
    for i in range(3):
        k |= np.where(rest > i, raw[np.minimum(p + i, len(raw) - 1)], _U(0)) << _U(8 * i)
    h ^= mixed(k)
    h ^= size.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> _U(shift))) * _U(factor)
    return h.view(np.int32)


def murmur3_32(data: bytes, seed: int = SESSION_SEED) -> int:
    return int(murmur3_many(pa.array([data], pa.large_binary()), seed)[0])


def murmur3(text: Column, seed: int = SESSION_SEED) -> Column:
    """Hash of each text; null for null. Hash only the distinct keys where rows repeat them."""
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(murmur3_many(pa.array(values, pa.large_string()), seed), dtype="Int32").mask(values.isna().to_numpy())

    return run(text)
