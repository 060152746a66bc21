"""CRC-32C and MurmurHash2, which Spark has not, over batches of keys."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _crc_table() -> list[int]:
    """The reflected Castagnoli polynomial's remainders."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc_table()


_TABLE = np.array(_CRC, dtype=np.uint32)


@functools.lru_cache(64)
def _after_zeros(n: int) -> list[list[int]]:
    """For each byte of a state, what n zero bytes make of it."""
    state = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for _ in range(n):
        state = (state >> 8) ^ _TABLE[state & 0xFF]
    return state.tolist()


def crc32c(data: bytes) -> int:
    """Short data byte by byte; longer data as lanes that advance together and are then joined, since a CRC is linear."""
    if len(data) < 256:
        crc = 0xFFFFFFFF
        for b in data:
            crc = (crc >> 8) ^ _CRC[(crc ^ b) & 0xFF]
        return crc ^ 0xFFFFFFFF
    width = 1 << (len(data).bit_length() // 2)
    lanes = np.zeros(-(-len(data) // width) * width, dtype=np.uint8)  # zeros in front leave a zero state as it is
    own = lanes[len(lanes) - len(data) :]
    own[:] = np.frombuffer(data, dtype=np.uint8)
    own[:4] ^= 0xFF  # the state begins with all bits set
    lanes = np.ascontiguousarray(lanes.reshape(-1, width).T)
    states = np.zeros(lanes.shape[1], dtype=np.uint32)
    for column in lanes:
        states = (states >> 8) ^ _TABLE[(states ^ column) & 0xFF]
    a, b, c, d = _after_zeros(width)
    crc = 0
    for state in states.tolist():
        crc = a[crc & 0xFF] ^ b[crc >> 8 & 0xFF] ^ c[crc >> 16 & 0xFF] ^ d[crc >> 24] ^ state
    return crc ^ 0xFFFFFFFF


def murmur2(keys: list[bytes]) -> np.ndarray:
    """Signed 32-bit MurmurHash2 with the seed of record-log clients; keys of one length are hashed together."""
    out = np.zeros(len(keys), dtype=np.int32)
    lengths = np.array([len(k) for k in keys], dtype=np.int64)
    m = np.uint32(0x5BD1E995)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        data = np.frombuffer(b"".join(keys[i] for i in at), dtype=np.uint8).reshape(len(at), n)
        h = np.full(len(at), 0x9747B28C ^ int(n), dtype=np.uint32)
        words = n // 4
        for w in range(words):
            k = np.ascontiguousarray(data[:, 4 * w : 4 * w + 4]).view("<u4")[:, 0] * m
            k ^= k >> np.uint32(24)
            h = (h * m) ^ (k * m)
        if n % 4:
            for i in range(n % 4):
                h ^= data[:, 4 * words + i].astype(np.uint32) << np.uint32(8 * i)
            h *= m
        h ^= h >> np.uint32(13)
        h *= m
        h ^= h >> np.uint32(15)
        out[at] = h.view(np.int32)
    return out


@F.pandas_udf(T.IntegerType())
def murmur2_of(keys: pd.Series) -> pd.Series:
    return pd.Series(murmur2([bytes(k or b"") for k in keys]))


@F.pandas_udf(T.LongType())
def crc32c_of(data: pd.Series) -> pd.Series:
    return pd.Series([crc32c(bytes(d or b"")) for d in data])


def partition_for_key(key: Column, partitions: int) -> Column:
    """The key's hash without its sign, modulo the number of partitions."""
    if partitions <= 0:
        raise ValueError("partitions must be positive")
    return murmur2_of(key).bitwiseAND(0x7FFFFFFF) % F.lit(partitions)
