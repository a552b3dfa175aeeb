"""Byte codecs of whole integer columns, and packing kernels, in numpy inside Arrow functions."""

from __future__ import annotations

import bz2
import lzma
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_varints(values: np.ndarray) -> bytes:
    """7-bit groups, low first; the high bit says that more follow."""
    v = values.astype(np.uint64)
    if not len(v):
        return b""
    most = max(1, -(-int(v.max()).bit_length() // 7))
    size = np.ones(len(v), np.int64)
    for k in range(1, most):
        size += (v >> np.uint64(7 * k)) > 0
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(most):
        has = size > k
        byte = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[start[has] + k] = byte | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def decode_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = np.zeros(len(ends), np.uint64)
    for k in range(10):
        has = starts + k <= ends
        out[has] |= (raw[starts[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def zigzagged(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzagged(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.uint64)
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def encode_ints(values: np.ndarray, mode: str = "zigzag") -> bytes:
    """zigzag: count, then zigzag varints. positive: count, number of negatives, their (place, magnitude), the others. text: decimal lines."""
    v = np.asarray(values, np.int64)
    if mode == "text":
        return "\n".join(map(str, v.tolist())).encode()
    if mode == "zigzag":
        return encode_varints(np.array([len(v)])) + encode_varints(zigzagged(v))
    negative = np.flatnonzero(v < 0)
    pairs = np.stack([negative.astype(np.uint64), (-(v[negative].astype(object))).astype(np.uint64)], axis=1).ravel() if len(negative) else np.zeros(0, np.uint64)
    return encode_varints(np.array([len(v), len(negative)])) + encode_varints(pairs) + encode_varints(v[v >= 0])


def decode_ints(data: bytes, mode: str = "zigzag") -> np.ndarray:
    if mode == "text":
        return np.array([int(x) for x in data.decode().split("\n") if x], np.int64)
    raw = decode_varints(data)
    if mode == "zigzag":
        return unzigzagged(raw[1:])
    n, k = int(raw[0]), int(raw[1])
    out = np.zeros(n, np.int64)
    place, size = raw[2 : 2 + 2 * k : 2].astype(np.int64), raw[3 : 3 + 2 * k : 2]
    out[place] = (np.uint64(0) - size).view(np.int64) if k else 0
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = raw[2 + 2 * k :].astype(np.int64)
    return out


def ints_to_bytes(values: Column, mode: str = "zigzag") -> Column:
    """Column of bigint arrays to encoded bytes."""

    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else encode_ints(np.asarray(v, np.int64), mode))

    return encode(values)


def bytes_to_ints(data: Column, mode: str = "zigzag") -> Column:
    @F.pandas_udf("array<bigint>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else decode_ints(bytes(b), mode))

    return decode(data)


def _zstd(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress


KERNELS = {"gzip": lambda b: zlib.compress(b, 9, 31), "bzip2": lambda b: bz2.compress(b, 9), "lzma": lambda b: lzma.compress(b, format=lzma.FORMAT_ALONE, preset=9), "zstd": lambda b: _zstd(19)(b), "none": bytes}
UNPACK = {"gzip": lambda b: zlib.decompress(b, 31), "bzip2": bz2.decompress, "lzma": lzma.decompress, "zstd": lambda b: __import__("zstandard").ZstdDecompressor().decompress(b), "none": bytes}


def packed(data: Column, kernel: str) -> Column:
    """Binary column compressed by a kernel; null stays null."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else KERNELS[kernel](bytes(b)))

    return pack(data)


def unpacked(data: Column, kernel: str) -> Column:
    @F.pandas_udf("binary")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else UNPACK[kernel](bytes(b)))

    return unpack(data)
