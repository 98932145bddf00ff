"""32-bit Murmur3 (x86, seed 0) over Arrow arrays, vectorised with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Fixed values of the published hash function.
C1, C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
ADD, FINAL1, FINAL2 = np.uint32(0xE6546B64), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _mixed(k: np.ndarray) -> np.ndarray:
    return _rotl(k * C1, 15) * C2


def _block(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _rotl(h ^ _mixed(k), 13) * np.uint32(5) + ADD


def _finish(h: np.ndarray, length: int) -> np.ndarray:
    h = h ^ np.uint32(length)
    h = (h ^ (h >> np.uint32(16))) * FINAL1
    h = (h ^ (h >> np.uint32(13))) * FINAL2
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def hash_longs(values: np.ndarray) -> np.ndarray:
    """Hash of each 64-bit number's eight little-endian bytes."""
    raw = np.ascontiguousarray(values, dtype="<i8").view("<u4").reshape(-1, 2)
    h = np.zeros(len(raw), dtype=np.uint32)
    h = _block(_block(h, raw[:, 0]), raw[:, 1])
    return _finish(h, 8)


def _hash_matrix(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of a byte matrix."""
    n, length = rows.shape
    h = np.zeros(n, dtype=np.uint32)
    whole = length // 4
    if whole:
        words = np.ascontiguousarray(rows[:, : whole * 4]).view("<u4")
        for i in range(whole):
            h = _block(h, words[:, i])
    rest = rows[:, whole * 4 :].astype(np.uint32)
    if rest.shape[1]:
        k = np.zeros(n, dtype=np.uint32)
        for i in range(rest.shape[1]):
            k |= rest[:, i] << np.uint32(8 * i)
        h = h ^ _mixed(k)
    return _finish(h, length)


def hash_binary(values: pa.Array) -> np.ndarray:
    """Hash of each value's bytes; equal lengths are hashed together. Nulls give any number."""
    array = values.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros(len(array), dtype=np.int32)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, 16_000_000 // max(int(length), 1))  # long values in slices of bounded size
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            out[part] = _hash_matrix(data[offsets[part][:, None] + np.arange(length)] if length else np.zeros((len(part), 0), np.uint8))
    return out


def hash_decimals(values: pa.Array) -> np.ndarray:
    """Hash of each unscaled value's shortest big-endian two's complement form."""
    array = values.cast(pa.decimal128(38, values.type.scale)) if values.type.precision != 38 else values
    raw = np.frombuffer(array.buffers()[1], dtype=np.uint8).reshape(-1, 16)[array.offset : array.offset + len(array), ::-1]
    sign = np.where(raw[:, 0] >= 128, 255, 0).astype(np.uint8)
    # A leading byte may go if it only repeats the sign of the byte after it.
    spare = (raw[:, :-1] == sign[:, None]) & ((raw[:, 1:] >= 128) == (sign[:, None] == 255))
    lead = np.where(spare.all(axis=1), 15, np.argmin(spare, axis=1))
    out = np.zeros(len(array), dtype=np.int32)
    for skip in np.unique(lead):
        at = np.flatnonzero(lead == skip)
        out[at] = _hash_matrix(np.ascontiguousarray(raw[at][:, skip:]))
    return out


def hash_one(data: bytes) -> int:
    return int(_hash_matrix(np.frombuffer(data, dtype=np.uint8).reshape(1, -1))[0])
