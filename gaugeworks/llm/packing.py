"""Compact numbers, and rows of them, between the tasks of an operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes."""
    v = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T.copy()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.reshape(-1).view(np.uint64)


_SHORT, _WIDE = 240, 1 << 20


def pack_codes(values: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent: a byte for those below 240, otherwise the
    upper four bits there and two bytes apart."""
    v = np.asarray(values, np.int64)
    if len(v) and v.max() >= _WIDE:
        return b"\0" + pack(v)
    long = v >= _SHORT
    rest = v[long]
    squeeze = zstandard.ZstdCompressor(level=9).compress
    planes = [squeeze(x.astype(np.uint8).tobytes()) for x in (np.where(long, _SHORT + (v >> 16), v), rest & 255, (rest >> 8) & 255)]
    return b"\1" + b"".join(len(x).to_bytes(8, "big") for x in planes) + b"".join(planes)


def unpack_codes(blob: bytes) -> np.ndarray:
    if blob[0] == 0:
        return unpack(blob[1:]).astype(np.int64)
    ends = 25 + np.cumsum([0] + [int.from_bytes(blob[1 + 8 * k : 9 + 8 * k], "big") for k in range(3)])
    first, low, high = (np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[a:b]), np.uint8) for a, b in zip(ends[:-1], ends[1:], strict=True))
    out = first.astype(np.int64)
    long = out >= _SHORT
    out[long] = ((out[long] - _SHORT) << 16) + (high.astype(np.int64) << 8) + low
    return out


def rows_of(rows: list[tuple], names: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(names)], names=[n for n, _ in names])


def groups(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each partition that occurs, and the positions with it, in order."""
    order = np.argsort(part, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            yield int(part[order[a]]), order[a:b]
