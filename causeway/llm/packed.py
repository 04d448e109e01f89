"""Arrays of unsigned integers as bytes: one zstd frame for each byte of the widest value, lowest byte first."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Small or slowly varying values leave their upper planes all but empty."""
    import zstandard

    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    frames = [squeeze(np.ascontiguousarray(planes[:, j]).tobytes()) for j in range(width)]
    head = np.array([len(values), width, *map(len, frames)], dtype="<u8")
    return head.tobytes() + b"".join(frames)


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    n, width = np.frombuffer(raw, dtype="<u8", count=2).tolist()
    sizes = np.frombuffer(raw, dtype="<u8", count=width, offset=16).tolist()
    out = np.zeros((n, 8), dtype=np.uint8)
    at = 16 + 8 * width
    expand = zstandard.ZstdDecompressor()
    for j, size in enumerate(sizes):
        out[:, j] = np.frombuffer(expand.decompress(raw[at : at + size], max_output_size=max(n, 1)), dtype=np.uint8) if n else 0
        at += size
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def pack_sorted(values: np.ndarray, base: int = 0) -> bytes:
    """Rising values as their differences."""
    return pack(np.diff(values, prepend=np.uint64(base)))


def unpack_sorted(raw: bytes, base: int = 0) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64) + np.uint64(base)
