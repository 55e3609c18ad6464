"""Minimal PNG writer (zlib + struct) for test fixtures."""

import struct
import zlib

import numpy as np


def write_png(path: str, arr: np.ndarray) -> None:
    """Write an 8-bit gray (H×W) or RGB (H×W×3) image."""
    arr = np.asarray(arr, dtype=np.uint8)
    h, w = arr.shape[:2]
    color = 2 if arr.ndim == 3 else 0
    raw = b"".join(b"\x00" + arr[y].tobytes() for y in range(h))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n")
        f.write(chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)))
        f.write(chunk(b"IDAT", zlib.compress(raw)))
        f.write(chunk(b"IEND", b""))
