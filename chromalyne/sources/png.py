"""8-bit RGB and grey PNG files, written and read with zlib alone. Pixels are BGR, row after row, as in Spark's image source."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray) -> bytes:
    """height x width x 3 (BGR) or x 1 (grey) bytes to a PNG file."""
    height, width, depth = pixels.shape
    if depth not in (1, 3) or not height or not width:
        raise ValueError("one or three channels and at least one pixel are needed")
    rgb = np.ascontiguousarray(pixels[..., ::-1]).astype(np.uint8)
    rows = np.zeros((height, 1 + width * depth), np.uint8)  # each row begins with filter 0
    rows[:, 1:] = rgb.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if depth == 3 else 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")
