"""Greyscale and colour images as PNG bytes, with nothing but zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes a pixel by colour type: grey, RGB, grey with alpha, RGB with alpha.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(a: np.ndarray) -> bytes:
    """An array of height, width and, unless grey, channels, in 8 bits."""
    a = np.ascontiguousarray(a, dtype=np.uint8)
    kind = next(k for k, n in CHANNELS.items() if n == (1 if a.ndim == 2 else a.shape[2]))
    rows = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), a.reshape(a.shape[0], -1)], axis=1)
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Rows that begin with their filter's number, as plain bytes."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(rows.shape[1] - 1, np.uint8)
    for y, row in enumerate(rows):
        kind, line = row[0], row[1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, bpp), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
        elif kind in (3, 4):
            for i in range(len(line)):
                left = int(line[i - bpp]) if i >= bpp else 0
                up, corner = int(above[i]), int(above[i - bpp]) if i >= bpp else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
                line[i] = (int(line[i]) + guess) & 0xFF
        elif kind:
            raise ValueError(f"unknown filter {kind}")
        out[y] = above = line
    return out


def decode(data: bytes) -> np.ndarray:
    """The array of an 8-bit PNG that is neither interlaced nor paletted."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    width, height, bits, kind, _, _, interlaced = head
    if bits != 8 or kind not in CHANNELS or interlaced:
        raise ValueError("only plain 8-bit images")
    n = CHANNELS[kind]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
    out = _unfiltered(rows, n)
    return out.reshape(height, width) if n == 1 else out.reshape(height, width, n)


#: Digits, three columns by five rows, a row to each group of three bits.
DIGITS = tuple(
    np.array([[int(c) for c in row] for row in shape.split()], bool)
    for shape in (
        "111 101 101 101 111", "010 110 010 010 111", "111 001 111 100 111", "111 001 111 001 111", "101 101 111 001 001",
        "111 100 111 001 111", "111 100 111 101 111", "111 001 010 010 010", "111 101 111 101 111", "111 101 111 001 111",
    )
)
#: Fixed value: boxes up to this number are labelled with their index.
MOST_LABELS = 50


def colour(i: int) -> tuple[int, int, int]:
    """The colour of the i-th box."""
    return i % 6, 3 * i % 6, 5 * i % 6


def overlay(a: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The image in colour with a one-pixel frame around every box, cut at the edges, and few boxes numbered."""
    out = np.repeat(a[..., None], 3, axis=2) if a.ndim == 2 else a[..., :3].copy()
    height, width = out.shape[:2]
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        c = colour(i)
        left, right, top, bottom = max(0, x0), min(width - 1, x1), max(0, y0), min(height - 1, y1)
        for y in (y0, y1):
            if 0 <= y < height:
                out[y, left : right + 1] = c
        for x in (x0, x1):
            if 0 <= x < width:
                out[top : bottom + 1, x] = c
        if len(boxes) <= MOST_LABELS:
            for k, digit in enumerate(str(i)):
                ys, xs = np.nonzero(DIGITS[int(digit)])
                ys, xs = ys + y0 + 1, xs + x0 + 1 + 4 * k
                ok = (ys >= 0) & (ys < height) & (xs >= 0) & (xs < width)
                out[ys[ok], xs[ok]] = c
    return out
