"""PNG files to and from arrays of bytes, for workers without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type: gray, RGB, palette, gray with alpha, RGB with alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes):
    """(kind, body) of a file's chunks, each held against its checksum."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at = len(SIGNATURE)
    while at < len(data):
        if len(data) < at + 12:
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r} is broken")
        yield kind, body
        at += 12 + n


def unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of (filter, bytes) as they were before filtering; step: bytes from a sample to the one on its left."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1 + step), dtype=np.uint8)  # zeros above and to the left
    for y, (kind, line) in enumerate(zip(rows[:, 0], rows[:, 1:]), 1):
        up = out[y - 1]
        if kind == 0:
            out[y, step:] = line
        elif kind == 1:
            out[y, step:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[y, step:] = line + up[step:]
        elif kind in (3, 4):
            left, above, corner = [0] * step, up[step:].tolist(), up.tolist()
            row = left + line.tolist()
            for x, b in enumerate(above):
                a = row[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = corner[x]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[x + step] = (row[x + step] + guess) & 255
            out[y] = row
        else:
            raise ValueError(f"filter {kind}")
    return out[1:, step:]


def decode(data: bytes) -> np.ndarray:
    """Height x width x samples of a file of 8 or 16 bits (the upper 8 are kept), not interlaced; ValueError for any other."""
    head, palette, packed, ended = None, None, [], False
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
    if head is None or not ended:
        raise ValueError("the file is cut off")
    width, height, bits, colour, _, _, interlaced = head
    if colour not in SAMPLES or bits not in (8, 16) or interlaced:
        raise ValueError(f"colour type {colour} of {bits} bits, interlaced {interlaced}, is not read here")
    step = SAMPLES[colour] * bits // 8
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, 1 + width * step)
    except zlib.error as e:
        raise ValueError("the pixels can't be inflated") from e
    out = unfiltered(rows, step).reshape(height, width, SAMPLES[colour], bits // 8)[..., 0]
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("a colour is missing in the palette")
        return palette[out[..., 0]]
    return out


def encode(pixels: np.ndarray) -> bytes:
    """A file of gray (one sample), gray with alpha, RGB or RGB with alpha."""
    h, w, samples = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[samples]
    rows = np.concatenate((np.zeros((h, 1), dtype=np.uint8), pixels.reshape(h, -1)), axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
