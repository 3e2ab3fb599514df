"""PNG files as arrays of bytes, for use inside tasks: every colour type and depth, with or without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: how a file begins, samples per pixel by colour type, the depths that each type may have, and
# the seven interlaced passes as (first column, first row, column step, row step).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
GREY_ALPHA, PALETTE = 4, 3


def _chunks(content: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(content):
        size, name = struct.unpack_from(">I4s", content, at)
        if at + 12 + size > len(content):
            return
        yield name, content[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(data: np.ndarray, filters: np.ndarray, unit: int) -> np.ndarray:
    """Bytes (rows, columns, unit) of filtered ones.

    Where a filter needs the left neighbour's result, all rows advance together along diagonals, on which every byte's left,
    upper and upper left neighbours are known.
    """
    rows, columns = data.shape[0], data.shape[1]
    out = np.zeros((rows + 1, columns + 1, unit), np.int16)
    if not np.isin(filters, (3, 4)).any():
        for y in range(rows):
            line = data[y].astype(np.int64)
            if filters[y] == 1:
                line = np.cumsum(line, axis=0)
            elif filters[y] == 2:
                line = line + out[y, 1:]
            out[y + 1, 1:] = line & 255
        return out[1:, 1:].astype(np.uint8)
    for d in range(rows + columns - 1):
        y = np.arange(max(0, d - columns + 1), min(rows, d + 1))
        x, kind = d - y, filters[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[y + 1, x + 1] = (data[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _pass(raw: memoryview, width: int, height: int, samples: int, depth: int) -> tuple[np.ndarray, int]:
    """Samples (height, width, samples) of one pass, and how many bytes it took. Of 16 bits the upper 8 are kept."""
    size, unit = (width * samples * depth + 7) // 8, max(1, samples * depth // 8)
    used = height * (size + 1)
    if len(raw) < used:
        raise ValueError("too little image data")
    lines = np.frombuffer(raw[:used], np.uint8).reshape(height, size + 1)
    if lines[:, 0].max() > 4:
        raise ValueError("unknown filter")
    whole = _unfiltered(lines[:, 1:].reshape(height, size // unit, unit), lines[:, 0], unit).reshape(height, size)
    if depth == 16:
        return whole.reshape(height, width, samples, 2)[..., 0], used
    if depth == 8:
        return whole.reshape(height, width, samples), used
    bits = np.unpackbits(whole, axis=1).reshape(height, -1, depth)[:, : width * samples]
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8).reshape(height, width, samples), used


def decode_png(content: bytes) -> np.ndarray:
    """Bytes (height, width, channels): grey 1, grey with alpha 2, colours 3, colours with alpha 4. A palette gives colours.

    Grey of fewer than 8 bits is stretched to 0..255. Raises ValueError for what isn't a whole PNG file.
    """
    if not content.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    head, palette, parts = None, None, []
    for name, body in _chunks(content):
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            parts.append(body)
    if head is None or min(head[:2]) < 1 or head[2] not in DEPTHS.get(head[3], ()):
        raise ValueError("no usable header")
    width, height, depth, kind, packing, filtering, interlaced = head
    if packing or filtering or interlaced > 1 or kind == PALETTE and palette is None:
        raise ValueError("no usable header")
    try:
        raw = memoryview(zlib.decompressobj().decompress(b"".join(parts)))
    except zlib.error as error:
        raise ValueError("broken image data") from error
    samples = SAMPLES[kind]
    if interlaced:
        out = np.zeros((height, width, samples), np.uint8)
        for x, y, right, below in PASSES:
            w, h = -(-(width - x) // right), -(-(height - y) // below)
            if w > 0 and h > 0:
                out[y::below, x::right], used = _pass(raw, w, h, samples, depth)
                raw = raw[used:]
    else:
        out, _ = _pass(raw, width, height, samples, depth)
    if kind == PALETTE:
        if out.max() >= len(palette):
            raise ValueError("colour beyond the palette")
        return palette[out[..., 0]]
    return out * (255 // ((1 << depth) - 1)) if depth < 8 else out


def encode_png(values: np.ndarray) -> bytes:
    """A PNG file of bytes (height, width, channels) with one, two, three or four channels."""
    height, width, channels = values.shape
    kind = {1: 0, 2: GREY_ALPHA, 3: 2, 4: 6}[channels]
    lines = np.ascontiguousarray(values, np.uint8).reshape(height, width * channels)
    # Each row as its difference from the one above (filter 2).
    above = np.concatenate((np.zeros((1, width * channels), np.uint8), lines[:-1]))
    filtered = np.concatenate((np.full((height, 1), 2, np.uint8), lines - above), axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes())) + chunk(b"IEND", b"")
