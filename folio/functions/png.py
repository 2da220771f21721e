"""PNG images as numpy arrays: what figure crops need, with zlib and numpy only.

Read are images of 8 bits a sample (grey, RGB, palette, each with or without alpha) that are not
interlaced; written are RGB images. Rows are filtered against their neighbours (five kinds, one a
row); undoing that runs along the diagonals of the image, all rows at once, as a sample needs the
ones left, above and above left of it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Signature, colour types and their samples a pixel.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, RGB, PALETTE, GREY_ALPHA, RGBA = 0, 2, 3, 4, 6
SAMPLES = {GREY: 1, RGB: 3, PALETTE: 1, GREY_ALPHA: 2, RGBA: 4}


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise ValueError("damaged PNG chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("PNG ends early")


def _nearest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and above left the one nearest to a + b - c."""
    p = a + b - c
    da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def _unfiltered(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """rows: height x width x samples, filtered; kinds: each row's filter."""
    height, width, samples = rows.shape
    if (kinds > 4).any():
        raise ValueError("unknown PNG filter")
    if not kinds.any():
        return rows
    out = np.zeros((height + 1, width + 1, samples), np.uint8)  # with an empty row above and an empty column at the left
    for diagonal in range(height + width - 1):
        r = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        c = diagonal - r
        left, up, corner = (out[r + 1, c].astype(np.int16), out[r, c + 1].astype(np.int16), out[r, c].astype(np.int16))
        kind = kinds[r][:, None]
        guess = np.where(kind == 1, left, np.where(kind == 2, up, np.where(kind == 3, (left + up) // 2, np.where(kind == 4, _nearest(left, up, corner), 0))))
        out[r + 1, c + 1] = (rows[r, c] + guess).astype(np.uint8)
    return out[1:, 1:]


def decode(data: bytes) -> np.ndarray:
    """height x width x 3; alpha is dropped."""
    header, palette, body = None, None, []
    for kind, content in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(content)
    if header is None or header[2] != 8 or header[3] not in SAMPLES or header[6]:
        raise ValueError("PNG of an unsupported kind")
    width, height, _, colour = header[:4]
    samples = SAMPLES[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (1 + width * samples):
        raise ValueError("PNG data of the wrong size")
    lines = raw.reshape(height, -1)
    pixels = _unfiltered(lines[:, 1:].reshape(height, width, samples), lines[:, 0])
    if colour == PALETTE:
        if palette is None:
            raise ValueError("PNG without its palette")
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if colour in (GREY, GREY_ALPHA) else pixels[:, :, :3]


def _filtered(pixels: np.ndarray, kind: int) -> np.ndarray:
    grown = np.pad(pixels.astype(np.int16), ((1, 0), (1, 0), (0, 0)))
    left, up, corner = grown[1:, :-1], grown[:-1, 1:], grown[:-1, :-1]
    guess = (np.zeros_like(left), left, up, (left + up) // 2, _nearest(left, up, corner))[kind]
    return (pixels - guess).astype(np.uint8)


def encode(pixels: np.ndarray, filters: tuple[int, ...] = (0,)) -> bytes:
    """An RGB image; rows take the given filters in turn."""
    height, width, _ = pixels.shape
    kinds = np.resize(np.array(filters, np.uint8), height)
    rows = np.zeros((height, 1 + width * 3), np.uint8)
    rows[:, 0] = kinds
    for kind in set(filters):
        rows[kinds == kind, 1:] = _filtered(pixels, kind)[kinds == kind].reshape(-1, width * 3)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, RGB, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")
