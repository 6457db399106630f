"""PNG by the standard library: 1-bit and RGB(A) out, 8-bit and 1-bit without interlacing in."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from quire.raster.kernels import packed_bits
from quire.sources import jpeg

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _file(width: int, height: int, depth: int, color: int, rows: np.ndarray) -> bytes:
    filtered = np.concatenate((np.zeros((height, 1), np.uint8), rows.reshape(height, -1)), axis=1)
    header = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + _chunk(b"IEND", b"")


def encode_bw(image: np.ndarray) -> bytes:
    """One bit a pixel, white where red > 127."""
    return _file(image.shape[1], image.shape[0], 1, 0, packed_bits(image))


def encode_rgb(image: np.ndarray, alpha: bool = False) -> bytes:
    return _file(image.shape[1], image.shape[0], 8, 6 if alpha else 2, np.ascontiguousarray(image[..., : 4 if alpha else 3]))


def encode(image: np.ndarray, mode: str) -> tuple[bytes, str]:
    """By colour mode: one bit for the black-and-white ones, else RGB."""
    return (encode_bw(image) if mode in ("bw", "bw-otsu") else encode_rgb(image)), "image/png"


def encode_jpeg(image: np.ndarray, quality: float) -> bytes:
    """By Pillow if it is there, else by numpy."""
    try:
        from PIL import Image
    except ImportError:
        return jpeg.encode(image, quality)
    import io

    out = io.BytesIO()
    Image.fromarray(image[..., :3]).save(out, "JPEG", quality=round(100 * quality))
    return out.getvalue()


def decode_jpeg(data: bytes) -> np.ndarray:
    """height x width x 3 bytes, by Pillow if it is there, else by numpy."""
    try:
        from PIL import Image
    except ImportError:
        return jpeg.decode(data)
    import io

    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def encode_as_saved(image: np.ndarray, mode: str, quality: float) -> tuple[bytes, str]:
    """As documents are saved: one-bit PNG for the black-and-white modes, JPEG for others."""
    if mode in ("bw", "bw-otsu"):
        return encode_bw(image), "image/png"
    return encode_jpeg(image, quality), "image/jpeg"


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Lines of a PNG without their filters. raw: lines of bytes, each behind the number of its filter; step: bytes
    between a byte and the one left of it.

    Filters that look left and up make each pixel wait for two others, so pixels are taken diagonal by diagonal: those
    of one, a pixel of each line, wait for earlier ones only.
    """
    kinds, lines = raw[:, 0], raw[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("a line has a filter that does not exist")
    if not (kinds > 2).any():
        out = lines.copy()
        for y in np.flatnonzero(kinds):
            if kinds[y] == 1:
                out[y] = np.cumsum(lines[y].reshape(-1, step), 0, np.uint8).ravel()
            elif y:
                out[y] += out[y - 1]
        return out
    height, width = len(lines), lines.shape[1] // step
    pixels = lines.reshape(height, width, step).astype(np.int16)
    kind = kinds[:, None]
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner, k = out[y + 1, x], out[y, x + 1], out[y, x], kind[y]
        guess = left + up - corner
        a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(k, (np.int16(0), left, up, (left + up) >> 1, nearest))
        out[y + 1, x + 1] = (pixels[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 bytes."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, header = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
    width, height, depth, color, _, _, interlace = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if channels is None or interlace or (depth, color) not in ((1, 0), (8, color)):
        raise ValueError(f"PNG of depth {depth}, colour type {color}, interlacing {interlace} is not supported")
    stride, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, stride + 1)
    rows = unfiltered(raw, step)
    if depth == 1:
        plain = np.unpackbits(rows, axis=1)[:, :width, None] * np.uint8(255)
    else:
        plain = rows.reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = plain[..., :3] if channels >= 3 else plain[..., :1]
    if channels in (2, 4):
        out[..., 3] = plain[..., -1]
    return out
