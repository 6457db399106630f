"""Baseline JPEG by numpy: RGB out with chroma of half the size each way, and baseline files in.

Huffman tables are made for each image from how often its symbols occur, so none are given here. Reading takes a step of
Python for each coefficient that isn't zero; Pillow, if there, is faster (see png.py).
"""

from __future__ import annotations

import struct

import numpy as np

# The quantisation steps that the standard gives as examples, row by row, for quality 50.
LUMA_STEPS = """
    16 11 10 16 24 40 51 61  12 12 14 19 26 58 60 55  14 13 16 24 40 57 69 56  14 17 22 29 51 87 80 62
    18 22 37 56 68 109 103 77  24 35 55 64 81 104 113 92  49 64 78 87 103 121 120 101  72 92 95 98 112 100 103 99
"""
CHROMA_STEPS = """
    17 18 24 47 99 99 99 99  18 21 26 66 99 99 99 99  24 26 56 99 99 99 99 99  47 66 99 99 99 99 99 99
    99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99
"""
#: Places of a block, row by row, in the order of its diagonals, which go up and down in turn.
ZIGZAG = np.array([8 * y + x for _, _, y, x in sorted((y + x, y if (y + x) % 2 else x, y, x) for y in range(8) for x in range(8))])
_ANGLE = np.outer(np.arange(8), 2 * np.arange(8) + 1) * np.pi / 16
DCT = np.cos(_ANGLE) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), np.sqrt(1 / 4))[:, None]
#: Red, green and blue of Y, Cb and Cr.
_RGB = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def steps(table: str, quality: float) -> np.ndarray:
    """Steps for a quality of 0 to 1."""
    percent = min(max(round(100 * quality), 1), 100)
    scale = 5000 / percent if percent < 50 else 200 - 2 * percent
    return np.clip(np.floor((np.array(table.split(), float) * scale + 50) / 100), 1, 255).astype(np.int64)


def _code_lengths(counts: np.ndarray) -> list[list[int]]:
    """Symbols by code length (1 to 16), no code all ones: a merge of packages, of which each symbol is in as many as
    its code is long."""
    # The symbol that stands last is a stop: it has the longest code, and that is not used.
    symbols = sorted(np.flatnonzero(counts).tolist(), key=lambda s: counts[s])
    leaves = [(0, (-1,)), *((int(counts[s]), (s,)) for s in symbols)]
    packages = leaves
    for _ in range(15):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(packages[::2], packages[1::2], strict=False)]
        packages = sorted(leaves + pairs, key=lambda p: p[0])
    length: dict[int, int] = {}
    for _, members in packages[: 2 * len(leaves) - 2]:
        for s in members:
            length[s] = length.get(s, 0) + 1
    # Longer codes for rarer symbols, and the stop the last of the longest.
    order = sorted(length, key=lambda s: (length[s], s == -1))
    lengths = sorted(length.values())
    by_length: list[list[int]] = [[] for _ in range(17)]
    for s, n in zip([x for x in order if x != -1], lengths, strict=False):
        by_length[n].append(s)
    return by_length


def _codes(by_length: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    codes, lengths, code = np.zeros(256, np.int64), np.zeros(256, np.int64), 0
    for n in range(1, 17):
        for s in by_length[n]:
            codes[s], lengths[s] = code, n
            code += 1
        code <<= 1
    return codes, lengths


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(values).astype(float))[1].astype(np.int64)


def _events(blocks: np.ndarray, place: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is written for quantised blocks (in zigzag order, each component's first value a difference): table (0, 1 for
    first values, 2, 3 for others; by component), symbol, value and its bits, in the order of the file."""
    first = blocks[:, 0]
    found = [(place * 256, component, _bit_lengths(first), first)]
    at, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    before = np.where(np.concatenate(([True], at[1:] != at[:-1])) if len(at) else [], 0, np.concatenate(([0], k[:-1])) if len(k) else [])
    zeros = (k - before - 1).astype(np.int64)
    value = blocks[at, k]
    found.append((place[at] * 256 + 4 * k - 1, 2 + component[at], (zeros % 16) * 16 + _bit_lengths(value), value))
    # Runs of sixteen zeros stand before the value behind them.
    runs = zeros // 16
    owner = np.repeat(np.arange(len(k)), runs)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    found.append((place[at[owner]] * 256 + 4 * k[owner] - 4 + turn, 2 + component[at[owner]], np.full(len(owner), 0xF0), np.zeros(len(owner), np.int64)))
    last = np.zeros(len(blocks), np.int64)
    np.maximum.at(last, at, k)
    short = np.flatnonzero(last < 63)
    found.append((place[short] * 256 + 255, 2 + component[short], np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)))
    key, table, symbol, value = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(key, kind="stable")
    table, symbol, value = table[order], symbol[order], value[order]
    return table, symbol, value, np.where(table < 2, symbol, symbol % 16)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def encode(image: np.ndarray, quality: float = 0.85) -> bytes:
    """A JPEG of an array of height x width x 3 or more bytes."""
    height, width = image.shape[:2]
    padded = np.pad(image[..., :3], ((0, -height % 16), (0, -width % 16), (0, 0)), mode="edge").astype(float)
    rows, columns = padded.shape[0] // 16, padded.shape[1] // 16
    planes = np.einsum("yxc,kc->kyx", padded, _RGB)
    planes[0] -= 128
    half = planes[1:].reshape(2, rows * 8, 2, columns * 8, 2).mean((2, 4))
    # The blocks of each 16 x 16 pixels: four of Y, one of Cb, one of Cr.
    luma = planes[0].reshape(rows, 2, 8, columns, 2, 8).transpose(0, 3, 1, 4, 2, 5).reshape(-1, 4, 8, 8)
    chroma = half.reshape(2, rows, 8, columns, 8).transpose(1, 3, 0, 2, 4).reshape(-1, 2, 8, 8)
    tables = steps(LUMA_STEPS, quality), steps(CHROMA_STEPS, quality)
    quantised = []
    for blocks, table in zip((luma, chroma), tables, strict=True):
        values = np.rint((DCT @ blocks @ DCT.T).reshape(*blocks.shape[:2], 64) / table)[..., ZIGZAG].astype(np.int64)
        quantised.append(np.clip(values, -1023, 1023))
    for values in (quantised[0].reshape(-1, 64), quantised[1][:, 0], quantised[1][:, 1]):
        values[1:, 0] -= values[:-1, 0].copy()
    n = rows * columns
    blocks = np.concatenate((quantised[0], quantised[1]), 1).reshape(-1, 64)
    component = np.tile([0, 0, 0, 0, 1, 1], n)
    table, symbol, value, bits = _events(blocks, np.arange(6 * n), component)
    made = [_code_lengths(np.bincount(symbol[table == t], minlength=256)) for t in range(4)]
    codes, lengths = (np.array(x) for x in zip(*map(_codes, made), strict=True))
    extra = np.where(value < 0, value + (1 << bits) - 1, value)
    word = (codes[table, symbol] << bits) | extra
    size = lengths[table, symbol] + bits
    parts = []
    for at in range(0, len(word), 1 << 18):
        w, s = word[at : at + (1 << 18)], size[at : at + (1 << 18)]
        place = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        parts.append(((np.repeat(w, s) >> (np.repeat(s, s) - 1 - place)) & 1).astype(np.uint8))
    stream = np.concatenate(parts)
    stream = np.packbits(np.concatenate((stream, np.ones(-len(stream) % 8, np.uint8)))).tobytes().replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    head += b"".join(_segment(0xDB, bytes([i]) + t[ZIGZAG].astype(np.uint8).tobytes()) for i, t in enumerate(tables))
    head += _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    for t, by_length in enumerate(made):
        counts = bytes(len(x) for x in by_length[1:])
        head += _segment(0xC4, bytes([t % 2 + 16 * (t // 2)]) + counts + bytes(s for x in by_length for s in x))
    return head + _segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + stream + b"\xff\xd9"


def _restarts(data: bytes) -> list[bytes]:
    """Parts of a scan between restart markers, without stuffing."""
    parts, at, begin = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*parts, data[begin:].replace(b"\xff\x00", b"\xff")]
        if 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            begin = at + 2
        elif data[at + 1] not in (0, 0xFF):
            return [*parts, data[begin:at].replace(b"\xff\x00", b"\xff")]
        at += 2


def decode(data: bytes) -> np.ndarray:
    """height x width x 3 bytes of a baseline JPEG of one or three components; others raise ValueError."""
    at, quant, huffman, restart, frame, adobe = 2, {}, {}, 0, None, None
    while True:
        if data[at] != 0xFF:
            raise ValueError("not a JPEG")
        marker, (length,) = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(float)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, code, symbols, table = body[1:17], 0, 17, {}
                for n in range(1, 17):
                    for _ in range(counts[n - 1]):
                        table[n, code] = body[symbols]
                        code, symbols = code + 1, symbols + 1
                    code <<= 1
                huffman[body[0]] = _lookup(table)
                body = body[symbols:]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            frame = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG is supported: give a renderer over a PDF library")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            break
    if frame is None or len(frame) not in (1, 3):
        raise ValueError("JPEG of other than one or three components is not supported")
    use = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    most_x, most_y = max(f[1] for f in frame), max(f[2] for f in frame)
    columns, rows = -(-width // (8 * most_x)), -(-height // (8 * most_y))
    held = [np.zeros((rows * f[2], columns * f[1], 64)) for f in frame]
    unit = 0
    for part in _restarts(data[at:]):
        reader, before = _Reader(part), [0] * len(frame)
        for _ in range(min(restart or rows * columns, rows * columns - unit)):
            y, x = divmod(unit, columns)
            for c, (name, h, v, _) in enumerate(frame):
                first, others = huffman[use[name] >> 4], huffman[16 + (use[name] & 15)]
                for i in range(h * v):
                    before[c] = reader.block(held[c][y * v + i // h, x * h + i % h], before[c], first, others)
            unit += 1
    planes = []
    for blocks, (_, h, v, q) in zip(held, frame, strict=True):
        values = np.zeros(blocks.shape)
        values[..., ZIGZAG] = blocks * quant[q]
        plane = (DCT.T @ values.reshape(*blocks.shape[:2], 8, 8) @ DCT).transpose(0, 2, 1, 3).reshape(8 * blocks.shape[0], -1) + 128
        planes.append(np.repeat(np.repeat(plane, most_y // v, 0), most_x // h, 1)[:height, :width])
    if len(planes) == 1:
        planes = planes * 3
    elif adobe != 0:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.rint(np.clip(np.stack(planes, -1), 0, 255)).astype(np.uint8)


def _lookup(table: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits."""
    out = [(0, 0)] * (1 << 16)
    for (n, code), symbol in table.items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = [(n, symbol)] * (1 << (16 - n))
    return out


class _Reader:
    """Blocks of a part of a scan, from a window of bits that is filled some bytes at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.window, self.held = data, 0, 0, 0

    def _fill(self) -> None:
        more = self.data[self.at : self.at + 6]
        self.at += 6
        # Behind the end, ones.
        self.window = ((self.window & ((1 << self.held) - 1)) << 48) | int.from_bytes(more.ljust(6, b"\xff"), "big")
        self.held += 48
        if self.at > len(self.data) + 12:
            raise ValueError("the scan ends too early")

    def _symbol(self, table) -> int:
        if self.held < 16:
            self._fill()
        n, symbol = table[(self.window >> (self.held - 16)) & 0xFFFF]
        if not n:
            raise ValueError("the scan has a code that is in no table")
        self.held -= n
        return symbol

    def _value(self, n: int) -> int:
        if not n:
            return 0
        if self.held < n:
            self._fill()
        self.held -= n
        value = (self.window >> self.held) & ((1 << n) - 1)
        return value if value >> (n - 1) else value - (1 << n) + 1

    def block(self, out: np.ndarray, before: int, first, others) -> int:
        """Puts a block's values into out; returns its first one."""
        out[0] = before = before + self._value(self._symbol(first))
        k = 1
        while k < 64:
            symbol = self._symbol(others)
            if symbol == 0:
                break
            k += symbol >> 4
            if symbol & 15:
                out[k] = self._value(symbol & 15)
            k += 1
        return before
