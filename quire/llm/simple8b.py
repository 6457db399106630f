"""Simple-8b word-aligned coding of unsigned integers, and the file format of token ids.

A 64-bit word holds a selector in its upper four bits and, in the other 60, as many equally wide numbers as the
selector says. Selector 0 is the escape: the next word is one number of more than 60 bits as it stands.

A file: the magic, blocks, the directory, its length (8 bytes, little-endian), the magic. A block is whole words
of up to `BLOCK` numbers. The directory is JSON of the number of values, blocks (byte offset, words, values
before it) and the column of documents (id, values), so a reader finds any document's blocks by bisection and
decodes them with whole-array operations.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right

import numpy as np

MAGIC = b"QS8B\x01\0\0\0"
BLOCK = 1 << 16
# Numbers a word and bits a number, by selector; 0 is the escape.
SELECTORS = (
    (1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)


def encode(values: np.ndarray) -> np.ndarray:
    """Words for values, each filled with as many as fit. The last word may stand for fewer than its selector says."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    # For each place, the selector that a word starting there would have: the one that holds most numbers. The
    # widest of the next c numbers comes from those of fewer by one comparison. Zeros fill the last word up.
    width = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    if width.max() > 53:  # where floats round
        high = values >> np.uint64(32)
        width = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, width).astype(np.uint8)
    longest = SELECTORS[1][0]
    widest = {1: np.concatenate((width, np.zeros(longest, np.uint8)))}
    chosen, count = np.zeros(n, np.int8), 1
    for s in range(len(SELECTORS) - 1, 0, -1):
        wanted, bits = SELECTORS[s]
        while count < wanted:
            more = min(2 * count, wanted)
            widest[more] = np.maximum(widest[count][: n + longest - more + 1], widest[count][more - count :][: n + longest - more + 1])
            count = more
        np.copyto(chosen, s, where=widest[count][:n] <= bits)
    steps, counts, starts, i = chosen.tobytes(), [c for c, _ in SELECTORS], [], 0
    while i < n:
        starts.append(i)
        i += counts[steps[i]]
    at = np.array(starts)
    selectors = chosen[at].astype(np.int64)
    escapes = selectors == 0
    where = np.arange(len(at)) + np.concatenate(([0], np.cumsum(escapes)[:-1]))
    out = np.zeros(len(at) + int(escapes.sum()), np.uint64)
    out[where] = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((values, np.zeros(120, np.uint64)))
    for s in np.unique(selectors).tolist():
        own, (count, bits) = selectors == s, SELECTORS[s]
        if s == 0:
            out[where[own] + 1] = values[at[own]]
        elif bits:
            word = out[where[own]]
            for j in range(count):
                word |= padded[at[own] + j] << np.uint64(j * bits)
            out[where[own]] = word
    return out


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of words."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    if (selectors == 0).any():
        # Words after an escape are no words with a selector.
        raw, listed, skip = np.zeros(len(words), bool), selectors.tolist(), False
        for i in range(len(listed)):
            raw[i] = skip
            skip = not skip and listed[i] == 0
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(words))
    selectors = selectors[heads]
    counts = np.array([c for c, _ in SELECTORS])[selectors]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selectors).tolist():
        own, (count, bits) = np.flatnonzero(selectors == s), SELECTORS[s]
        first = (ends - counts)[own]
        if s == 0:
            out[first] = words[heads[own] + 1]
        elif bits:
            held, mask = words[heads[own]], np.uint64((1 << bits) - 1)
            for j in range(count):
                out[first + j] = (held >> np.uint64(j * bits)) & mask
    return out[:n]


class Writer:
    """Writes documents of ids to a binary file, a block at a time."""

    def __init__(self, file):
        self.file, self.offset, self.total = file, len(MAGIC), 0
        self.blocks, self.doc_ids, self.lengths = [], [], []
        self.waiting, self.held = [], 0
        file.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.waiting)
        for at in range(0, len(ids), BLOCK):
            block = ids[at : at + BLOCK]
            if len(block) < least:
                self.waiting, self.held = [block], len(block)
                return
            words = encode(block)
            self.blocks.append([self.offset, len(words), self.total])
            self.file.write(words.astype("<u8").tobytes())
            self.offset += 8 * len(words)
            self.total += len(block)
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush(0)
        directory = {"values": self.total, "blocks": self.blocks, "doc_ids": self.doc_ids, "lengths": self.lengths}
        data = zlib.compress(json.dumps(directory).encode(), 1)
        self.file.write(data + struct.pack("<Q", len(data)) + MAGIC)
        self.offset += len(data) + 8 + len(MAGIC)


class Reader:
    """Reads a file of Writer through anything with seek() and read()."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2) or file.tell()
        file.seek(end - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole file of token ids")
        (length,) = struct.unpack("<Q", tail[:8])
        file.seek(end - 16 - length)
        directory = json.loads(zlib.decompress(file.read(length)))
        self.total, self.blocks = directory["values"], directory["blocks"]
        self.doc_ids, self.lengths = directory["doc_ids"], directory["lengths"]

    def block(self, i: int) -> np.ndarray:
        offset, words, before = self.blocks[i]
        after = self.blocks[i + 1][2] if i + 1 < len(self.blocks) else self.total
        self.file.seek(offset)
        return decode(np.frombuffer(self.file.read(8 * words), "<u8"), after - before).astype(np.uint32)

    def span(self, start: int, n: int) -> np.ndarray:
        """n values from the start-th on, from only the blocks that hold them."""
        if not n:
            return np.empty(0, np.uint32)
        first = bisect_right(self.blocks, start, key=lambda b: b[2]) - 1
        last = bisect_right(self.blocks, start + n - 1, key=lambda b: b[2]) - 1
        ids = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return ids[start - self.blocks[first][2] :][:n]

    def __iter__(self):
        """(doc_id, ids) of each document in order; each block is decoded once."""
        rest, block = np.empty(0, np.uint32), 0
        for doc_id, n in zip(self.doc_ids, self.lengths, strict=True):
            parts, held = [rest], len(rest)
            while held < n:
                parts.append(self.block(block))
                held += len(parts[-1])
                block += 1
            ids = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, ids[:n]
            rest = ids[n:]
