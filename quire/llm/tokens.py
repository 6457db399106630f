"""Token ids of whole texts, written as Simple-8b files in ascending doc_id order and read back.

Rows are dealt by ranges of doc_id (then of a hash of the text and of the partition that a row comes from, so that
rows without an id, or with one, are several ranges), and files follow each other. Each task writes one file
in the shared folder, whose name is its attempt's alone: a task that is run again, or twice at a time, writes
another. A manifest of one row for each file, written as a table, tells where each file's ids start, and, as Spark
commits the rows of one attempt only, which files count. Nothing is renamed, which not all storage can do.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
import zlib
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import filesystem, in_small_batches, rows, scratch, shared_folder
from quire.llm.simple8b import Reader, Writer

END = 0
#: Pieces whose ids a worker remembers, which are ones that it has met in two lookups.
REMEMBERED = 600_000
#: Characters of a piece that is remembered, so that memory is bounded whatever the texts are.
LONGEST = 64
#: Slots, of a byte each, that tell which pieces were met once.
MET = 1 << 22
#: Texts whose pieces are looked up together.
TEXTS = 1024

#: Pieces that are encoded in one text.
TOGETHER = 256
#: How a byte-level vocabulary writes a space.
SPACE = "\u0120"
#: Pieces that end in no white space at either side and are of one line.
_PLAIN = re.compile(r"\S(?:[^\n]*\S)?").fullmatch

_tokenizers: dict[str, PieceIds | WholeIds] = {}


def splits_at_white_space(spec: dict) -> bool:
    """Whether PieceIds' rule holds for a tokenizer (the content of its file): byte-level BPE with the usual pattern."""
    pattern = spec.get("pre_tokenizer") or {}
    return (
        all(spec.get(x) is None for x in ("normalizer", "truncation", "padding"))
        and pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space", True)
        and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        and not any(
            x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") or any(c.isspace() for c in x["content"])
            for x in spec.get("added_tokens", ())
        )
    )


class WholeIds:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        found = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4") for x in texts.to_pylist()]
        return np.concatenate([np.empty(0, "<u4"), *found]), np.array([*map(len, found)], np.int64)


class PieceIds(dict):
    """Ids (as bytes of little-endian 32-bit numbers) of pieces of text that stand behind one white space.

    The tokenizer splits a text in front of a single space, and around a single newline, before it merges bytes:
    so the ids of a text are those of its first piece, then those of each other piece with the space before it.
    It also splits between letters and marks like a comma. A piece that is empty or has white space at an end
    gets None: there the rule doesn't hold.
    """

    #: Marks that are split from the letters before them; all letters under this one are letters to everyone.
    MARKS, LETTERS = ".,;:!?", "\u0250"

    def __init__(self, tokenizer, lead: str = " "):
        super().__init__()
        self.tokenizer, self.lead = tokenizer, lead
        self.met, self.n_met = bytearray(MET), 0
        self.marks = {x: self.whole(x) for x in self.MARKS}
        vocabulary = tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for x, i in vocabulary.items() if x.startswith(SPACE)]] = True
        self.lines = PieceIds(tokenizer, "\n") if lead == " " else self

    def whole(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if "\n" in piece:
            first, *others = piece.split("\n")
            parts = [self[first], *map(self.lines.__getitem__, others)]
            return self.whole(self.lead + piece) if None in parts else b"".join(parts)
        word = piece[:-1]
        if piece[-1] in self.marks and word.isalpha() and (word.isascii() or max(word) < self.LETTERS):
            return self[word] + self.marks[piece[-1]]
        found = self.whole(self.lead + piece)
        self.remember([piece], [found])
        return found

    def remember(self, pieces: list[str], found: list[bytes]) -> None:
        """Keeps the ids of pieces that were met before."""
        if self.n_met >= MET // 2:
            self.met, self.n_met = bytearray(MET), 0
        met, new = self.met, 0
        for piece, ids in zip(pieces, found, strict=True):
            slot = hash(piece) % MET
            if not met[slot]:
                met[slot] = 1
                new += 1
            elif len(self) < REMEMBERED and len(piece) <= LONGEST:
                self[piece] = ids
        self.n_met += new

    def look_up(self, pieces: list[str]) -> list[bytes | None]:
        """self[piece] of different pieces. Those that aren't remembered are encoded many at a time, with a space
        between them: ids that begin with a space tell where one ends."""
        found, marks, plain, places, marked = list(map(self.get, pieces)), self.marks, [], [], []
        for i in [i for i, x in enumerate(found) if x is None]:
            piece = pieces[i]
            if not _PLAIN(piece):
                found[i] = self[piece]
                continue
            mark = marks.get(piece[-1])
            if mark is not None and (word := piece[:-1]).isalpha() and (word.isascii() or max(word) < self.LETTERS):
                marked.append((i, word, mark))
            else:
                places.append(i)
                plain.append(piece)
        new = dict.fromkeys(plain)
        new.update((word, None) for _, word, _ in marked if word not in self)
        words, parts = list(new), []
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = self.whole(" " + " ".join(some))
            starts = (4 * np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")])).tolist()
            if len(starts) == len(some):
                starts.append(len(ids))
                parts += [ids[a:b] for a, b in pairwise(starts)]
            else:
                parts += [self.whole(" " + x) for x in some]
        for i, part in zip(places, parts, strict=False):
            found[i] = part
        if marked:
            new = dict(zip(words, parts, strict=True))
            for i, word, mark in marked:
                found[i] = (self.get(word) or new[word]) + mark
        self.remember(words, parts)
        return found

    def first(self, text: str) -> bytes:
        """Ids of a text's first piece, which has no space before it."""
        return self.whole(text.partition(" ")[0])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has.

        Pieces are split and told apart by Arrow; each different piece is looked up once, and ids are gathered.
        """
        pieces = pc.split_pattern(texts, " ")
        starts = pieces.offsets.to_numpy()[:-1] - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.look_up(known)
        without = [i for i, x in enumerate(found) if x is None]
        none = np.zeros(len(found), bool)
        none[without] = True
        none = none[code]
        # A first piece counts as such: it may only have no white space at its end.
        none[starts] = [not (x := known[c]) or x[-1].isspace() for c in code[starts].tolist()]
        odd = np.logical_or.reduceat(none, starts) if len(starts) else none
        code[starts] = len(known) + np.arange(len(starts))
        for i in without:
            found[i] = b""
        for i, other in enumerate(odd.tolist()):
            found.append(self.whole(texts[i].as_py()) if other else self.first(texts[i].as_py()))
        sizes = np.array([*map(len, found)], np.int64) // 4
        size = sizes[code]
        if odd.any():
            size[np.repeat(odd, np.diff(np.append(starts, len(code)))) & (code < len(known))] = 0
        places = np.cumsum(sizes) - sizes
        take = np.repeat(places[code] - (np.cumsum(size) - size), size)
        take += np.arange(len(take))
        return np.frombuffer(b"".join(found), "<u4")[take], np.add.reduceat(size, starts) if len(starts) else size


def ids_of(path: str) -> PieceIds | WholeIds:
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            by_piece = splits_at_white_space(json.load(file))
        _tokenizers[path] = (PieceIds if by_piece else WholeIds)(Tokenizer.from_file(path))
    return _tokenizers[path]


_MANIFEST = "file string, part int, documents long, ids long, bytes long"


def _write(folder: str, tokenizer: str):
    def write(batches):
        fs, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        coder = ids_of(tokenizer)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.s8b"
        writer, stream = None, None
        end = np.array([END], np.uint32)
        for batch in rows(batches, TEXTS):
            if writer is None:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(f"{root}/{name}")
                writer = Writer(stream)
            ids, lengths = coder.of(pc.fill_null(batch.column(1), ""))
            at = 0
            for doc_id, n in zip(batch.column(0).to_pylist(), lengths.tolist(), strict=True):
                writer.add(doc_id, np.concatenate((ids[at : at + n], end)))
                at += n
        if writer is not None:
            writer.close()
            stream.close()
            sums = [name], [part], [len(writer.lengths)], [writer.total], [writer.offset]
            kinds = pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            columns = [pa.array(v, k) for v, k in zip(sums, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _MANIFEST.split(", ")])

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes docs (doc_id, text) to files in `folder`; returns the manifest with `start`, the ids before a file.

    `folder` is one that Spark and Arrow both reach. Rows go by doc_id, nulls first; rows that repeat a doc_id by a
    hash of their text. Null is the empty text.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, folder)
    filesystem(folder)  # fails here rather than in a task
    text = F.coalesce("text", F.lit(""))
    own = in_small_batches(docs).select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("hash"))
    # Rows that repeat an id and a text are alike, so it doesn't matter which of them is in which range.
    own = own.withColumn("origin", F.spark_partition_id()).repartitionByRange("doc_id", "hash", "origin")
    own = own.sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    own.mapInArrow(_write(folder, tokenizer), _MANIFEST).write.parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file.
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


_DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: Digests that are passed on together.
DIGESTS = 10_000


def _digests(out: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _DIGEST.split(", ")])


def _read(folder: str):
    def read(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as stream:
                    out = []
                    for doc_id, ids in Reader(stream):
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) >= DIGESTS:
                            yield _digests(out)
                            out = []
                    if out:
                        yield _digests(out)

    return read


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""
    # A task for each file: Spark would put so few rows into one.
    folder = shared_folder(manifest.sparkSession, folder)
    files = manifest.select("file", "start").repartition(max(1, manifest.count()))
    return files.mapInArrow(_read(folder), _DIGEST)


def token_digests(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Encodes, writes and reads back; one row for each row of docs (doc_id, text).

    start counts the ids of all documents before it (the end id of each included), ids_crc32 is of the ids as
    little-endian unsigned 32-bit numbers. Null and empty texts have the end id alone. No rows give no files and no
    rows; other columns are not read. Without `folder`, files go to the shared folder and stay till clear().
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_digests(write_tokens(docs, folder, tokenizer), folder)
