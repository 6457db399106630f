"""Benchmark decontamination.

The windows of 13 words of the benchmark's items (an item of fewer words is one window) are broadcast as a set of
hashes, with the numbers of their words. All token windows of all texts are rolled past it, many texts at a time; a hit
is verified on its words.

What is broadcast is bounded: a benchmark of more than `BLOCK_CHARS` characters is cut into pieces, which share
their last words so that no window is lost, and dealt by their running length into blocks of at most that and one
piece more. Each block passes over the texts and is then let go, and hits of a text are merged. One block is the
usual case.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import ALNUM_WORD, alnum_words, fresh, in_small_batches, rows, stored

WINDOW = 13
#: Characters of benchmark text that one broadcast holds, and windows of a piece, one of which it may hold besides.
BLOCK_CHARS, PIECE_WINDOWS = 4_000_000, 4096
#: A text is contaminated if one in so many words is hit.
SHARE = 20


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out += b
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def rolled(numbers: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word numbers. Runs of 1, 2, 4 and so on are joined."""
    count = len(numbers) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out, done, run, size = None, 0, numbers.astype(np.uint64), 1
    while size <= n:
        if n & size:
            part = run[done : done + count]
            out = part if out is None else _join(out, part)
            done += size
        run = _join(run[:-size], run[size:]) if 2 * size <= n else run
        size *= 2
    return out * np.uint64(0xD6E8FEB86659FD93)


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size says."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Set(NamedTuple):
    """The different windows of n words, in the order of their hashes, and the items of each."""

    hashes: np.ndarray
    #: Where the first 20 bits of some hash are.
    bits: np.ndarray
    #: Where a window's words stand in Windows.numbers.
    place: np.ndarray
    #: The items of window i are owners[first[i] : first[i + 1]], numbers of Windows.items.
    first: np.ndarray
    owners: np.ndarray


class Found(NamedTuple):
    """Of several texts: words, disjoint hit spans (start and end, counted from the text's first word) with where each
    text's begin, and the items."""

    n_words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    items: list[list[str]]

    def n_hit(self) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(self.ends - self.starts)))[self.offsets]
        return upto[1:] - upto[:-1]


class Windows:
    """The windows of a block of items: hashes to find them by, and their words, as numbers, to verify what is found.
    A window takes some 25 bytes, besides the vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.words: dict[bytes, int] = {}
        self.items = sorted({item_id for item_id, _ in items})
        owner, texts, by_size, at = {x: i for i, x in enumerate(self.items)}, [], {}, 0
        for item_id, data in items:
            numbers = [self.words.setdefault(w, len(self.words) + 1) for words in alnum_words(data) for w in words]
            if numbers:
                texts.append(np.array(numbers, np.uint32))
                by_size.setdefault(min(size, len(numbers)), []).append((at, len(numbers), owner[item_id]))
                at += len(numbers)
        self.numbers = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        self.sets = {n: self._set(n, np.array(runs)) for n, runs in by_size.items()}

    def _set(self, n: int, runs: np.ndarray) -> Set:
        """runs: start, words and owner of each text."""
        counts = runs[:, 1] - n + 1
        place = _expanded(runs[:, 0], counts).astype(np.uint32)
        owners = np.repeat(runs[:, 2], counts).astype(np.uint32)
        hashes = rolled(self.numbers, n)[place]
        order = np.lexsort((owners, hashes))
        hashes, place, owners = hashes[order], place[order], owners[order]
        alike = np.concatenate(([False], (hashes[1:] == hashes[:-1])))
        at = np.flatnonzero(alike)
        alike[at] = self._same(place[at], self.numbers, place[at - 1], n)
        # Neighbours of one item say nothing more.
        again = alike.copy()
        again[at] &= owners[at] == owners[at - 1]
        hashes, place, owners, alike = (x[~again] for x in (hashes, place, owners, alike))
        first = np.flatnonzero(~alike)
        bits = np.zeros(1 << 20, bool)
        bits[hashes >> np.uint64(44)] = True
        return Set(hashes[first], bits, place[first], np.append(first, len(owners)).astype(np.uint32), owners)

    def _same(self, place: np.ndarray, others: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words at each place are those of `others` at its place there."""
        out = np.ones(len(place), bool)
        for j in range(n):
            out &= self.numbers[place + j] == others[at + j]
        return out

    def scan(self, texts: list[bytes | None]) -> Found:
        chunks = [[np.fromiter(map(self.words.get, w, repeat(0)), np.uint32, len(w)) for w in alnum_words(x or b"")] for x in texts]
        n_words = np.array([sum(map(len, x)) for x in chunks], np.int64)
        numbers = np.concatenate([y for x in chunks for y in x]) if chunks else np.empty(0, np.uint32)
        ends = np.cumsum(n_words)
        change = np.zeros(len(numbers) + 1, np.int32)
        found: list[set[int]] = [set() for _ in texts]
        for n, own in self.sets.items():
            h = rolled(numbers, n)
            at = np.flatnonzero(own.bits[h >> np.uint64(44)])
            h = h[at]
            low, high = np.searchsorted(own.hashes, h, "left"), np.searchsorted(own.hashes, h, "right")
            window, at = _expanded(low, high - low), np.repeat(at, high - low)
            # A window lies in one text.
            text = np.searchsorted(ends, at, "right")
            whole = at + n <= ends[text]
            window, at, text = window[whole], at[whole], text[whole]
            right = self._same(own.place[window], numbers, at, n)
            window, at, text = window[right], at[right], text[right]
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            for t, w in np.unique(np.stack((text, window), 1), axis=0).tolist():
                found[t].update(own.owners[own.first[w] : own.first[w + 1]].tolist())
        hit = np.cumsum(change[:-1]) > 0
        breaks = np.zeros(len(numbers) + 1, bool)
        breaks[np.concatenate(([0], ends))] = True
        starts = np.flatnonzero(hit & (breaks[:-1] | ~np.concatenate(([False], hit[:-1]))))
        stops = np.flatnonzero(hit & (breaks[1:] | ~np.concatenate((hit[1:], [False])))) + 1
        text = np.searchsorted(ends, starts, "right")
        offsets = np.searchsorted(text, np.arange(len(texts) + 1))
        base = (ends - n_words)[text]
        items = [[self.items[i] for i in sorted(x)] for x in found]
        return Found(n_words, starts - base, stops - base, offsets, items)


_SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])
_SPANS = "array<struct<s:int,e:int>>"
_FOUND = f"doc_id long, version long, n_words long, spans {_SPANS}, items array<string>"


def _spans(found: Found) -> pa.Array:
    both = pa.StructArray.from_arrays([pa.array(found.starts, pa.int32()), pa.array(found.ends, pa.int32())], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(found.offsets, pa.int32()), both)


def _scanner(windows):
    def scan(batches):
        for batch in rows(batches):
            found = windows.value.scan(batch.column(2).to_pylist())
            columns = [pa.array(found.n_words), _spans(found), pa.array(found.items, pa.list_(pa.string()))]
            names = ["doc_id", "version", "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names)

    return scan


def _cut(window: int):
    def cut(batches):
        for batch in rows(batches):
            ids, texts = [], []
            for item_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for chunk in alnum_words(data) for w in chunk]
                for at in range(0, max(1, len(words) - window + 1), PIECE_WINDOWS):
                    ids.append(item_id)
                    texts.append(b" ".join(words[at : at + PIECE_WINDOWS + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["item_id", "text"])

    return cut


def _dealt(items: DataFrame, window: int, block_chars: int) -> DataFrame:
    """Pieces of items (item_id, text) with the block of each, counted from 0."""
    binary = in_small_batches(items).select("item_id", F.col("text").cast("binary"))
    pieces = binary.mapInArrow(_cut(window), "item_id string, text string").withColumn("key", F.xxhash64("item_id", "text"))
    pieces = stored(pieces, "pieces")
    # One narrow row for each piece, that is for each few thousand words of the benchmark.
    chars = pieces.groupBy("key").agg(F.sum(F.length("text") + 1).alias("chars"))
    before = F.coalesce(F.sum("chars").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = F.floor(before / block_chars)
    return stored(pieces.join(chars.select("key", block.alias("block")), "key").drop("key"), "dealt")


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> list[Callable[[], Broadcast]]:
    """What broadcasts the benchmark's windows, block by block."""
    items = benchmark.select(F.col("item_id").cast("string"), "text").filter("text IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = [items]
    if chars > block_chars:
        dealt = _dealt(items, window, block_chars)
        blocks = dealt.select("block").distinct().orderBy("block").collect()
        parts = [dealt.filter(F.col("block") == x).select("item_id", "text") for (x,) in blocks]
    in_small_batches(docs)

    def sent(part):
        own = sorted(part.collect(), key=lambda x: (x[0] or "", x[1]))
        return docs.sparkSession.sparkContext.broadcast(Windows([(x[0] or "", x[1].encode()) for x in own], window))

    return [lambda part=part: sent(part) for part in parts]


def _map_texts(docs: DataFrame, windows: Broadcast, out, schema) -> DataFrame:
    """out(batch, Found) of each batch of docs."""
    text = docs.columns.index("text")

    def scan(batches):
        for batch in rows(batches):
            yield out(batch, windows.value.scan(batch.column(text).cast(pa.binary()).to_pylist()))

    return docs.mapInArrow(scan, schema)


def _keep_clean(batch: pa.RecordBatch, found: Found) -> pa.RecordBatch:
    hit = found.n_hit()
    return batch.filter(pa.array((hit == 0) | (SHARE * hit < found.n_words)))


def _with_spans(name: str):
    return lambda batch, found: pa.RecordBatch.from_arrays([*batch.columns, _spans(found)], [*batch.schema.names, name])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs: doc_id, version, n_words, spans (hit words from s to before e), items."""
    return _hits(docs, _blocks(docs, benchmark, window, block_chars))


def _hits(docs: DataFrame, blocks: list[Callable[[], Broadcast]]) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), F.col("text").cast("binary"))
    scanned = lambda x: texts.mapInArrow(_scanner(x), _FOUND)
    if len(blocks) == 1:
        return scanned(blocks[0]())
    # One block is in memory at a time. The first pass has a row for each text, the others for texts that are hit, of
    # rows that repeat a doc_id and a text one.
    passes = []
    for block in blocks:
        windows = block()
        of_block = scanned(windows)
        if passes:
            of_block = of_block.filter(F.size("spans") > 0).dropDuplicates(["doc_id", "version"])
        passes.append(stored(of_block, "hits"))
        windows.destroy()
    every, *others = passes
    more = reduce(DataFrame.unionByName, others).groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(
        F.flatten(F.collect_list("spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i")
    )
    both = every.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    none = F.array()
    return both.select(
        "doc_id", "version", "n_words",
        F.concat("spans", F.coalesce("s", none.cast(_SPANS))).alias("spans"),
        F.array_union("items", F.coalesce("i", none.cast("array<string>"))).alias("items"),
    )


def _covered(spans: Column) -> Column:
    """Words in a union of spans."""
    return F.aggregate(
        F.sort_array(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["e"]).alias("end"),
            (a["n"] + F.greatest(x["e"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, spans.

    benchmark has item_id and text. A word is hit inside any occurrence of a window; contaminated is n_hit > 0
    and 20 * n_hit >= n_words. Null and empty texts have no words; null and empty items no windows; an empty
    benchmark hits nothing. Repeated rows each get their row, rows without doc_id too; no rows give no rows; other
    columns are not read.
    """
    return _contamination(docs, _blocks(docs, benchmark, window, block_chars))


def _contamination(docs: DataFrame, blocks: list[Callable[[], Broadcast]]) -> DataFrame:
    found = _hits(docs.select("doc_id", "text"), blocks).withColumn("n_hit", _covered(F.col("spans")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "version",
        "spans",
    )


def _without(text: Column, spans: Column) -> Column:
    """The text without the words of the spans, and without what stood between them."""
    pieces = F.regexp_extract_all(text, F.lit(f"{ALNUM_WORD_ANY}|{NOT_WORD_ANY}"), F.lit(0))
    leads = F.regexp_like(text, F.lit(f"^{NOT_WORD_ANY}")).cast("int")
    hit = lambda i: F.exists(spans, lambda x: (2 * x["s"] + leads <= i) & (i < 2 * x["e"] + leads))
    return F.array_join(F.filter(pieces, lambda _, i: ~hit(i)), "")


#: As ALNUM_WORD, in either case; and what separates such words.
ALNUM_WORD_ANY = ALNUM_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
NOT_WORD_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """docs, with all their columns, without contaminated rows, or (remove="spans") with all rows and without hit
    words.

    Rows are judged where they are scanned if one block holds the benchmark; else rows with hits are joined back. A
    null text stays null, an empty one empty; neither is contaminated. Repeated rows have one verdict, rows without
    doc_id have theirs; no rows give no rows, and an empty benchmark takes nothing.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    blocks = _blocks(docs, benchmark, window, block_chars)
    spans, doc_id, version = fresh(docs, "spans", "doc_id", "version")
    if len(blocks) == 1 and remove == "documents":
        return _map_texts(docs, blocks[0](), _keep_clean, docs.schema)
    if len(blocks) == 1:
        schema = docs.select("*", F.array().cast(_SPANS).alias(spans)).schema
        joined = _map_texts(docs, blocks[0](), _with_spans(spans), schema)
    else:
        found = _contamination(docs, blocks).filter("contaminated" if remove == "documents" else "n_hit > 0")
        keys = found.select(F.col("doc_id").alias(doc_id), F.col("version").alias(version), F.col("spans").alias(spans))
        # Rows with one doc_id and text share their verdict.
        keys = keys.dropDuplicates([doc_id, version])
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(version))
        if remove == "documents":
            return docs.join(keys, same, "left_anti")
        joined = docs.join(keys, same, "left")
    hit = F.coalesce(F.size(spans) > 0, F.lit(False))
    return joined.withColumn("text", F.when(hit, _without(F.col("text"), F.col(spans))).otherwise(F.col("text"))).select(*docs.columns)
