"""Near-duplicate documents: MinHash signatures, banding, verification, connected components.

A text's set holds its distinct shingles of five words (lower-case A-Z, words without ASCII white space).
Texts are linked at a Jaccard similarity of 0.85 or more, and linked texts share a component.

1. One pass makes, for each text, a digest of its set and a signature of universal hash minima. Texts with
   equal sets are one class from here on; copies are never paired.
2. Each class falls into one bucket a band. In each bucket, one member (the hub), that of the smallest set, is compared
   with all others: pairs grow with the rows, not with the square of a bucket.
3. Candidates whose signatures agree well enough are confirmed on their full sets. The text of a hub with many
   candidates goes to many tasks.
4. Links are joined to components by alternating large-star and small-star.
5. `TURNS` times, members outside the commonest component of a bucket are compared with another member of that.
6. Members of a bucket that still lie in different components were perhaps never compared. In a bucket of at most
   `FEW` members, they are. For the texts of larger ones the rest is found exactly, by prefixes: with the shingles
   of all sets in one order, the rarest first, two sets of a similarity of 0.85 share one of their first 15 percent,
   early enough to share all that they must from there on. How early a set has a shingle bounds the sizes of its
   partners there; texts meet at a shingle only if each one's size is within the other's bounds. So a large group of
   near copies that share a template, but are no links, costs no pairs either: the words of their own come first.
7. Sets that lack different shingles of one original share all others, and those would meet in great number. So sets
   that have a pivot in common, a text with many links, meet at shingles in which they differ from it: two sets differ
   as far from each other as their differences from the pivot do. Only sets of different pivots meet in whole.

At 0.85, `BANDS` bands of `ROWS` minima miss a pair once in over a million.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WordHashes, discard, fresh, in_small_batches, mixed, rows, settled, shingle_set, stored
from quire.llm.components import connected_components

SHINGLE, BANDS, ROWS = 5, 24, 5
MINIMA = BANDS * ROWS
#: 100 * intersection >= PERCENT * union links two texts.
PERCENT = 85
#: Signatures that agree in fewer minima are dismissed. At 0.85 that is a deviation of over five sigma.
LEAST_EQUAL = 80
#: Counters of a sketch that tells how frequent a shingle is. It only sets the order of shingles, so its size is
#: a matter of speed, and it is all that is broadcast.
SKETCH_BITS = 18
#: How often members outside a bucket's commonest component are compared with one more member of that.
TURNS = 2
#: Members of a bucket that are compared with each other where hubs don't do. More of them go by prefixes.
FEW = 32
#: Candidates of a text that one task compares it with, and texts that one task sets apart from their pivot.
CELL, AROUND = 4096, 256
#: Classes of set sizes between a size and the largest that can be linked to it.
CLASSES = 8

_rng = np.random.Generator(np.random.PCG64(20_11))
_FACTORS = _rng.integers(0, 2**64, MINIMA, np.uint64) | np.uint64(1)
_TERMS = _rng.integers(0, 2**64, MINIMA, np.uint64)
_SEEDS = _rng.integers(0, 2**64, BANDS, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The signature: the least value of each hash x -> (a x + b mod 2^64) >> 32 over the set."""
    least = np.full(MINIMA, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        block = shingles[at : at + 1024, None] * _FACTORS
        block += _TERMS
        np.minimum(least, block.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    key, parts = _SEEDS.copy(), signature.reshape(BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        key = mixed(key ^ parts[:, i])
    return key.view(np.int64)


#: A vertex is a row: the smallest doc_id of its class and, as other rows can have that too, the number of the row.
_ID = "struct<doc_id: long, row: long>"
_SIGNED = "doc_id long, digest long, n_shingles long, k1 long, k2 long, signature array<int>, bands array<long>"


def _sign(batches):
    import xxhash

    hashes = WordHashes()
    for batch in rows(batches):
        out = []
        for doc_id, data, digest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            full = shingle_set(data or b"", hashes, SHINGLE)
            if len(full):
                key = np.frombuffer(xxhash.xxh3_128_digest(full.tobytes()), np.int64)
                signature = minima(full)
                out.append((doc_id, digest, len(full), int(key[0]), int(key[1]), signature.view(np.int32), bands(signature)))
            else:
                out.append((doc_id, digest, 0, None, None, None, None))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())
        names = [x.split()[0] for x in _SIGNED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _confirm(batches):
    """Of rows (a, b, text_a, text_b), sorted by b, the pairs that are linked."""
    hashes, last, of_last = WordHashes(), None, None
    for batch in rows(batches, 64):
        keep = []
        a, b, text_a, text_b = (batch.column(i).to_pylist() for i in range(4))
        for i in range(len(a)):
            if last is None or last != (b[i], text_b[i]):
                last, of_last = (b[i], text_b[i]), shingle_set(text_b[i] or b"", hashes, SHINGLE)
            one = shingle_set(text_a[i] or b"", hashes, SHINGLE)
            if 100 * min(len(one), len(of_last)) >= PERCENT * max(len(one), len(of_last)):
                both = len(np.intersect1d(one, of_last, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(one) + len(of_last) - both))
            else:
                keep.append(False)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["u", "v"])


def _beside(pairs: DataFrame, firsts: DataFrame, others: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of firsts (a and more) and others (b and more). Where pairs have `cells` and
    `cell`, there is a row of others for each cell."""
    joined = pairs.join(firsts, "a")
    if "cell" not in pairs.columns:
        return joined.join(others, "b")
    wanted = pairs.select("b", "cells", "cell").distinct().join(others, "b")
    return joined.join(wanted, ["b", "cells", "cell"])


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Which candidate pairs (a, b) are links (u, v), as a table: signatures first, then full sets."""
    pairs = stored(pairs.distinct(), "pairs")
    dealt, cells = pairs, (1 + F.floor(F.count("*") / CELL)).alias("cells")
    crowded = pairs.groupBy("b").agg(cells).filter("cells > 1")
    if crowded.head(1):
        cell = F.pmod(F.xxhash64("a"), F.col("cells"))
        dealt = pairs.join(crowded, "b", "left").fillna(1, "cells").withColumn("cell", cell)
    side = lambda x: classes.select(F.col("id").alias(x), F.col("signature").alias(f"s_{x}"))
    text = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    equal = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda x: x))
    near = stored(_beside(dealt, side("a"), side("b")).filter(equal >= LEAST_EQUAL).select(dealt.columns), "near")
    full = _beside(near, text("a"), text("b")).select("a", "b", "text_a", "text_b")
    links = stored(full.sortWithinPartitions("b").mapInArrow(_confirm, f"u {_ID}, v {_ID}"), "links")
    discard(pairs, near)
    return links


def _counters(batches):
    """How many texts have shingles of each counter; last, the number of texts."""
    hashes, total = WordHashes(), np.zeros((1 << SKETCH_BITS) + 1, np.int64)
    for batch in rows(batches):
        total[-1] += batch.num_rows
        for data in batch.column(0).to_pylist():
            full = shingle_set(data or b"", hashes, SHINGLE)
            total += np.bincount((full >> np.uint64(64 - SKETCH_BITS)).view(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])


_CUT = f"id {_ID}, n long, apart long, around long, prefix array<long>, differing array<long>"


def _prefixes(sketch):
    """Of rows (id, pivot, text, text of the pivot), sorted by pivot: sizes of the set, of its difference from the
    pivot's and of that one; and the first shingles of set and difference, in one order."""

    def first(shingles, frequent, most):
        return shingles[np.lexsort((shingles, frequent))[:most]].view(np.int64)

    def cut(batches):
        hashes, last, of_last, total = WordHashes(), None, None, sketch.value[-1]
        for batch in rows(batches, 64):
            ids, out = batch.column(0), []
            for pivot, data, other in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if last is None or last != pivot:
                    last, of_last = pivot, shingle_set(other or b"", hashes, SHINGLE)
                full = shingle_set(data or b"", hashes, SHINGLE)
                apart = np.setxor1d(full, of_last, assume_unique=True)
                frequent = sketch.value[full >> np.uint64(64 - SKETCH_BITS)]
                differing = sketch.value[apart >> np.uint64(64 - SKETCH_BITS)]
                # What the pivot has, differs in all texts that lack it.
                differing = np.where(np.isin(apart, of_last, assume_unique=True), total - differing, differing)
                # Sets of n and m >= PERCENT/100 n shingles share PERCENT/100 n at least, so of the first
                # n - ceil(PERCENT/100 n) + 1 one must be among the other's. They differ in (100 - PERCENT)/PERCENT n
                # at most, so of the first of a difference, one more than that.
                least = -(-PERCENT * len(full) // 100)
                most = (100 - PERCENT) * len(full) // PERCENT + 1
                out.append((len(full), len(apart), len(of_last), first(full, frequent, len(full) - least + 1), first(apart, differing, most)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
            arrays = [ids, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "apart", "around", "prefix", "differing"])

    return cut


def _size_class(size) -> Column:
    """Sizes in classes, of which one size and the largest that can be linked to it are CLASSES apart."""
    return F.floor(F.log(size) * F.lit(CLASSES / np.log(100 / PERCENT))).cast("int")


#: Sets of n and m shingles are linked if they differ in OFF (n + m) / (100 + PERCENT) or less.
OFF = 100 - PERCENT


def _bounded(held: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """held with bounds of the sizes of partners: low and high, and most, which the shingle sets; and classes of sizes."""
    size = F.col("size")
    if "apart" not in held.columns:
        # Sets of n and m shingles that are linked share PERCENT (n + m) / (100 + PERCENT) or more, so at the first
        # shingle that both hold, each has as many left: a bound of m, besides the one that similarity sets.
        most = F.floor(F.lit(100 + PERCENT) * (size - F.col("at")) / PERCENT).cast("long") - size
        return held.withColumns({
            "low": F.ceil(F.lit(PERCENT) * size / 100), "high": F.least(F.floor(F.lit(100) * size / PERCENT), most), "most": most,
        }), _size_class
    # Differences of d and e shingles of sets that are linked share half of d + e - OFF (n + m) / (100 + PERCENT) or
    # more. The size is (100 + PERCENT) d - OFF n, so that the sum of two is what they must share. As both d and e, and
    # n and m, are at most OFF n / PERCENT apart, sizes are at most `span` apart.
    most = 2 * (100 + PERCENT) * (F.col("apart") - F.col("at")) - size
    span = F.ceil(F.lit((100 + PERCENT + OFF) * OFF) * F.col("n") / PERCENT)
    width = F.col("around") * ((100 + PERCENT + OFF) * OFF / PERCENT / CLASSES)
    bounds = {"low": size - span, "high": F.least(size + span, most), "most": most}
    return held.withColumns(bounds), lambda x: F.floor(x / width).cast("int")


def _meeting(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, label, size, at, shingle and more) as the smaller and as the larger one of a pair, by the keys at which
    pairs meet: shingle, small and large (classes of both sizes), minor_small and minor_large (whether each is of another
    component than most texts that have the shingle)."""
    bounded, class_of = _bounded(held)
    bounded, size = bounded.filter("low <= high"), F.col("size")
    by_label = bounded.groupBy("shingle", "label").agg(F.count("*").alias("n"), F.min("size").alias("s"), F.max("size").alias("t"))
    ranked = by_label.withColumn("i", F.row_number().over(Window.partitionBy("shingle").orderBy(F.desc("n"), F.desc("label"))))
    rest = lambda x: F.when(F.col("i") > 1, F.col(x))
    shared = ranked.groupBy("shingle").agg(
        F.max(F.when(F.col("i") == 1, F.col("label"))).alias("commonest"), F.min("s").alias("least"), F.max("t").alias("largest"),
        F.min(rest("s")).alias("least_minor"), F.max(rest("t")).alias("largest_minor"), F.count("*").alias("labels"),
    ).filter("labels > 1")
    minor = F.col("label") != F.col("commonest")
    met = bounded.join(shared, "shingle").withColumn("minor", minor).filter(
        "low <= IF(minor, largest, largest_minor) AND high >= IF(minor, least, least_minor)"
    ).select(*bounded.columns, "minor")
    row = F.struct(*(x for x in bounded.columns if x in ("id", "label", "component", "n", "size", "most")))
    own, classes = class_of(size), lambda a, b: F.explode(F.sequence(class_of(F.col(a)), class_of(F.col(b))))
    # Rows of the commonest component at a shingle meet others only; what others meet of their own is less than half
    # of what they must.
    small = met.filter("size <= high").select("shingle", "minor", own.alias("small"), classes("size", "high").alias("large"), row.alias("a"))
    below = met.withColumn("below", F.least("size", "most")).filter("low <= below")
    large = below.select("shingle", "minor", classes("low", "below").alias("small"), own.alias("large"), row.alias("b"))
    other = F.explode(F.when(F.col("minor"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True))))
    return (
        small.withColumn("minor_large", other).withColumnRenamed("minor", "minor_small"),
        large.withColumn("minor_small", other).withColumnRenamed("minor", "minor_large"),
    )


#: What _meeting's rows meet by.
_KEY = ["shingle", "small", "large", "minor_small", "minor_large"]


def _met(held: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (id, component, n, label, size, at, shingle) that can be linked, of different labels."""
    small, large = _meeting(held)
    near = (
        "a.label <> b.label AND a.component <> b.component AND (a.size < b.size OR a.size = b.size AND a.id < b.id)"
        f" AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) AND b.size <= a.most AND a.size <= b.most"
    )
    return small.join(large, _KEY).filter(near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _pivots(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, pivot, n): for each member of a bucket (band, id, size), one that has many links and at most twice or half its
    size; of those of its buckets, the one that most texts, n, meet; itself if there is none."""
    ends = links.select(F.col("u").alias("id")).union(links.select("v"))
    counted = members.join(ends.groupBy("id").agg(F.count("*").alias("links")), "id", "left").fillna(0, "links")
    first = counted.groupBy("band").agg(F.max(F.struct("links", "id", "size")).alias("x"))
    met = members.join(first, "band").filter("2 * least(size, x.size) >= greatest(size, x.size)").select("id", F.col("x.id").alias("pivot"))
    met = met.distinct()
    ranked = met.join(met.groupBy("pivot").agg(F.count("*").alias("n")), "pivot")
    found = ranked.groupBy("id").agg(F.max(F.struct("n", "pivot")).alias("x"))
    every = members.select("id").distinct().join(found, "id", "left")
    return every.select("id", F.coalesce("x.pivot", "id").alias("pivot"), F.coalesce("x.n", F.lit(1)).alias("n"))


def _rest(members: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of different components that can still be linked. members: (band, id, size, label) of buckets;
    links: those that are known."""
    spark = texts.sparkSession
    open_ = members.select("id", "label").distinct()
    pivots = stored(_pivots(members, links).join(open_, "id").withColumnRenamed("label", "component"), "pivots")
    own = texts.join(pivots.select("id"), "id", "left_semi")
    counted = own.select("text").mapInArrow(_counters, "counter long, n long").groupBy("counter").agg(F.sum("n"))
    sketch = np.zeros((1 << SKETCH_BITS) + 1, np.int64)
    counters, totals = (x.to_numpy() for x in counted.toArrow().columns)
    sketch[counters] = totals
    text = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    dealt = pivots.select(F.col("id").alias("a"), F.col("pivot").alias("b"), (1 + F.floor(F.col("n") / AROUND)).alias("cells"))
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("a"), F.col("cells")))
    both = _beside(dealt, text("a"), text("b")).select("a", "b", "text_a", "text_b").sortWithinPartitions("b")
    cut = both.mapInArrow(_prefixes(spark.sparkContext.broadcast(sketch)), _CUT)
    cut = stored(cut.join(pivots.drop("n"), "id"), "prefixes")
    # Sets of one pivot whose differences from it need share nothing are both linked with it.
    of_pivot = pivots.select(F.col("id").alias("pivot"), F.col("component").alias("other"))
    to_pivot = cut.filter(f"{100 + PERCENT} * apart <= {OFF} * (n + around)").join(of_pivot, "pivot").filter("component <> other")
    held = cut.select(
        "id", "component", "n", F.col("component").alias("label"), "apart", "around",
        (F.lit(100 + PERCENT) * F.col("apart") - F.lit(OFF) * F.col("n")).alias("size"), "pivot",
        F.posexplode("differing").alias("at", "shingle"),
    ).withColumn("shingle", F.xxhash64("pivot", "shingle")).drop("pivot")
    whole = cut.select(
        "id", "component", "n", F.col("pivot").alias("label"), F.col("n").alias("size"), F.posexplode("prefix").alias("at", "shingle")
    )
    # One after the other, as the driver holds all stages of a query at once.
    found = stored(to_pivot.select(F.col("id").alias("a"), F.col("pivot").alias("b")), "to_pivot")
    return found.union(stored(_met(held), "held")).union(stored(_met(whole), "whole"))


def _within(labelled: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of different components in buckets of at most FEW members: (band, id, size, label)."""
    groups = labelled.groupBy("band").agg(F.collect_list(F.struct("id", "label", "size")).alias("m"))
    others = lambda x: F.filter("m", lambda y: (
        (y["id"] < x["id"]) & (y["label"] != x["label"])
        & (100 * F.least(x["size"], y["size"]) >= PERCENT * F.greatest(x["size"], y["size"]))
    ))
    of_one = lambda x: F.transform(others(x), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))
    return groups.select(F.explode(F.flatten(F.transform("m", of_one))).alias("p")).select("p.a", "p.b")


_FITS = f"hub.id <> id AND 100 * least(size, hub.size) >= {PERCENT} * greatest(size, hub.size)"


def _outside(labelled: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): in each bucket, members outside its commonest component with one member of that."""
    order = F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "size", "id")
    by_label = labelled.groupBy("band", "label").agg(F.count("*").alias("n"), F.min(order).alias("hub"))
    first = F.struct("n", F.xxhash64(F.lit(turn), "label").alias("h"), "label", "hub")
    apart = by_label.groupBy("band").agg(F.max(first).alias("x"), F.count("*").alias("labels"))
    apart = apart.filter("labels > 1").select("band", F.col("x.label").alias("most"), F.col("x.hub").alias("hub"))
    return labelled.join(apart, "band").filter(f"label <> most AND {_FITS}").select(F.col("id").alias("a"), F.col("hub.id").alias("b"))


def _relabelled(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """labelled, with each component under the label of the largest one that a link leads to, if that is larger, or of
    what that one is led to. Longer chains are left to the end: texts of one label are in one component, but not the
    other way round."""
    ends = labelled.select("id", "label").distinct()
    sizes = ends.groupBy("label").agg(F.count("*").alias("n"))
    ranked = ends.join(sizes, "label").select("id", F.struct("n", F.xxhash64("label").alias("h"), "label").alias("rank"))
    of = lambda x: ranked.select(F.col("id").alias(x), F.col("rank").alias(f"rank_{x}"))
    both = links.join(of("u"), "u").join(of("v"), "v").filter("rank_u <> rank_v")
    smaller, larger = F.least("rank_u", "rank_v")["label"], F.greatest("rank_u", "rank_v")
    led = both.groupBy(smaller.alias("label")).agg(F.max(larger)["label"].alias("to"))
    led = stored(led, "led")
    on = led.select(F.col("label").alias("to"), F.col("to").alias("then"))
    led = led.join(on, "to", "left").select("label", F.coalesce("then", "to").alias("to"))
    return labelled.join(led, "label", "left").withColumn("label", F.coalesce("to", "label")).select("band", "id", "size", "label")


def _settle(members: DataFrame, hubs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, component) by all links among members of equal buckets. members: (band, id, size); hubs: (band, hub)."""
    met = members.join(hubs, "band").filter(_FITS)
    linked = _links(met.select(F.col("id").alias("a"), F.col("hub.id").alias("b")), classes, texts)
    found = connected_components(linked)
    labels = found.select(F.col("u").alias("id"), F.col("component").alias("label"))
    labelled = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).select("band", "id", "size", "label")
    labelled, known = stored(labelled, "labelled"), found.select("u", F.col("component").alias("v"))
    for turn in range(TURNS):
        links = _links(_outside(labelled, turn), classes, texts)
        before, labelled = labelled, stored(_relabelled(labelled, links), "labelled")
        discard(before)
        known, linked = known.union(links), linked.union(links)
    apart = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"))
    apart = stored(apart.filter("x <> y").select("band", (F.col("n") <= FEW).alias("few")), "apart")
    few = labelled.join(apart.filter("few"), "band", "left_semi")
    open_ = stored(labelled.join(apart.filter("NOT few"), "band", "left_semi"), "open")
    pairs = _within(few)
    if open_.head(1):
        pairs = pairs.union(_rest(open_, linked, texts))
    return connected_components(_links(pairs, classes, texts).union(known))


def _digest(text) -> Column:
    return F.xxhash64(text.cast("binary"))


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, n_shingles, component_id and kept for each row of docs."""
    text = F.col("text")
    docs = in_small_batches(docs.select(F.col("doc_id").cast("long"), text.cast("binary"), _digest(text).alias("digest")))
    signed = stored(docs.mapInArrow(_sign, _SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    known = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # Equal sets have equal signatures; any row's will do.
    every = stored(
        known.groupBy("k1", "k2").agg(
            F.min(F.struct("doc_id", "row", "digest")).alias("least"),
            *(F.first(x).alias(x) for x in ("n_shingles", "signature", "bands")),
        ).withColumns({"id": F.struct("least.doc_id", "least.row"), "digest": F.col("least.digest")}).drop("least"),
        "every",
    )
    class_ids = every.select("k1", "k2", "id")

    def components():
        held = every.select("id", F.col("n_shingles").alias("size"), F.explode("bands").alias("band"))
        hubs = held.groupBy("band").agg(F.min(F.struct("size", "id")).alias("hub"), F.count("*").alias("n"))
        hubs = stored(hubs.filter("n > 1").select("band", "hub"), "hubs")
        members = stored(held.join(hubs, "band", "left_semi"), "members")
        wanted = members.select("id").distinct()
        classes = stored(every.join(wanted, "id", "left_semi").select("id", "digest", "signature"), "classes")
        # Of rows that repeat a doc_id and its text, one.
        own = docs.join(classes.select("id", "id.doc_id", "digest"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
        texts = stored(own.select("id", "text"), "texts")
        return _settle(members, hubs, classes, texts)

    found = settled(docs.sparkSession, components, "found")
    component = class_ids.join(found.withColumnRenamed("u", "id"), "id", "left").select(
        "k1", "k2", F.coalesce("component", "id").alias("component")
    )
    out = signed.select("doc_id", "digest", "row", "n_shingles", "k1", "k2").join(component, ["k1", "k2"], "left")
    named = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        "digest",
        "n_shingles",
        F.when(named, F.coalesce("component.doc_id", "doc_id")).alias("component_id"),
        (~named | F.coalesce(F.col("row") == F.col("component.row"), F.lit(True))).alias("kept"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links reach; of its rows, one is kept. Null and empty texts have no
    shingles and are linked with nothing. Equal sets are linked, repeated rows too; rows that repeat a doc_id with
    another text are texts of their own. A row without doc_id takes no part in linking: its component_id is null
    and it is kept. No rows give no rows; other columns are not read.
    """
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each component: one of the smallest doc_id.

    Rows that repeat a doc_id with another text are judged on their own. Rows without doc_id stay, and null and
    empty texts.
    """
    key = fresh(docs, "doc_id", "digest")
    judged = _judged(docs).withColumnsRenamed({"doc_id": key[0], "digest": key[1]})
    gone = judged.filter(~F.col("kept")).select(key).distinct()
    keyed = docs.withColumns({key[0]: F.col("doc_id").cast("long"), key[1]: _digest(F.col("text"))})
    left = keyed.join(gone, key, "left_anti")
    # Where the row that is kept has copies with its doc_id, one of them stays.
    once = stored(judged.filter("kept AND n_shingles > 0").select(key).join(gone, key, "left_semi"), "once")
    if once.head(1):
        left = left.union(keyed.join(once, key, "left_semi").dropDuplicates(key))
    return left.drop(*key)
