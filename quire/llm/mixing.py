"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id. A source's budget is met by the documents whose hash lies below a
threshold. To find it, the words of each source are summed by hash bucket; the bucket in which the running sum
passes the budget is the only one to be summed again, by finer buckets, until one hash is left. Thresholds of
growing budgets are nested, nothing is sorted, and all that meets in one place is one histogram of `BUCKETS`
sums for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE_WORD, fresh, settled, stored

HASH_BITS, LEVEL_BITS = 60, 12
BUCKETS = 1 << LEVEL_BITS
#: Most copies of a document.
MOST = 3
WEIGHTS = 3
#: Characters by which sources are dealt out to be ranked.
FLAT, DEEP = 2, 8


def _hash() -> Column:
    """60 bits of a hash of the id; of the text where there is no id."""
    key = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))).otherwise(
        F.md5(F.col("doc_id").cast("string"))
    )
    return F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), h (the hash that decides)."""
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _hash().alias("h"))


def _ranked(by_source: DataFrame) -> DataFrame:
    """by_source (source and others) with `rank`, from 0, in code point order, null last.

    Sources are counted within those that share their first `DEEP` characters, these within those that share `FLAT`,
    and only the latter, two characters at most, go through one task.
    """
    keyed = by_source.withColumns({"deep": F.substring("source", 1, DEEP), "flat": F.substring("source", 1, FLAT)})
    order = lambda x: F.col(x).asc_nulls_last()
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    deep = keyed.groupBy("deep", "flat").agg(F.count("*").alias("n"))
    flat = deep.groupBy("flat").agg(F.sum("n").alias("n")).select(F.col("flat").alias("f"), earlier(Window.orderBy(order("flat"))).alias("at_flat"))
    deep = deep.select(F.col("deep").alias("d"), "flat", earlier(Window.partitionBy("flat").orderBy(order("deep"))).alias("at_deep"))
    places = deep.join(flat, F.col("flat").eqNullSafe(F.col("f"))).select("d", (F.col("at_flat") + F.col("at_deep")).alias("before"))
    own = keyed.withColumn("at", F.row_number().over(Window.partitionBy("deep").orderBy(order("source"))) - 1)
    placed = own.join(places, F.col("deep").eqNullSafe(F.col("d")))
    return placed.select(*by_source.columns, (F.col("before") + F.col("at")).alias("rank"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for each source, from rows (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3 and so on. They share the sum of all sizes by
    weight; none gets more than MOST times its size, and what is over is shared again by weight. That is: with
    sources in order of size over weight, the first ones get MOST times their size, and from the first whose
    share is within its limit on, all get their share of the rest: a rate for each unit of weight, the one number that
    comes to the driver. Sources of one size over weight are summed, and so are classes of these.
    """
    by_source = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    weighted = stored(_ranked(by_source).withColumn("w", (F.col("rank") % WEIGHTS + 1).cast("double")).drop("rank"), "weighted")
    ratio = F.col("source_size") / F.col("w")
    alike = weighted.groupBy(ratio.alias("ratio")).agg(
        F.sum("source_size").alias("s"), F.sum("w").alias("w"), F.min(F.struct("source_size", "w")).alias("one")
    ).withColumn("of", F.coalesce(F.floor(F.log2("ratio") * 16), F.lit(-1 << 40)))
    classes = alike.groupBy("of").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    none = lambda kind: F.lit(0).cast(kind)
    earlier = lambda w, x, kind: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), none(kind))
    over, inner, everything = Window.orderBy("of"), Window.partitionBy("of").orderBy("ratio"), Window.partitionBy()
    # Some hundred rows: a class for each sixteenth of a power of two.
    bases = classes.select(
        "of", earlier(over, "s", "long").alias("base_s"), earlier(over, "w", "double").alias("base_w"),
        F.sum("s").over(everything).alias("all_s"), F.sum("w").over(everything).alias("all_w"),
    )
    placed = alike.select("of", "one", earlier(inner, "s", "long").alias("in_s"), earlier(inner, "w", "double").alias("in_w")).join(bases, "of")
    used, left = MOST * (F.col("base_s") + F.col("in_s")).cast("double"), F.col("all_w") - (F.col("base_w") + F.col("in_w"))
    rated = placed.withColumn("rate", (F.col("all_s").cast("double") - used) / left)
    within = MOST * F.col("one.source_size").cast("double") >= F.col("rate") * F.col("one.w")
    rate = rated.agg(F.max(F.when(within, F.col("rate")))).first()[0]
    target = F.least(MOST * F.col("source_size").cast("double"), F.lit(rate).cast("double") * F.col("w"))
    return weighted.select("source", "source_size", target.alias("target"))


def _matching(source: str) -> Column:
    return F.col("source").eqNullSafe(F.col(source))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with `copies`, which each document gets, and `below`: documents with a hash under it get one more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.withColumn("copies", F.least(copies, F.lit(MOST)).cast("long")).select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        "copies",
        (F.col("target") - F.col("copies") * F.col("source_size")).alias("need"),
        F.lit(0).cast("long").alias("low"),  # hashes under it are in
        F.lit(0.0).alias("base"),  # their words
        F.lit(False).alias("settled"),
    )
    state = stored(state, "mix")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        width = 1 << shift
        rows = sizes.join(state.filter("NOT settled").select("s", "low", "base", "need"), _matching("s")).filter(
            (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(width * BUCKETS))
        )
        histogram = rows.groupBy("s", "low", "base", "need", F.shiftright(F.col("h") - F.col("low"), shift).alias("b")).agg(
            F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("most")
        )
        # At most BUCKETS rows for each source.
        upto = Window.partitionBy("s").orderBy("b")
        passed = histogram.withColumn("upto", F.col("base") + F.sum("words").over(upto)).filter("upto > need")
        edge = passed.groupBy(F.col("s").alias("e")).agg(F.min_by(F.struct("b", "words", "upto", "least", "most"), "b").alias("x"))
        x, open_ = F.col("x"), ~F.col("settled")
        one = F.coalesce(x["least"] == x["most"], F.lit(False))
        # Of a hash that would pass the budget, the nearer side is taken.
        nearer = 2 * (F.col("need") - (x["upto"] - x["words"])) >= x["words"]
        low = F.when(x.isNull(), F.lit(1 << HASH_BITS)).when(one, x["least"] + nearer.cast("long")).otherwise(
            F.col("low") + F.shiftleft(x["b"], shift)
        )
        state = stored(
            state.join(edge, F.col("s").eqNullSafe(F.col("e")), "left").select(
                "s", "source_size", "target", "copies", "need",
                F.when(open_, low).otherwise(F.col("low")).alias("low"),
                F.when(open_ & x.isNotNull(), x["upto"] - x["words"]).otherwise(F.col("base")).alias("base"),
                (F.col("settled") | x.isNull() | one).alias("settled"),
            ),
            "mix",
        )
        if not state.filter("NOT settled").head(1):
            break
    return state.select("s", "source_size", "target", "copies", F.col("low").alias("below"))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, source, text): size, source_size, target, taken, copies.

    taken is size times the copies that the mix takes of a document. Rows that share a hash (repeated rows) are
    in or out together. A source without words gets nothing. Null and empty texts have no words; a null source
    is a source; no rows give no rows; other columns are not read.
    """
    sizes = stored(sized(docs.select("doc_id", "source", "text")), "sized")
    goals = settled(docs.sparkSession, lambda: thresholds(sizes, targets(sizes)), "goals")
    copies = F.col("copies") + ((F.col("h") < F.col("below")) & (F.col("copies") < MOST)).cast("long")
    return sizes.join(goals, _matching("s"), "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"),
        "source", "h",
    )


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it.

    Null and empty texts have no words, a null source is a source, and one without words gets none. Rows without
    doc_id go by a hash of their text; repeated rows are in or out together; no rows give no rows.
    """

    def found():
        sizes = stored(sized(docs.select("doc_id", "source", "text")), "sized")
        return thresholds(sizes, targets(sizes))

    goals = settled(docs.sparkSession, found, "goals")
    of, copies, below, times, copy = fresh(docs, "of", "copies", "below", "times", "copy")
    goals = goals.select(F.col("s").alias(of), F.col("copies").alias(copies), F.col("below").alias(below))
    # The columns of docs alone are in scope where these are named.
    keyed = docs.withColumn(times, _hash())
    joined = keyed.join(goals, F.col("source").eqNullSafe(F.col(of)), "left")
    more = ((F.col(times) < F.col(below)) & (F.col(copies) < MOST)).cast("long")
    chosen = joined.withColumn(times, F.col(copies) + more).filter(F.col(times) > 0)
    return chosen.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
