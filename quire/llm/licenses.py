"""License scan by diagonal voting.

All rolling word 3-grams of all texts are joined, on their hash, with the places of the 3-grams in license
templates. Matches of one text and template are summed by diagonal (place in the text less place in the
template), neighbouring diagonals are merged, and what remains is verified on the words it covers.

The templates are a fixed table, so it is broadcast; the grams are streamed past it and never shuffled. Only
matches and one row for each text are.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    text: str
    #: A base phrase counts where its words stand consecutively, and only there.
    base: bool
    #: Least share of its 3-grams that an alignment must hold; more for texts that differ in one word.
    least: float = 0.6


# Phrases of the base, and sentences of well-known public licenses in normalised words.
TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("gpl-3", "licensed under the gnu general public license version 3", False, 0.9),
    Template("gpl-2", "licensed under the gnu general public license version 2", False, 0.9),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", False),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation", False),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("apache-2", "you may not use this file except in compliance with the license", False),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license", False),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike license", False),
)

#: Diagonals at most so far apart are one alignment with words put in or left out.
DRIFT = 3
#: Most words of an alignment for each word of its template.
STRETCH = 1.5
#: Places of a template's grams that one long marks; longer templates take several.
MASK_BITS = 63
#: Of the row that carries a text itself through the join.
SELF = -1
#: Copies of a row that one task puts out.
REPEATS = 10_000


def lowered(text: Column) -> Column:
    """lower() for comparing ASCII words: the two letters that it would turn into ASCII ones are put aside."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0138")))


def words(text: Column) -> Column:
    """Words of normalised text, in lower case."""
    return F.filter(F.split(lowered(text), NOT_WORD), lambda x: x != "")


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, at, t_gram): each 3-gram of each template, and the row that lets each text through."""
    found = [(SELF, SELF, "")]
    for t, template in enumerate(templates):
        w = template.text.split()
        found += [(t, i, " ".join(w[i : i + K])) for i in range(len(w) - K + 1)]
    grams = spark.createDataFrame(found, "template int, at int, t_gram string")
    return grams.withColumn("hash", F.xxhash64("t_gram"))


def _one_template(templates) -> DataFrame:
    spark = SparkSession.active()
    return spark.createDataFrame(
        [(t, x.label, x.base, len(x.text.split()), x.least) for t, x in enumerate(templates)],
        "template int, label string, base boolean, t_words int, least double",
    )


def matches(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, version, n_words, template, place, at): where grams of templates stand in texts.

    version tells texts apart that share a doc_id. A row of template SELF stands for the text itself.
    """
    spark = docs.sparkSession
    w = F.col("__words")
    split = docs.select("doc_id", F.xxhash64("text").alias("version"), F.coalesce(words(F.col("text")), F.array()).alias("__words"))
    places = F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))
    # Words one by one: slice() would copy the whole array for each gram.
    grams = F.transform(places, lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(K))))
    rolled = split.select(
        "doc_id",
        "version",
        F.size(w).cast("long").alias("n_words"),
        # The empty gram leads, at SELF.
        F.posexplode(F.concat(F.array(F.lit("")), grams)).alias("place", "gram"),
    )
    table = F.broadcast(template_grams(spark, templates))
    hit = rolled.withColumn("hash", F.xxhash64("gram")).join(table, "hash").filter("gram = t_gram")
    return hit.select("doc_id", "version", "n_words", "template", (F.col("place") - 1).alias("place"), "at")


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, version, n_words, copies, label, base, start, length, score): verified spans, and for each
    distinct row one without label."""
    key = ["doc_id", "version", "n_words", "template"]
    found = matches(docs, templates)
    longest = max((len(x.text.split()) for x in templates), default=0)
    masks = [f"mask{k}" for k in range(max(longest - K, 0) // MASK_BITS + 1)]
    at = F.greatest("at", F.lit(0))
    bit = F.expr(f"shiftleft(1L, greatest(at, 0) % {MASK_BITS})")
    # One row for each gram that matched; rows that repeat in the input are counted, each task's before the shuffle.
    # Then what belongs to one text is put into one partition, so what follows needs no further shuffle.
    votes = found.groupBy(*key, "place", "at").agg(F.count("*").alias("copies")).repartition(*key[:3])
    diagonals = (
        votes.withColumn("diagonal", F.col("place") - F.col("at"))
        .groupBy(*key, "diagonal", "copies")
        .agg(
            F.count("*").alias("votes"),
            F.min("place").alias("first"),
            F.max("place").alias("last"),
            *(F.sum(F.when(F.floor(at / MASK_BITS) == k, bit).otherwise(0)).alias(m) for k, m in enumerate(masks)),
        )
    )
    known = F.broadcast(_one_template(templates))
    diagonals = diagonals.join(known, "template", "left")
    # A base phrase stands on one diagonal, complete; so do merged ones start at each diagonal anew.
    by = Window.partitionBy(*key).orderBy("first", "diagonal")
    apart = (
        F.coalesce("base", F.lit(True))
        | F.lag("diagonal").over(by).isNull()
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > DRIFT)
        | (F.col("first") - F.lag("last").over(by) > F.col("t_words"))
    )
    merged = (
        diagonals.withColumn("__new", apart.cast("int"))
        .withColumn("__group", F.sum("__new").over(by))
        .groupBy(*key, "copies", "label", "base", "t_words", "least", "__group")
        .agg(
            F.min("first").alias("start"),
            (F.max("last") + K - F.min("first")).alias("length"),
            reduce(add, (F.bit_count(F.bit_or(m)) for m in masks)).alias("held"),
        )
    )
    grams = F.col("t_words") - (K - 1)
    score = F.col("held") / grams
    verified = F.when(F.col("base"), F.col("held") == grams).otherwise(
        (score >= F.col("least")) & (F.col("length") <= STRETCH * F.col("t_words"))
    )
    return merged.filter((F.col("template") == SELF) | verified).select(
        "doc_id", "version", "n_words", "copies", "label", "base", "start", "length", score.alias("score")
    )


def licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row for each row of docs (doc_id, text): the labels of its license phrases, and where they stand.

    score is the largest share of a template that a span holds, 0 without any. Null and empty texts have no
    words and no labels. A long text has many spans, but they meet as rows of one group, never as one array of
    its words. Rows that repeat doc_id and text count once and come out as often as they went in; no rows
    give no rows; other columns are not read.
    """
    of_base = F.when(F.col("base"), F.col("start"))
    found = (
        spans(docs.select("doc_id", "text"), templates)
        .groupBy("doc_id", "version", "n_words")
        .agg(
            F.max(F.when(F.col("label").isNull(), F.col("copies"))).alias("copies"),
            F.count(of_base).alias("n_base"),
            F.min(of_base).cast("long").alias("first_word"),
            F.max(of_base).cast("long").alias("last_word"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
            F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        )
    )
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    one = F.lit(1).cast("long")
    few = found.filter(F.col("copies") <= REPEATS).withColumn("__copy", F.explode(F.sequence(one, "copies")))
    # A row that is there very often is dealt out before it is repeated.
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / REPEATS)))
    many = found.filter(F.col("copies") > REPEATS).withColumn("__part", parts).repartition("__part")
    of_part = F.sequence(one, F.least(F.lit(REPEATS).cast("long"), F.col("copies") - F.col("__part") * REPEATS))
    return few.select(columns).union(many.withColumn("__copy", F.explode(of_part)).select(columns))
