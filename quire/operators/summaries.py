"""Summaries of page lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.pages import effective_color_mode
from quire.functions.strings import mode_label, output_filename

#: In order of precedence among labels that are equally common.
LABELS = ("", "gray", "bw", "bwprog")


def most_common_mode(pages: DataFrame, by: tuple[str, ...] = ("document",)) -> DataFrame:
    """The label of the commonest effective colour mode of each group."""
    label = mode_label(effective_color_mode(F.col("operations")))
    counts = pages.groupBy(*by, label.alias("label")).agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col("label"))
    return counts.groupBy(*by).agg(F.max_by("label", F.struct(F.col("n"), (-rank).alias("rank"))).alias("label"))


def output_names(pages: DataFrame, stems: DataFrame, compression: str, ocr_used: bool) -> DataFrame:
    """document and name: the only stem (document, stem) of a document or `merged`, and what was done."""
    one = stems.groupBy("document").agg(
        F.when(F.count_distinct("stem") == 1, F.min("stem")).otherwise("merged").alias("base")
    )
    labelled = most_common_mode(pages).join(one, "document")
    name = output_filename(F.col("base"), F.lit(compression), F.col("label"), F.lit(ocr_used))
    return labelled.select("document", name.alias("name"))
