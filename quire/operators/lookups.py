"""Lookups by key, and the one join by place.

Sources and pages are joined by Spark's choice: it broadcasts a side that it finds small and shuffles else. The
table of resolutions has twelve rows and is always broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dots an inch by family of modes and compression.
DPI = {
    "color": {"none": 300, "low": 180, "medium": 150, "high": 120},
    "gray": {"none": 300, "low": 200, "medium": 150, "high": 120},
    "bw": {"none": 300, "low": 260, "medium": 200, "high": 150},
}


def dpi_table(spark: SparkSession) -> DataFrame:
    rows = [(family, level, dpi) for family, levels in DPI.items() for level, dpi in levels.items()]
    return spark.createDataFrame(rows, "family string, compression string, dpi int")


def family(mode: Column) -> Column:
    return F.when(mode.isin("bw", "bw-otsu"), "bw").when(mode == "gray", "gray").otherwise("color")


def family_by_name(mode: Column) -> Column:
    """The older rule: a mode is its own family, and all others, bw-otsu among them, count as gray."""
    return F.when(mode.isin(*DPI), mode).otherwise("gray")


def with_target_dpi(rows: DataFrame, mode: Column, compression: Column, of=family) -> DataFrame:
    """rows with target_dpi; an unknown compression counts as medium."""
    table = F.broadcast(dpi_table(rows.sparkSession)).select(
        F.col("family").alias("__family"), F.col("compression").alias("__level"), F.col("dpi").alias("target_dpi")
    )
    level = F.when(compression.isin("none", "low", "medium", "high"), compression).otherwise("medium")
    keyed = rows.withColumns({"__f": of(mode), "__c": level})
    same = (F.col("__f") == F.col("__family")) & (F.col("__c") == F.col("__level"))
    return keyed.join(table, same, "left").drop("__family", "__level", "__f", "__c")


def with_source(pages: DataFrame, sources: DataFrame, missing: str = "null") -> DataFrame:
    """pages with their source's columns. missing: null keeps pages without source, skip drops them, error fails
    when such a page is read."""
    if missing == "skip":
        return pages.join(sources, "source_id")
    joined = pages.join(sources.withColumn("__known", F.lit(True)), "source_id", "left")
    if missing == "error":
        failed = F.raise_error(F.concat(F.lit("no source for page "), F.col("id")))
        joined = joined.withColumn("source_id", F.when(F.col("__known"), F.col("source_id")).otherwise(failed))
    elif missing != "null":
        raise ValueError(f"missing must be null, skip or error, not {missing}")
    return joined.drop("__known")


def zipped(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("document", "position")) -> DataFrame:
    """Rows of one place in one document each; the longer side's surplus is left out."""
    return left.join(right, list(on))
