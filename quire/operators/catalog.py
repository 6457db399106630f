"""Sources and pages: scanning, selecting, ordering, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.strings import file_stem
from quire.schema import PDF, color_mode_op, page_id, page_size

#: Sources whose page counts are summed together before sources are.
RANGE = 4096


def pdf_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("mime") == PDF)


def running_offset(rows: DataFrame, order: str, amount: str, name: str, size: int = RANGE) -> DataFrame:
    """rows with the sum of `amount` over all rows of a smaller `order` (whole numbers), as `name`.

    Ranges of `order` are summed first, so what goes through a single task is one row for each range, and rows
    are summed within their range only.
    """
    part = F.floor(F.col(order) / size)
    ranged = rows.withColumn("__range", part)
    sums = ranged.groupBy("__range").agg(F.sum(amount).alias("__sum"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__range").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("__own", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return own.join(bases, "__range").withColumn(name, F.col("__base") + F.col("__own")).drop("__range", "__own", "__base")


def expand_pages(sources: DataFrame, size: Column | None = None, mode: str = "gray", unreadable: str = "error") -> DataFrame:
    """A row for each page of each source, all of one document, in order of source and page.

    Pages start unselected, with a colour mode. Their size is `size`, else what sources have in page_sizes, else 612 x
    792. A source of 0 pages gives none. One whose pages could not be counted (num_pages is null) fails the load when
    rows are read, or is left out (unreadable="skip").
    """
    if unreadable not in ("error", "skip"):
        raise ValueError(f"unreadable must be error or skip, not {unreadable}")
    counted = sources
    if unreadable == "error":
        failed = F.raise_error(F.concat(F.lit("cannot read the pages of "), F.coalesce("source_id", F.lit("?")))).cast("int")
        counted = sources.withColumn("num_pages", F.when(F.col("num_pages").isNull(), failed).otherwise(F.col("num_pages")))
    placed = running_offset(counted.filter("num_pages > 0"), "source_order", "num_pages", "__before")
    pages = placed.withColumn("source_page_index", F.explode(F.expr("sequence(0, num_pages - 1)")))
    own = F.get("page_sizes", F.col("source_page_index")) if "page_sizes" in sources.columns else page_size(612, 792)
    return pages.select(
        F.lit(0).cast("long").alias("document"),
        (F.col("__before") + F.col("source_page_index")).cast("long").alias("position"),
        page_id(F.col("source_id"), F.col("source_page_index")).alias("id"),
        F.col("source_id").cast("string").alias("source_id"),
        "source_page_index",
        (size if size is not None else own).alias("page_size_pts"),
        F.array(color_mode_op(mode)).alias("operations"),
        F.lit(False).alias("selected"),
    )


def concatenated(*parts: DataFrame) -> DataFrame:
    """Page lists one after the other, within each document; positions are counted anew."""
    union = None
    for i, part in enumerate(parts):
        own = part.withColumn("__part", F.lit(i))
        union = own if union is None else union.unionByName(own)
    return renumbered(union, "__part", "position").drop("__part")


def renumbered(pages: DataFrame, *order) -> DataFrame:
    """position counted from 0 within each document, in the given order (by default, the present one)."""
    within = Window.partitionBy("document").orderBy(*(order or ("position",)))
    return pages.withColumn("position", (F.row_number().over(within) - 1).cast("long"))


def selected_pages(pages: DataFrame) -> DataFrame:
    return pages.filter("selected")


def all_selected(pages: DataFrame) -> DataFrame:
    """Whether every page is selected; false without pages."""
    return pages.agg(F.coalesce(F.bool_and("selected"), F.lit(False)).alias("all_selected"))


def select_all(pages: DataFrame, on: bool) -> DataFrame:
    return pages.withColumn("selected", F.lit(on))


def toggled(pages: DataFrame, page: str) -> DataFrame:
    """One page's selection the other way round."""
    return pages.withColumn("selected", F.when(F.col("id") == page, ~F.col("selected")).otherwise(F.col("selected")))


def reordered(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages in a given order. order: id, rank; pages that it doesn't name come last, as they were."""
    ranked = pages.join(order.select("id", F.col("rank").alias("__rank")), "id", "left")
    out = renumbered(ranked, F.col("__rank").asc_nulls_last(), "position")
    return out.select(*pages.columns)


def by_index(results: DataFrame, index: str = "index") -> DataFrame:
    """Results of tasks in the order in which the tasks were given."""
    return results.orderBy(index)


def page_numbers(pages: DataFrame) -> DataFrame:
    """id and page_number, from 1, within each document."""
    within = Window.partitionBy("document").orderBy("position")
    return pages.select("document", "id", F.row_number().over(within).cast("long").alias("page_number"))


def distinct_stems(sources: DataFrame) -> DataFrame:
    return sources.select(file_stem(F.col("name")).alias("stem")).distinct()


def totals(sources: DataFrame) -> DataFrame:
    """Pages of all sources, sources, and whether all have one stem."""
    stems = F.count_distinct(file_stem(F.col("name")))
    return sources.agg(
        F.coalesce(F.sum("num_pages"), F.lit(0)).cast("long").alias("total_pages"),
        F.count("*").alias("sources"),
        (stems == 1).alias("single_stem"),
    )


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages and selected pages of each document."""
    return pages.groupBy("document").agg(F.count("*").alias("pages"), F.count_if("selected").alias("selected_pages"))
