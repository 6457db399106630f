"""The export plan: for each page, in order, everything that is decided before pixels are touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.pages import (
    effective_color_mode,
    effective_page_size,
    effective_pixel_size,
    has_op,
    jpeg_quality,
    original_dpi,
    output_dpi,
    output_pixel_size,
    pixels,
    total_rotation,
)
from quire.operators.lookups import family_by_name, with_target_dpi


def export_plan(pages: DataFrame, compression: str = "high") -> DataFrame:
    """pages: original_size_pts (before any operation) and operations, besides document, position and id.

    A page is rasterised at its resolution and then turned and cropped, so pixels follow from the original size.
    All of it is a projection and one broadcast join.
    """
    ops = F.col("operations")
    moded = pages.withColumn("mode", effective_color_mode(ops))
    dpi = with_target_dpi(moded, F.col("mode"), F.lit(compression))
    size, target = F.col("original_size_pts"), F.col("target_dpi")
    final = effective_page_size(size, ops)
    px = effective_pixel_size(pixels(size["width"], target), pixels(size["height"], target), ops)
    return dpi.withColumns({"__size": final, "__px": px}).select(
        "document",
        "position",
        "id",
        "mode",
        "target_dpi",
        jpeg_quality(F.lit(compression)).alias("jpeg_quality"),
        F.col("__size.width").alias("width_pts"),
        F.col("__size.height").alias("height_pts"),
        F.col("__px.width").alias("width_px"),
        F.col("__px.height").alias("height_px"),
        total_rotation(ops).cast("int").alias("rotation"),
        has_op(ops, "removeShading").alias("remove_shading"),
        has_op(ops, "enhanceContrast").alias("enhance_contrast"),
    )


def rescale_plan(rasters: DataFrame, compression: str) -> DataFrame:
    """The older plan, from rasters that exist: never more dots than they have. rasters: id, page_size_pts, mode,
    width_px, height_px."""
    original = original_dpi(F.col("page_size_pts"), F.col("width_px"), F.col("height_px"))
    dpi = with_target_dpi(rasters, F.col("mode"), F.lit(compression), family_by_name)
    chosen = output_dpi(F.col("__original.dpi"), F.col("target_dpi").cast("double"), F.lit(compression))
    out = dpi.withColumn("__original", original).withColumn("output_dpi", chosen)
    px = output_pixel_size(F.col("page_size_pts"), F.col("output_dpi"))
    return out.withColumn("__px", px).select(
        "id", "mode", F.col("__original.dpi").alias("original_dpi"), "output_dpi",
        F.col("__px.width").alias("width_out"), F.col("__px.height").alias("height_out"),
    )
