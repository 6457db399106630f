"""Edits of selected pages. Each takes a page list and gives another; nothing is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.pages import drop_ops, has_op, with_op
from quire.operators.catalog import renumbered
from quire.schema import MODES, color_mode_op, enhance_contrast_op, remove_shading_op, rotate_op, split_op


def _on_selected(pages: DataFrame, **columns: Column) -> DataFrame:
    return pages.withColumns({k: F.when(F.col("selected"), v).otherwise(F.col(k)) for k, v in columns.items()})


def rotate_selected(pages: DataFrame, degrees: int = 90) -> DataFrame:
    """Appends a turn; 90 and 270 degrees swap the page's sides."""
    size = F.col("page_size_pts")
    turned = F.struct(size["height"].alias("width"), size["width"].alias("height")) if degrees % 180 == 90 else size
    return _on_selected(pages, operations=with_op(F.col("operations"), rotate_op(degrees)), page_size_pts=turned)


def split_selected(pages: DataFrame) -> DataFrame:
    """Each selected page becomes its left and its right half, side by side, neither selected."""
    size, side = F.col("page_size_pts"), F.col("__side")
    whole = F.array(F.lit(None).cast("string"))
    halves = F.when(F.coalesce("selected", F.lit(False)), F.array(F.lit("left"), F.lit("right"))).otherwise(whole)
    out = pages.select("*", F.posexplode(halves).alias("__half", "__side"))
    half = F.struct((size["width"] / 2).alias("width"), size["height"].alias("height"))
    out = out.withColumns(
        {
            "id": F.when(side.isNull(), F.col("id")).otherwise(F.concat_ws("_", "id", side)),
            "operations": F.when(side.isNull(), F.col("operations")).otherwise(with_op(F.col("operations"), split_op(side))),
            "page_size_pts": F.when(side.isNull(), size).otherwise(half),
            "selected": F.when(side.isNull(), F.col("selected")).otherwise(F.lit(False)),
        }
    )
    return renumbered(out, "position", "__half").select(*pages.columns)


def delete_selected(pages: DataFrame) -> DataFrame:
    return renumbered(pages.filter(~F.coalesce(F.col("selected"), F.lit(False))))


def color_mode_selected(pages: DataFrame, mode: str) -> DataFrame:
    """Replaces the colour mode; color takes it away."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode}")
    others = drop_ops(F.col("operations"), "colorMode")
    return _on_selected(pages, operations=others if mode == "color" else with_op(others, color_mode_op(mode)))


def _once(pages: DataFrame, kind: str, op: Column) -> DataFrame:
    ops = F.col("operations")
    return _on_selected(pages, operations=F.when(has_op(ops, kind), ops).otherwise(with_op(ops, op)))


def remove_shading_selected(pages: DataFrame) -> DataFrame:
    return _once(pages, "removeShading", remove_shading_op())


def enhance_contrast_selected(pages: DataFrame) -> DataFrame:
    return _once(pages, "enhanceContrast", enhance_contrast_op())
