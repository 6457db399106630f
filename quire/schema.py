"""Schemas of the catalogue, and literals for edit operations.

Pages carry an explicit `position` within their `document`: DataFrames have no order. `document` is the output
that a page belongs to; everything that needs an order is partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OP = "struct<type:string,degrees:int,side:string,mode:string>"
OPS = f"array<{OP}>"
SIZE = "struct<width:double,height:double>"
SOURCES = "source_id string, source_order long, name string, mime string, content binary, num_pages int"
PAGES = (
    "document long, position long, id string, source_id string, source_page_index int, "
    f"page_size_pts {SIZE}, operations {OPS}, selected boolean"
)
IMAGE = "image_id string, width int, height int, n_channels int, data binary"
PIXELS = "image_id long, y int, x int, r int, g int, b int, a int"

SIDES = ("left", "right")
MODES = ("color", "gray", "bw", "bw-otsu")
COMPRESSIONS = ("none", "low", "medium", "high")
PDF = "application/pdf"


def _op(kind: str, degrees=None, side=None, mode=None) -> Column:
    as_column = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        F.lit(kind).alias("type"),
        as_column(degrees, "int").alias("degrees"),
        as_column(side, "string").alias("side"),
        as_column(mode, "string").alias("mode"),
    )


def rotate_op(degrees=90) -> Column:
    return _op("rotate", degrees=degrees)


def split_op(side) -> Column:
    return _op("split", side=side)


def color_mode_op(mode) -> Column:
    return _op("colorMode", mode=mode)


def remove_shading_op() -> Column:
    return _op("removeShading")


def enhance_contrast_op() -> Column:
    return _op("enhanceContrast")


def no_ops() -> Column:
    return F.array().cast(OPS)


def page_id(source_id: Column, index: Column) -> Column:
    """An id that reruns repeat: source, page, and later the path of splits."""
    return F.concat_ws("_", source_id.cast("string"), index.cast("string"))


def page_size(width, height) -> Column:
    as_column = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.struct(as_column(width).alias("width"), as_column(height).alias("height"))
