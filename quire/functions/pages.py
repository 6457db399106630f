"""What a page's operations and size amount to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schema import OPS

POINTS_PER_INCH = 72.0


def has_op(ops: Column, kind: str) -> Column:
    return F.coalesce(F.exists(ops, lambda o: o["type"] == kind), F.lit(False))


def drop_ops(ops: Column, kind: str) -> Column:
    return F.filter(ops, lambda o: o["type"] != kind)


def with_op(ops: Column, op: Column) -> Column:
    return F.concat(F.coalesce(ops, F.array().cast(OPS)), F.array(op))


def effective_color_mode(ops: Column) -> Column:
    """The last colour mode; color without one."""
    last = F.try_element_at(F.filter(ops, lambda o: o["type"] == "colorMode"), F.lit(-1))["mode"]
    return F.coalesce(last, F.lit("color"))


def total_rotation(ops: Column) -> Column:
    degrees = F.transform(F.filter(ops, lambda o: o["type"] == "rotate"), lambda o: o["degrees"])
    return F.pmod(F.aggregate(degrees, F.lit(0), lambda a, d: a + d), F.lit(360))


def quarter_turns(degrees: Column) -> Column:
    return F.pmod(F.floor(degrees / 90), F.lit(4)).cast("int")


def effective_page_size(size: Column, ops: Column) -> Column:
    """The original size after all geometry, in the order of the list: 90 and 270 swap, a split halves the width."""
    turned = lambda a: F.struct(a["height"].alias("width"), a["width"].alias("height"))
    halved = lambda a: F.struct((a["width"] / 2).alias("width"), a["height"].alias("height"))
    odd = lambda o: (o["type"] == "rotate") & F.coalesce(F.pmod(o["degrees"], F.lit(180)) == 90, F.lit(False))
    start = F.struct(size["width"].cast("double").alias("width"), size["height"].cast("double").alias("height"))
    step = lambda a, o: F.when(odd(o), turned(a)).when(o["type"] == "split", halved(a)).otherwise(a)
    return F.aggregate(F.coalesce(ops, F.array().cast(OPS)), start, step)


def effective_pixel_size(width: Column, height: Column, ops: Column) -> Column:
    """Whole pixels after all geometry: a left half has floor(w / 2) of them, a right half the rest."""
    odd = lambda o: (o["type"] == "rotate") & F.coalesce(F.pmod(o["degrees"], F.lit(180)) == 90, F.lit(False))
    left = lambda a: F.floor(a["width"] / 2)
    start = F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))
    step = lambda a, o: (
        F.when(odd(o), F.struct(a["height"].alias("width"), a["width"].alias("height")))
        .when(
            o["type"] == "split",
            F.struct(
                F.when(o["side"] == "left", left(a)).otherwise(a["width"] - left(a)).alias("width"),
                a["height"].alias("height"),
            ),
        )
        .otherwise(a)
    )
    return F.aggregate(F.coalesce(ops, F.array().cast(OPS)), start, step)


def operations_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def normalize_odd(value: Column, fallback: int) -> Column:
    """The whole part, or the fallback without one; at least 3 and odd, one more where it is even."""
    finite = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != float("inf"))
    number = F.when(finite, F.floor(F.when(finite, value))).otherwise(F.lit(fallback)).cast("int")
    return F.when(number < 3, 3).when(F.pmod(number, F.lit(2)) == 1, number).otherwise(number + 1)


def bw_options(width: Column, height: Column) -> Column:
    """block_size (15 to 75, odd) and c (6 to 20) that an image's smaller side implies."""
    block = normalize_odd(clamp(normalize_odd(F.round(F.least(width, height) / 50.0), 31), 15, 75), 31)
    return F.struct(block.alias("block_size"), clamp(F.round(block * F.lit(0.2).cast("double")), 6, 20).cast("int").alias("c"))


def jpeg_quality(compression: Column) -> Column:
    quality = F.when(compression == "none", 0.85).when(compression == "low", 0.75).when(compression == "medium", 0.6)
    return quality.otherwise(0.5).cast("double")


def page_size_inches(size: Column) -> Column:
    return F.struct((size["width"] / POINTS_PER_INCH).alias("width"), (size["height"] / POINTS_PER_INCH).alias("height"))


def original_dpi(size: Column, width_px: Column, height_px: Column) -> Column:
    """DPI along each axis and the smaller of both, of a raster and its page."""
    inches = page_size_inches(size)
    x, y = width_px / inches["width"], height_px / inches["height"]
    return F.struct(x.alias("x"), y.alias("y"), F.least(x, y).alias("dpi"))


def output_dpi(original: Column, target: Column, compression: Column) -> Column:
    return F.when(compression == "none", original).otherwise(F.least(original, target))


def pixels(points: Column, dpi: Column) -> Column:
    return F.round(points * dpi / POINTS_PER_INCH).cast("long")


def output_pixel_size(size: Column, dpi: Column) -> Column:
    inches = page_size_inches(size)
    side = lambda v: F.greatest(F.lit(1), F.round(v * dpi)).cast("long")
    return F.struct(side(inches["width"]).alias("width"), side(inches["height"]).alias("height"))


def ops_text(ops: Column) -> Column:
    """Operations as text, for reports and comparisons."""
    parts = F.transform(ops, lambda o: F.concat_ws(":", o["type"], o["degrees"].cast("string"), o["side"], o["mode"]))
    return F.array_join(parts, "|")
