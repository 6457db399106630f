"""Kernels on pixels as rows (image_id, y, x, r, g, b, a), by column functions and windows within an image.

Whole-number grey values round halves up; values written to 8 bits as fractions round halves to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE = "image_id"


def luma() -> Column:
    """Unrounded."""
    weight = lambda w: F.lit(w).cast("double")
    return weight(0.299) * F.col("r") + weight(0.587) * F.col("g") + weight(0.114) * F.col("b")


def gray() -> Column:
    return F.floor(luma() + F.lit(0.5).cast("double")).cast("int")


def _to_rgb(pixels: DataFrame, value: Column) -> DataFrame:
    valued = pixels.withColumn("__v", value.cast("int"))
    return valued.withColumns({c: F.col("__v") for c in "rgb"}).drop("__v")


def to_8_bit(value: Column) -> Column:
    return F.bround(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))).cast("int")


def grayscale(pixels: DataFrame) -> DataFrame:
    return _to_rgb(pixels, gray())


def posterize(pixels: DataFrame, levels: int) -> DataFrame:
    step = F.lit(255.0 / (levels - 1))
    return _to_rgb(pixels, to_8_bit(F.floor(gray() / step + 0.5) * step))


def threshold(pixels: DataFrame, t=160) -> DataFrame:
    return _to_rgb(pixels, F.when(gray() > t, 255).otherwise(0))


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(IMAGE, gray().alias("gray")).agg(F.count("*").alias("n"))


def otsu_thresholds(pixels: DataFrame, default: int = 128) -> DataFrame:
    """image_id and threshold: the grey value of the first largest variance between classes; the default where no
    value has any. Windows go over the histogram, at most 256 rows an image."""
    h = histogram(pixels)
    upto = Window.partitionBy(IMAGE).orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(IMAGE)
    weighted = (F.col("gray") * F.col("n")).cast("double")
    summed = h.select(
        IMAGE,
        "gray",
        F.sum("n").over(upto).alias("wb"),
        F.sum(weighted).over(upto).alias("sb"),
        F.sum("n").over(whole).alias("total"),
        F.sum(weighted).over(whole).alias("sum"),
    )
    wf = F.col("total") - F.col("wb")
    apart = F.col("sb") / F.col("wb") - (F.col("sum") - F.col("sb")) / wf
    variance = F.when(wf > 0, F.col("wb") * wf * apart * apart)
    ranked = summed.withColumn("variance", variance)
    best = F.max_by("gray", F.when(F.col("variance") > 0, F.struct(F.col("variance"), (-F.col("gray")).alias("g"))))
    return ranked.groupBy(IMAGE).agg(F.coalesce(best, F.lit(default)).alias("threshold"))


def otsu(pixels: DataFrame, default: int = 128) -> DataFrame:
    joined = pixels.join(otsu_thresholds(pixels, default), IMAGE)
    return threshold(joined, F.col("threshold")).drop("threshold")


def gray_range(pixels: DataFrame) -> DataFrame:
    """image_id and the least and the greatest unrounded grey value."""
    return pixels.groupBy(IMAGE).agg(F.min(luma()).alias("low"), F.max(luma()).alias("high"))


def contrast(pixels: DataFrame, preview: bool = False) -> DataFrame:
    """Stretched to 0 to 255. A flat image gets its grey value, or is left alone in a preview."""
    joined = pixels.join(gray_range(pixels), IMAGE)
    span = F.col("high") - F.col("low")
    stretched = to_8_bit((luma() - F.col("low")) / span * 255.0)
    value = F.when(span > 0, stretched).otherwise(to_8_bit(luma()))
    flat = (span <= 0) & F.lit(preview)
    valued = joined.withColumns({"__v": value, "__flat": flat})
    return valued.withColumns({c: F.when(F.col("__flat"), F.col(c)).otherwise(F.col("__v")) for c in "rgb"}).drop(
        "__v", "__flat", "low", "high"
    )


def integral(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, total: the sum of grey values up to and including this row and column."""
    rows = Window.partitionBy(IMAGE, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    columns = Window.partitionBy(IMAGE, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    along = pixels.withColumn("__row", F.sum(gray()).over(rows))
    return along.select(IMAGE, "y", "x", F.sum("__row").over(columns).alias("total"))


def box_mean(pixels: DataFrame, half: int) -> DataFrame:
    """pixels with the mean grey value of the (2 half + 1) squared box around each, cut off at the edges."""
    wide = Window.partitionBy(IMAGE, "y").orderBy("x").rangeBetween(-half, half)
    high = Window.partitionBy(IMAGE, "x").orderBy("y").rangeBetween(-half, half)
    along = pixels.withColumns({"__s": F.sum(gray()).over(wide), "__n": F.count("*").over(wide)})
    mean = F.sum("__s").over(high) / F.sum("__n").over(high)
    return along.withColumn("box_mean", mean).drop("__s", "__n")


def adaptive_box(pixels: DataFrame, block_size: int = 15, c: float = 10) -> DataFrame:
    boxed = box_mean(pixels, block_size // 2)
    return _to_rgb(boxed, F.when(gray() > F.col("box_mean") - c, 255).otherwise(0)).drop("box_mean")


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(IMAGE).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def rotate90(pixels: DataFrame) -> DataFrame:
    """Clockwise: (x, y) moves to (height - 1 - y, x)."""
    joined = pixels.join(sizes(pixels), IMAGE)
    moved = joined.withColumns({"__x": F.col("height") - 1 - F.col("y"), "y": F.col("x")})
    return moved.withColumn("x", F.col("__x")).drop("__x", "width", "height")


def crop_half(pixels: DataFrame, side: Column | str) -> DataFrame:
    """The left floor(w / 2) columns, or the rest."""
    side = side if isinstance(side, Column) else F.lit(side)
    joined = pixels.join(sizes(pixels), IMAGE).withColumn("__cut", F.floor(F.col("width") / 2).cast("int"))
    kept = joined.filter(F.when(side == "left", F.col("x") < F.col("__cut")).otherwise(F.col("x") >= F.col("__cut")))
    return kept.withColumn("x", F.when(side == "left", F.col("x")).otherwise(F.col("x") - F.col("__cut"))).drop(
        "__cut", "width", "height"
    )


def packed_bits(pixels: DataFrame, above: int = 127) -> DataFrame:
    """image_id, y, byte_index, value: eight pixels a byte, the leftmost in the highest bit, set where red > above."""
    bit = F.when(F.col("r") > above, F.expr("shiftleft(1, 7 - x % 8)")).otherwise(0)
    return pixels.groupBy(IMAGE, "y", F.expr("x div 8").alias("byte_index")).agg(F.sum(bit).alias("value"))


def quantized(pixels: DataFrame) -> DataFrame:
    return threshold(pixels, 160).withColumn("a", F.lit(255))
