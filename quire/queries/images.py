"""Queries on the raster tier, over pixels as rows, and one that renders buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.queries.bindings import PIXELS, pixels
from quire.raster import pixels as X

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {PIXELS} {sql}" if not sql.lstrip().startswith(",") else f"WITH {PIXELS}{sql}"
        return f

    return register


def _value(df):
    return df.select("image_id", "y", "x", F.col("r").alias("value"))


@query("SELECT image_id, y, x, gray AS value FROM lum")
def px_gray(spark, sf_dir):
    return _value(X.grayscale(pixels(spark, sf_dir)))


@query("SELECT image_id, y, x, CASE WHEN gray > 120 THEN 255 ELSE 0 END AS value FROM lum")
def px_threshold(spark, sf_dir):
    return _value(X.threshold(pixels(spark, sf_dir), 120))


@query("SELECT image_id, y, x, round_even(least(greatest(floor(gray / (255.0::DOUBLE / 3) + 0.5::DOUBLE) * (255.0::DOUBLE / 3), 0), 255), 0)::INT AS value FROM lum")
def px_posterize(spark, sf_dir):
    return _value(X.posterize(pixels(spark, sf_dir), 4))


@query("SELECT image_id, y, x, CASE WHEN gray > 160 THEN 255 ELSE 0 END AS value FROM lum")
def px_quantize(spark, sf_dir):
    return _value(X.quantized(pixels(spark, sf_dir)))


@query("SELECT image_id, gray, count(*) AS n FROM lum GROUP BY image_id, gray")
def px_histogram(spark, sf_dir):
    return X.histogram(pixels(spark, sf_dir))


@query("SELECT image_id, min(luma) AS low, max(luma) AS high FROM lum GROUP BY image_id")
def px_range(spark, sf_dir):
    return X.gray_range(pixels(spark, sf_dir))


_OTSU = """, h AS (
        SELECT image_id, gray, count(*) AS n FROM lum GROUP BY image_id, gray
    ), c AS (
        SELECT image_id, gray, sum(n) OVER o AS wb, sum((gray * n)::DOUBLE) OVER o AS sb, sum(n) OVER w AS total, sum((gray * n)::DOUBLE) OVER w AS s
        FROM h WINDOW o AS (PARTITION BY image_id ORDER BY gray ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY image_id)
    ), v AS (
        SELECT *, CASE WHEN total > wb THEN wb * (total - wb) * (sb / wb - (s - sb) / (total - wb)) * (sb / wb - (s - sb) / (total - wb)) END AS variance FROM c
    ), t AS (
        SELECT image_id, coalesce((list(gray ORDER BY variance DESC, gray) FILTER (variance > 0))[1], 128)::INT AS threshold FROM v GROUP BY image_id
    )"""


@query(_OTSU + " SELECT * FROM t")
def px_otsu(spark, sf_dir):
    return X.otsu_thresholds(pixels(spark, sf_dir))


@query(_OTSU + " SELECT image_id, y, x, CASE WHEN gray > threshold THEN 255 ELSE 0 END AS value FROM lum JOIN t USING (image_id)")
def px_otsu_applied(spark, sf_dir):
    return _value(X.otsu(pixels(spark, sf_dir)))


_STRETCH = """, s AS (
        SELECT image_id, min(luma) AS low, max(luma) - min(luma) AS span FROM lum GROUP BY image_id
    ) SELECT image_id, y, x, CASE WHEN span > 0 THEN round_even(least(greatest((luma - low) / span * 255.0::DOUBLE, 0), 255), 0)::INT ELSE {flat} END AS value
    FROM lum JOIN s USING (image_id)"""


@query(_STRETCH.format(flat="round_even(luma, 0)::INT"))
def px_contrast(spark, sf_dir):
    return _value(X.contrast(pixels(spark, sf_dir)))


@query(_STRETCH.format(flat="r"))
def px_contrast_preview(spark, sf_dir):
    return _value(X.contrast(pixels(spark, sf_dir), preview=True))


@query("""SELECT a.image_id, a.y, a.x, sum(b.gray)::BIGINT AS total FROM lum a JOIN lum b
    ON a.image_id = b.image_id AND b.y <= a.y AND b.x <= a.x GROUP BY a.image_id, a.y, a.x""")
def px_integral(spark, sf_dir):
    return X.integral(pixels(spark, sf_dir))


@query("""SELECT a.image_id, a.y, a.x, CASE WHEN any_value(a.gray) > sum(b.gray)::DOUBLE / count(*) - 4 THEN 255 ELSE 0 END AS value FROM lum a JOIN lum b
    ON a.image_id = b.image_id AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY a.image_id, a.y, a.x""")
def px_adaptive_box(spark, sf_dir):
    return _value(X.adaptive_box(pixels(spark, sf_dir), 5, 4))


@query("SELECT image_id, x AS y, 7 - y AS x, r AS value FROM lum")
def px_rotate90(spark, sf_dir):
    return _value(X.rotate90(pixels(spark, sf_dir)))


@query("SELECT image_id, y, CASE WHEN image_id % 2 = 0 THEN x ELSE x - 4 END AS x, r AS value FROM lum WHERE CASE WHEN image_id % 2 = 0 THEN x < 4 ELSE x >= 4 END")
def px_crop_half(spark, sf_dir):
    side = F.when(F.col("image_id") % 2 == 0, "left").otherwise("right")
    return _value(X.crop_half(pixels(spark, sf_dir), side))


@query("SELECT image_id, y, x // 8 AS byte_index, sum(CASE WHEN r > 127 THEN 1 << (7 - x % 8) ELSE 0 END)::BIGINT AS value FROM lum GROUP BY image_id, y, x // 8")
def px_pack_bits(spark, sf_dir):
    return X.packed_bits(pixels(spark, sf_dir))


@query("SELECT image_id, y, x, CASE WHEN image_id % 256 = 0 THEN 0 ELSE 255 END AS value FROM lum")
def px_otsu_flat(spark, sf_dir):
    """Images of one shade have no threshold of their own: the detached rule's is 0."""
    shade = (F.col("image_id") % 256).cast("int")
    return _value(X.otsu(pixels(spark, sf_dir).withColumns({c: shade for c in "rgb"}), 0))


def _images(spark, sf_dir):
    """image_id and data (RGBA rows) of each vector's image."""
    ordered = F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b", "a")))
    hexed = F.array_join(F.transform(ordered, lambda p: F.concat(*(F.lpad(F.hex(p[c]), 2, "0") for c in "rgba"))), "")
    return pixels(spark, sf_dir).groupBy("image_id").agg(F.unhex(hexed).alias("data"))


def _pages(spark, sf_dir, ops: str, mode: str):
    """A page for each image, with operations given as JSON."""
    from quire.schema import OPS

    return _images(spark, sf_dir).select(
        F.lit(0).cast("long").alias("document"), F.col("image_id").alias("position"), F.col("image_id").cast("string").alias("id"),
        F.from_json(F.lit(ops), OPS).alias("operations"), F.lit(mode).alias("mode"), F.lit(612.0).alias("width_pts"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), "data",
    )


def _png(image, mode):
    from quire.sources.png import encode_rgb

    return encode_rgb(image), "image/png"


def _read_back(rendered):
    """image_id, y, x, value (red) of rendered PNGs."""
    from quire.sources.documents import decode_images

    read = decode_images(rendered.select(F.col("id").alias("path"), "content"))
    spread = read.select("image_id", "width", F.hex("data").alias("h"), F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    return spread.select(
        F.col("image_id").cast("long").alias("image_id"), F.expr("i div width").cast("int").alias("y"), F.expr("CAST(i % width AS int)").alias("x"),
        F.conv(F.expr("substring(h, 8 * i + 1, 2)"), 16, 10).cast("int").alias("value"),
    )


def _rendered(spark, sf_dir, ops, mode, how=None):
    from quire.raster import executor

    return _read_back(executor.render(_pages(spark, sf_dir, ops, mode), _png, how or executor.EXPORT))


def _blur_sql(sigma: float, half: int, value: str, source: str = "lum") -> str:
    """Of each pixel, means of columns by Gaussian weights, over the pixels inside the image."""
    weight = f"exp(-((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)) / (2 * {sigma}::DOUBLE * {sigma}::DOUBLE))"
    values = ", ".join(f"round_even(sum({weight} * b.{v}) / sum({weight}), 0) AS {v}" for v in value.split())
    return f"""SELECT a.image_id, a.y, a.x, {values} FROM {source} a JOIN {source} b
        ON a.image_id = b.image_id AND abs(b.y - a.y) <= {half} AND abs(b.x - a.x) <= {half} GROUP BY a.image_id, a.y, a.x"""


def _shading_sql(sigma: float, half: int) -> str:
    return f""", blurred AS ({_blur_sql(sigma, half, "r g b")})
        SELECT image_id, y, x, round_even(least(greatest(255 + (luma - (0.299::DOUBLE * s.r + 0.587::DOUBLE * s.g + 0.114::DOUBLE * s.b)) * 1.2::DOUBLE, 0), 255), 0)::INT AS value
        FROM lum JOIN blurred s USING (image_id, y, x)"""


@query(_shading_sql(20, 60))
def render_shading(spark, sf_dir):
    return _rendered(spark, sf_dir, '[{"type": "removeShading"}]', "color")


@query(_shading_sql(2, 6))
def render_shading_preview(spark, sf_dir):
    from quire.raster.executor import PREVIEW

    return _rendered(spark, sf_dir, '[{"type": "removeShading"}]', "color", PREVIEW)


@query(""", offsets AS (
        SELECT y.d AS dy, x.d AS dx, exp(-(y.d * y.d) / (2 * 2.6::DOUBLE * 2.6::DOUBLE)) * exp(-(x.d * x.d) / (2 * 2.6::DOUBLE * 2.6::DOUBLE)) AS w
        FROM (SELECT unnest(range(-7, 8)) AS d) y, (SELECT unnest(range(-7, 8)) AS d) x
    ), means AS (
        SELECT a.image_id, a.y, a.x, any_value(a.gray) AS gray, sum(w * b.gray) / sum(w) AS mean
        FROM lum a, offsets o, lum b
        WHERE a.image_id = b.image_id AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7)
        GROUP BY a.image_id, a.y, a.x
    )
    SELECT image_id, y, x, CASE WHEN gray > floor(mean + 0.5::DOUBLE) - 6 THEN 255 ELSE 0 END AS value FROM means""")
def render_black_and_white(spark, sf_dir):
    """By the Gaussian mean of a block of 15, the least there is, less 6; borders repeat."""
    return _rendered(spark, sf_dir, '[{"type": "colorMode", "mode": "bw"}]', "bw")


@query("""SELECT image_id, y, x, CASE WHEN gray > (sum(gray) OVER (PARTITION BY image_id)) / 64.0::DOUBLE - 10 THEN 255 ELSE 0 END AS value FROM lum""")
def render_detached(spark, sf_dir):
    """By the mean of a box of 15, which holds an image of 8 by 8 wherever it is put, less 10."""
    from quire.raster.executor import DETACHED

    return _rendered(spark, sf_dir, '[{"type": "colorMode", "mode": "bw"}]', "bw", DETACHED)


_SMALL = """, small AS (
        SELECT image_id, y // 2 AS y, x // 2 AS x, round_even(sum(r) / 4.0::DOUBLE, 0) AS r, round_even(sum(g) / 4.0::DOUBLE, 0) AS g, round_even(sum(b) / 4.0::DOUBLE, 0) AS b
        FROM lum GROUP BY image_id, y // 2, x // 2
    ), shade AS (
        SELECT image_id, y::INT AS y, x::INT AS x, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)::INT AS gray FROM small
    )"""


def _thumbnails(spark, sf_dir, mode):
    from quire.raster.executor import thumbnails

    return _read_back(thumbnails(_pages(spark, sf_dir, f'[{{"type": "colorMode", "mode": "{mode}"}}]', mode), _png, 4))


@query(_SMALL + " SELECT image_id, y, x, gray AS value FROM shade")
def thumbnail_gray(spark, sf_dir):
    return _thumbnails(spark, sf_dir, "gray")


@query(_SMALL + """ SELECT a.image_id, a.y, a.x, CASE WHEN any_value(a.gray) > sum(b.gray)::DOUBLE / count(*) - 2 THEN 255 ELSE 0 END AS value FROM shade a JOIN shade b
    ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.image_id, a.y, a.x""")
def thumbnail_black_and_white(spark, sf_dir):
    """At a preview's scale a block is 3 pixels, the least there is, and the offset 2."""
    return _thumbnails(spark, sf_dir, "bw")


@query(f", blurred AS ({_blur_sql(0.4, 2, 'gray')}) SELECT image_id, y, x, gray::INT AS value FROM blurred")
def prepared_gray(spark, sf_dir):
    """Gray images as they go into a document: made gray, blurred slightly. They have fewer dots than any level asks for."""
    from quire.raster.executor import prepared
    from quire.schema import page_size

    images = _images(spark, sf_dir).select(
        F.col("image_id").cast("string").alias("id"), F.lit("gray").alias("mode"), page_size(72, 72).alias("page_size_pts"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), "data",
    )
    return _read_back(prepared(images, "low", 0.75, lambda image, quality: _png(image, "gray")[0]))


@query(_OTSU + """ SELECT image_id::VARCHAR AS id, 8 AS width, 8 AS height, 'image/png' AS mime_type,
        string_agg(CASE WHEN gray > threshold THEN 'FFFFFFFF' ELSE '000000FF' END, '' ORDER BY x, 7 - y) AS pixels_hex
    FROM lum JOIN t USING (image_id) GROUP BY image_id""")
def rendered_pages(spark, sf_dir):
    """Each vector's image, turned, made black and white by Otsu's threshold, written as one-bit PNG and read back."""
    from quire.raster.executor import render
    from quire.sources.documents import decode_images
    from quire.sources.png import encode

    rows = _pages(spark, sf_dir, '[{"type": "rotate", "degrees": 90}, {"type": "colorMode", "mode": "bw-otsu"}]', "bw-otsu")
    files = render(rows, encode).filter("mime_type = 'image/png'").select(F.col("id").alias("path"), "content")
    read = decode_images(files)
    return read.select(F.col("image_id").alias("id"), "width", "height", F.lit("image/png").alias("mime_type"), F.hex("data").alias("pixels_hex"))
