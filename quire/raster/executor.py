"""Interprets operation lists over images, one task a partition, few images at a time.

Geometry goes in the order of the list; then the last colour mode, shading removal and contrast, in this order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.raster import kernels

#: Which kernels a rendering uses. The export is the one that counts.
EXPORT = {
    "gray": lambda image, width: kernels.grayscale(image),
    "bw": lambda image, width: kernels.adaptive_gaussian(image),
    "bw-otsu": lambda image, width: kernels.otsu(image),
    "removeShading": lambda image, width: kernels.remove_shading(image),
    "enhanceContrast": lambda image, width: kernels.contrast(image),
}
PREVIEW = {
    "gray": EXPORT["gray"],
    "bw": lambda image, width: kernels.adaptive_preview(image, width),
    "bw-otsu": lambda image, width: kernels.otsu(image, 128),
    "removeShading": lambda image, width: kernels.remove_shading_preview(image, width),
    "enhanceContrast": lambda image, width: kernels.contrast(image, preview=True),
}
DETACHED = EXPORT | {
    "bw": lambda image, width: kernels.adaptive_box(image, 15, 10),
    "bw-otsu": lambda image, width: kernels.otsu(image, 0),
}


def apply_operations(image: np.ndarray, ops: list[dict], width_pts: float = 612.0, how=EXPORT) -> np.ndarray:
    for op in ops or []:
        if op["type"] == "rotate":
            for _ in range((op["degrees"] // 90) % 4):
                image = kernels.rotate90(image)
        elif op["type"] == "split":
            image = kernels.crop_half(image, op["side"])
    modes = [op["mode"] for op in ops or [] if op["type"] == "colorMode"]
    if modes and modes[-1] in how:
        image = how[modes[-1]](image, width_pts)
    for kind in ("removeShading", "enhanceContrast"):
        if any(op["type"] == kind for op in ops or []):
            image = how[kind](image, width_pts)
    return image


_RENDERED = "document long, position long, id string, width int, height int, mime_type string, content binary"


def render(pages: DataFrame, encode: Callable[[np.ndarray, str], tuple[bytes, str]], how=EXPORT) -> DataFrame:
    """Rendered pages, each encoded by encode(image, mode) to bytes and a MIME type.

    pages: document, position, id, operations, mode, width_pts, and an image (width, height, data: RGBA rows).
    Images stay in the partition they are in; metadata should be joined to them last.
    """
    own = pages.select("document", "position", "id", "operations", "mode", "width_pts", "width", "height", "data")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in own_columns}
                image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 4)
                image = apply_operations(image, row["operations"], row["width_pts"], how)
                content, mime = encode(image, row["mode"])
                values = [row["document"], row["position"], row["id"], image.shape[1], image.shape[0], mime, content]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
                names = [x.split()[0] for x in _RENDERED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    own_columns = own.columns
    return own.mapInArrow(run, _RENDERED)


def thumbnails(pages: DataFrame, encode, max_width: int = 300) -> DataFrame:
    """As render(), at most `max_width` pixels wide before operations, by the preview's kernels."""

    def shrink(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 4)
                if row["width"] > max_width:
                    height = max(1, int(np.floor(row["height"] * max_width / row["width"] + 0.5)))
                    image = kernels.scaled(image, max_width, height)
                row |= {"width": image.shape[1], "height": image.shape[0], "data": image.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return render(pages.mapInArrow(shrink, pages.schema), encode, PREVIEW)


def pages_needing_thumbnails(diff: DataFrame) -> DataFrame:
    return diff.filter("needs_thumbnail")


def prepare(image: np.ndarray, original: np.ndarray, mode: str, compressed: bool, size: tuple[int, int], quality: float, jpeg) -> tuple[np.ndarray, bytes, str]:
    """An image as it goes into a document by the older rules, its bytes and MIME type. original: before the mode was
    applied; size: of the result, if compressed; jpeg(image, quality) encodes.

    Uncompressed colour is the original as PNG; black and white is made so by the mode's threshold and has one bit;
    compressed colour and gray are JPEG, gray ones after a slight blur.
    """
    from quire.sources.png import encode_bw, encode_rgb

    out = original if mode == "color" and not compressed else image
    if compressed:
        out = kernels.scaled(out, *size, fill_white=mode != "color", smooth=mode != "bw")
    if mode in ("bw", "bw-otsu"):
        out = kernels.apply_mode(out, mode)
        return out, encode_bw(out), "image/png"
    if compressed and mode in ("color", "gray"):
        out = kernels.blur(kernels.grayscale(out), 0.4) if mode == "gray" else out
        return out, jpeg(out, quality), "image/jpeg"
    return out, encode_rgb(out), "image/png"


def prepared(images: DataFrame, compression: str, quality: float, jpeg: Callable | None = None) -> DataFrame:
    """id, width, height, mime_type and content of images as they go into a document, by prepare().

    images: id, mode, page_size_pts, width, height, data and, if there is one, original (data before the mode, of the
    same size).
    """
    from quire.plans.export import rescale_plan
    from quire.sources.png import encode_jpeg

    encode, compressed = jpeg or encode_jpeg, compression != "none"
    original = F.col("original") if "original" in images.columns else F.col("data")
    own = images.select("id", "mode", "width", "height", "data", original.alias("original"))
    rasters = images.select("id", "page_size_pts", "mode", F.col("width").alias("width_px"), F.col("height").alias("height_px"))
    sized = own.join(rescale_plan(rasters, compression).select("id", "width_out", "height_out"), "id")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                image, first = (np.frombuffer(row[x], np.uint8).reshape(row["height"], row["width"], 4) for x in ("data", "original"))
                out, content, mime = prepare(image, first, row["mode"], compressed, (row["width_out"], row["height_out"]), quality, encode)
                columns = [pa.array([row["id"]], pa.string()), pa.array([out.shape[1]], pa.int32()), pa.array([out.shape[0]], pa.int32())]
                columns += [pa.array([mime]), pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "width", "height", "mime_type", "content"])

    return sized.mapInArrow(run, "id string, width int, height int, mime_type string, content binary")
