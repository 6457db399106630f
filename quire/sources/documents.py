"""PDF sources and sinks as tables.

Scanning reads each file's page tree: how many pages, and of what sizes. Pages of one image each, as scanners make
them, are rasterised here; others need a renderer over a PDF library, which is a plug-in. Writing makes a PDF of images.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.pages import effective_page_size
from quire.functions.strings import ocr_image_name, source_id
from quire.plans.export import export_plan
from quire.raster import executor
from quire.schema import PDF, SIZE
from quire.sources.files import given_order, numbered, write_files
from quire.sources.pdf import page_count, page_image, page_sizes, pdf_of, render_scan  # noqa: F401

POINTS = 72
_SIZES = f"array<{SIZE}>"


def scan_sources(spark: SparkSession, paths: str | Sequence[str], keep_content: bool = False) -> DataFrame:
    """sources of the PDF files under the paths, as sources_of(); in the order in which paths are given, and within a
    folder by folder and name."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted(set(paths))).select("path")
    return _sources(files, given_order(listed.distinct(), paths), "given", keep_content)


def sources_of(files: DataFrame, keep_content: bool = False) -> DataFrame:
    """sources of files (path, content), by folder and name: source_id, source_order (from 0), name, mime, num_pages,
    page_sizes (and content).

    Files whose name doesn't end in .pdf are left out. num_pages and page_sizes are null where a file's pages cannot be
    read, as in an encrypted one, or where it has no content.
    """
    return _sources(files, files.select("path"), None, keep_content)


def _is_pdf(name):
    return F.lower(name).endswith(".pdf")


def _sources(files: DataFrame, places: DataFrame, given: str | None, keep_content: bool) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    # Files are read once for their pages; what is ordered and counted are names.
    sized = files.filter(_is_pdf(name)).select("path", _page_sizes(F.col("content")).alias("page_sizes"))
    placed = numbered(places.filter(_is_pdf(name)), given).join(sized.dropDuplicates(["path"]) if given else sized, "path")
    columns = [
        source_id(F.col("path"), F.col("source_order")).alias("source_id"), "source_order", name.alias("name"), F.lit(PDF).alias("mime"),
        F.when(F.col("page_sizes").isNotNull(), F.size("page_sizes")).alias("num_pages"), "page_sizes",
    ]
    if not keep_content:
        return placed.select(*columns)
    return placed.join(files.select("path", "content"), "path").select(*columns, "content")


def streamed_sources(files: DataFrame) -> DataFrame:
    """The same rows of files as they arrive (path, modificationTime, content). Their order is the time to the
    millisecond, then a hash of the path: what comes later takes no place among what has come."""
    name = F.element_at(F.split("path", "/"), -1)
    order = F.shiftleft(F.unix_millis("modificationTime"), 20) + F.pmod(F.xxhash64("path"), F.lit(1 << 20))
    sized = files.filter(_is_pdf(name)).select("path", order.alias("source_order"), _page_sizes(F.col("content")).alias("page_sizes"))
    return sized.select(
        source_id(F.col("path"), F.col("source_order")).alias("source_id"), "source_order", name.alias("name"), F.lit(PDF).alias("mime"),
        F.when(F.col("page_sizes").isNotNull(), F.size("page_sizes")).alias("num_pages"), "page_sizes",
    )


def _page_sizes(content):
    @F.pandas_udf(_SIZES)
    def sizes(data):
        read = lambda x: None if x is None else page_sizes(bytes(x))
        return data.map(lambda x: None if (found := read(x)) is None else [{"width": w, "height": h} for w, h in found])

    return sizes(content)


def rasterize(pages: DataFrame, sources: DataFrame, renderer: Callable | None = None, max_width: int | None = None) -> DataFrame:
    """pages (source_id, source_page_index, target_dpi and others) with width, height and data of their rasters.

    renderer(content, page_index, dpi, max_width) returns an array of height x width x 4 bytes. A page's size is its
    points times dpi / 72, rounded; with max_width it is that many pixels wide instead. Without a renderer, pages must
    be one image each: others fail.
    """
    draw = renderer or render_scan
    joined = pages.join(sources.select("source_id", "content"), "source_id")
    fields = [*pages.columns, "width", "height", "data"]
    schema = joined.select(*pages.columns, F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(b"").alias("data")).schema

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                image = draw(row["content"], row["source_page_index"], row.get("target_dpi"), max_width)
                row |= {"width": image.shape[1], "height": image.shape[0], "data": image.tobytes()}
                kinds = [f for f in batch.schema if f.name in fields] + [pa.field("width", pa.int32()), pa.field("height", pa.int32()), pa.field("data", pa.binary())]
                yield pa.RecordBatch.from_pylist([{f.name: row[f.name] for f in kinds}], schema=pa.schema(kinds)).select(fields)

    return joined.select(*pages.columns, "content").mapInArrow(run, schema)


def decode_images(files: DataFrame) -> DataFrame:
    """image_id, width, height, data of PNG files (path, content)."""
    from quire.sources.png import decode

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = decode(content)
                values = [[path], [image.shape[1]], [image.shape[0]], [4], [image.tobytes()]]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                names = ["image_id", "width", "height", "n_channels", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    from quire.schema import IMAGE

    return files.select("path", "content").mapInArrow(run, IMAGE)


_RENDERED = ["position", "content", "mime_type", "width", "height", "width_pts", "height_pts"]


def assembled(rendered: DataFrame, ocr_used: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """document, content (a PDF of its pages in order) and ocr_used. rendered: document, position, content,
    mime_type, width, height, width_pts, height_pts; texts (document, position, text) lie unseen under the images.

    A document is one value, so its pages must fit one task; they come to it as they are, not as one row.
    """
    own = rendered.select("document", *_RENDERED)
    if texts is not None:
        own = own.join(texts.select("document", "position", "text"), ["document", "position"], "left")
    else:
        own = own.withColumn("text", F.lit(None).cast("string"))
    kept = [*_RENDERED, "text"]

    def make(table: pa.Table) -> pa.Table:
        pages = table.sort_by("position").select(kept[1:])
        content = pdf_of(list(zip(*(pages.column(c).to_pylist() for c in kept[1:]), strict=True)))
        return pa.table({"document": table.column("document").slice(0, 1), "content": pa.array([content], pa.binary())})

    made = own.groupBy("document").applyInArrow(make, "document long, content binary")
    return made.withColumn("ocr_used", F.lit(ocr_used))


def recognised_text(rendered: DataFrame, engine: Callable[[bytes, str], str] | None, lang: str = "eng") -> DataFrame | None:
    """document, position, image_name and text by engine(content, lang), or None: without an engine, documents are
    saved without text. Several languages are one string, joined by +. A page that the engine fails on has no text."""
    if engine is None:
        return None

    def text(content):
        try:
            return engine(content, lang)
        except Exception:  # noqa: BLE001
            return None

    def run(batches):
        for batch in batches:
            found = pa.array([text(x.as_py()) for x in batch.column(3)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], ["document", "position", "image_name", "text"])

    name = ocr_image_name((F.col("position") + 1).cast("int")).alias("image_name")
    own = rendered.select(F.col("document").cast("long"), F.col("position").cast("long"), name, "content")
    return own.mapInArrow(run, "document long, position long, image_name string, text string")


def exported(
    pages: DataFrame, sources: DataFrame, compression: str = "high", renderer: Callable | None = None,
    encode: Callable | None = None, engine: Callable | None = None, lang: str = "eng",
) -> DataFrame:
    """document, content (its PDF) and ocr_used: from the pages of the catalogue and the sources' content to saved files.

    pages: document, position, id, source_id, source_page_index, original_size_pts and operations. Each page is
    rasterised at the resolution that its mode and the compression give, its operations are applied, the image is
    encoded by encode(image, mode, quality), and a document's images become the pages of one PDF.
    """
    from quire.sources.png import encode_as_saved

    plan = export_plan(pages, compression).select("document", "position", "mode", "target_dpi", "jpeg_quality", "width_pts", "height_pts")
    known = pages.select("document", "position", "id", "source_id", "source_page_index", "operations", F.col("original_size_pts.width").alias("original_width"))
    drawn = rasterize(known.join(plan, ["document", "position"]), sources, renderer)
    quality = {"low": 0.75, "medium": 0.60, "high": 0.50}.get(compression, 0.85)
    own = drawn.withColumnRenamed("width_pts", "final_width").withColumn("width_pts", F.col("original_width"))
    images = executor.render(own, lambda image, mode: (encode or encode_as_saved)(image, mode, quality))
    sized = images.join(plan.select("document", "position", "width_pts", "height_pts"), ["document", "position"])
    texts = recognised_text(sized, engine, lang)
    return assembled(sized, texts is not None, texts)


def processed(pages: DataFrame, sources: DataFrame, encode: Callable | None = None, renderer: Callable | None = None, dpi: int = 300) -> DataFrame:
    """document, position, id, width, height, mime_type, content of pages (of `sources`) rasterised at full resolution,
    with their operations applied by the detached kernels, as PNG: one page's work, from file to image."""
    from quire.functions.pages import effective_color_mode
    from quire.sources.png import encode_rgb

    own = pages.select(
        "document", "position", "id", "source_id", "source_page_index", "operations", F.lit(dpi).alias("target_dpi"),
        effective_color_mode(F.col("operations")).alias("mode"), F.lit(612.0).alias("width_pts"),
    )
    encoder = encode or (lambda image, mode: (encode_rgb(image), "image/png"))
    return executor.render(rasterize(own, sources, renderer), encoder, executor.DETACHED)


def png_files(images: DataFrame) -> DataFrame:
    """name, mime_type and content of PNG files of images (name, width, height, data)."""
    from quire.sources.png import encode_rgb

    def run(batches):
        for batch in batches:
            for name, width, height, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = encode_rgb(np.frombuffer(data, np.uint8).reshape(height, width, 4))
                columns = [pa.array([name]), pa.array(["image/png"]), pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["name", "mime_type", "content"])

    return images.select("name", "width", "height", "data").mapInArrow(run, "name string, mime_type string, content binary")


def save(documents: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """Writes each document (document, content) under its name (document, name) into a folder that all tasks reach, from
    tasks; returns name and bytes of each file."""
    return write_files(documents.join(names, "document").select("name", "content"), folder)


def blank(width: int, height: int) -> np.ndarray:
    return np.full((height, width, 4), 255, np.uint8)


def original_pages(pages: DataFrame) -> DataFrame:
    """pages of expand_pages() with original_size_pts, and page_size_pts after their operations."""
    sized = pages.withColumn("original_size_pts", F.col("page_size_pts"))
    return sized.withColumn("page_size_pts", effective_page_size(F.col("original_size_pts"), F.col("operations")))
