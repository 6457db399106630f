"""Catalogue tables made of the synthetic ones, in Spark and, word for word the same, in SQL.

Sources are documents (a page for each 2000 characters), the log of operations is events (a page for each user),
pixels are embeddings (64 values, 8 by 8). None of them are scans; they exercise the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.pages import effective_page_size
from quire.schema import OPS, color_mode_op, enhance_contrast_op, page_size, remove_shading_op, rotate_op, split_op

#: Pages of a document.
PAGES_OF_DOCUMENT = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.col("doc_id").alias("source_order"),
        F.concat("source", F.lit("."), "lang", F.when(F.col("doc_id") % 3 == 0, "").otherwise(".pdf")).alias("name"),
        F.when(F.col("doc_id") % 10 == 9, "text/plain").otherwise("application/pdf").alias("mime"),
        F.expr("CAST(1 + n_chars div 2000 AS int)").alias("num_pages"),
    )


SOURCES = """
    sources AS (
        SELECT doc_id::VARCHAR AS source_id, doc_id AS source_order,
               source || '.' || lang || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.pdf' END AS name,
               CASE WHEN doc_id % 10 = 9 THEN 'text/plain' ELSE 'application/pdf' END AS mime,
               (1 + n_chars // 2000)::INT AS num_pages
        FROM documents
    )"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each user, with the operations of all its events in order."""
    kind, n = F.col("event_type"), F.col("event_id")
    mode = F.element_at(F.array(*map(F.lit, ("color", "gray", "bw", "bw-otsu"))), (n % 4 + 1).cast("int"))
    op = (
        F.when(kind == "click", rotate_op(90))
        .when(kind == "purchase", split_op(F.when(n % 2 == 0, "left").otherwise("right")))
        .when(kind == "signup", color_mode_op(mode))
        .when(kind == "error", remove_shading_op())
        .otherwise(enhance_contrast_op())
    )
    log = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", op.alias("op")).alias("e"))
    ops = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["op"]).cast(OPS)
    paged = log.groupBy("user_id").agg(ops.alias("operations"))
    original = page_size(612, 792)
    return paged.select(
        F.expr(f"user_id div {PAGES_OF_DOCUMENT}").alias("document"),
        (F.col("user_id") % PAGES_OF_DOCUMENT).alias("position"),
        F.col("user_id").cast("string").alias("id"),
        F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("source_id"),
        F.col("user_id").cast("int").alias("source_page_index"),
        original.alias("original_size_pts"),
        effective_page_size(original, F.col("operations")).alias("page_size_pts"),
        "operations",
        (F.col("user_id") % 3 == 0).alias("selected"),
    )


def pages_sql() -> str:
    return f"""
    log AS (
        SELECT user_id, ts, event_id, {{
            'type': CASE event_type WHEN 'click' THEN 'rotate' WHEN 'purchase' THEN 'split' WHEN 'signup' THEN 'colorMode'
                    WHEN 'error' THEN 'removeShading' ELSE 'enhanceContrast' END,
            'degrees': CASE event_type WHEN 'click' THEN 90 END,
            'side': CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END END,
            'mode': CASE event_type WHEN 'signup' THEN (['color', 'gray', 'bw', 'bw-otsu'])[event_id % 4 + 1] END
        }} AS op FROM events
    ), paged AS (
        SELECT user_id, list(op ORDER BY ts, event_id) AS operations FROM log GROUP BY user_id
    ), pages0 AS (
        SELECT user_id // {PAGES_OF_DOCUMENT} AS document, user_id % {PAGES_OF_DOCUMENT} AS position, user_id::VARCHAR AS id,
               's' || (user_id % 7) AS source_id, user_id::INT AS source_page_index, operations, user_id % 3 = 0 AS selected
        FROM paged
    ), sized AS (
        SELECT *, {size_sql("612.0", "792.0")} AS size FROM pages0
    )"""


def size_sql(width: str, height: str, ops: str = "operations") -> str:
    """The size after all geometry: [width, height]."""
    start = f"{{'w': {width}::DOUBLE, 'h': {height}::DOUBLE, 'type': '', 'side': ''}}"
    steps = f"list_transform({ops}, lambda o: {{'w': 0::DOUBLE, 'h': 0::DOUBLE, 'type': o.type, 'side': o.side}})"
    return f"""list_reduce({steps}, lambda a, o: {{
            'w': CASE o.type WHEN 'rotate' THEN a.h WHEN 'split' THEN a.w / 2 ELSE a.w END,
            'h': CASE o.type WHEN 'rotate' THEN a.w ELSE a.h END, 'type': '', 'side': ''}}, {start})"""


def pixel_size_sql(width: str, height: str, ops: str = "operations") -> str:
    start = f"{{'w': {width}::BIGINT, 'h': {height}::BIGINT, 'type': '', 'side': ''}}"
    steps = f"list_transform({ops}, lambda o: {{'w': 0::BIGINT, 'h': 0::BIGINT, 'type': o.type, 'side': o.side}})"
    return f"""list_reduce({steps}, lambda a, o: {{
            'w': CASE o.type WHEN 'rotate' THEN a.h WHEN 'split' THEN CASE WHEN o.side = 'left' THEN a.w // 2 ELSE a.w - a.w // 2 END ELSE a.w END,
            'h': CASE o.type WHEN 'rotate' THEN a.w ELSE a.h END, 'type': '', 'side': ''}}, {start})"""


def ops_sql(ops: str = "operations") -> str:
    return f"array_to_string([concat_ws(':', o.type, o.degrees, o.side, o.mode) FOR o IN {ops}], '|')"


MODE = "coalesce(([o.mode FOR o IN operations IF o.type = 'colorMode'])[-1], 'color')"
LABEL = f"(CASE {MODE} WHEN 'bw' THEN 'bwprog' WHEN 'bw-otsu' THEN 'bw' WHEN 'gray' THEN 'gray' ELSE '' END)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 by 8 pixels of each vector; r, g and b are neighbouring values."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    value = lambda i: F.floor((F.get("embedding", F.pmod(i, F.lit(64))).cast("double") + 1) * 127.5).cast("int")
    spread = vectors.select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.expr("sequence(0, 63)")).alias("i"))
    i = F.col("i")
    return spread.select(
        "image_id", F.expr("i div 8").cast("int").alias("y"), (i % 8).alias("x"),
        value(i).alias("r"), value(i + 1).alias("g"), value(i + 2).alias("b"), F.lit(255).alias("a"),
    )


PIXELS = """
    spread AS (SELECT vec_id AS image_id, embedding AS e, unnest(range(64)) AS i FROM embeddings),
    pixels AS (
        SELECT image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, floor((e[i % 64 + 1]::DOUBLE + 1) * 127.5)::INT AS r,
               floor((e[(i + 1) % 64 + 1]::DOUBLE + 1) * 127.5)::INT AS g, floor((e[(i + 2) % 64 + 1]::DOUBLE + 1) * 127.5)::INT AS b
        FROM spread
    ), lum AS (
        SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS luma,
               floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE)::INT AS gray
        FROM pixels
    )"""


def scan_pdf(doc_id: int, pages: int) -> bytes:
    """A PDF of empty pages for a document, of 200 x (300 + doc_id % 5) points, each third page turned. The tree has a
    branch of ten pages each, from which pages inherit their box; every other file keeps its objects in an object stream."""
    import zlib

    branches = -(-pages // 10)
    bodies = {1: "<< /Type /Catalog /Pages 2 0 R >>"}
    bodies[2] = f"<< /Type /Pages /Count {pages} /Kids [{' '.join(f'{3 + b} 0 R' for b in range(branches))}] >>"
    for b in range(branches):
        own = range(10 * b, min(10 * b + 10, pages))
        kids = " ".join(f"{3 + branches + i} 0 R" for i in own)
        bodies[3 + b] = f"<< /Type /Pages /Parent 2 0 R /Count {len(own)} /Kids [{kids}] /MediaBox [0 0 200 {300 + doc_id % 5}] >>"
        for i in own:
            bodies[3 + branches + i] = f"<< /Type /Page /Parent {3 + b} 0 R {'/Rotate 90' if i % 3 == 2 else ''} >>"
    if doc_id % 2:
        plain = "".join(f"{n} 0 obj\n{x}\nendobj\n" for n, x in bodies.items())
        return f"%PDF-1.4\n{plain}trailer\n<< /Root 1 0 R >>\n%%EOF\n".encode()
    starts, at = [], 0
    for x in bodies.values():
        starts.append(at)
        at += len(x) + 1
    index = " ".join(f"{n} {a}" for n, a in zip(bodies, starts, strict=True)) + " "
    packed = zlib.compress((index + " ".join(bodies.values())).encode())
    number = len(bodies) + 1
    head = f"/Type /ObjStm /N {len(bodies)} /First {len(index)} /Filter /FlateDecode /Length {len(packed)}"
    tail = f"\nendstream\nendobj\n{number + 1} 0 obj\n<< /Type /XRef /Root 1 0 R /Length 1 >>\nstream\nx\nendstream\nendobj\n%%EOF\n"
    return f"%PDF-1.5\n{number} 0 obj\n<< {head} >>\nstream\n".encode() + packed + tail.encode()


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of a PDF for each document, in seven folders; some files are called otherwise."""

    @F.pandas_udf("binary")
    def pdf(doc_id, pages):
        import pandas as pd

        return pd.Series([scan_pdf(d, n) for d, n in zip(doc_id, pages, strict=True)])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("CAST(1 + n_chars div 2000 AS int)").alias("pages"))
    end = F.when(F.col("doc_id") % 11 == 0, ".txt").when(F.col("doc_id") % 4 == 0, ".PDF").otherwise(".pdf")
    folder, name = F.concat(F.lit("/scans/f"), F.col("doc_id") % 7), F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), end)
    return docs.select(F.concat_ws("/", folder, name).alias("path"), pdf("doc_id", "pages").alias("content"))


SCANS = """
    named AS (
        SELECT doc_id, (1 + n_chars // 2000)::INT AS num_pages, doc_id % 7 AS folder,
               lpad(doc_id::VARCHAR, 12, '0') || CASE WHEN doc_id % 4 = 0 THEN '.PDF' ELSE '.pdf' END AS name
        FROM documents WHERE doc_id % 11 <> 0
    ), scans AS (
        SELECT *, row_number() OVER (ORDER BY folder, name) - 1 AS source_order FROM named
    )"""
