"""Files in and out: order and sizes of scans, codecs against other readers, and pages from a PDF to a PDF."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import catalog
from quire.raster import executor, kernels
from quire.schema import OPS
from quire.sources import documents, files, jpeg, pdf, png
from tests.test_raster import image, packed_pdf


def scan(sizes, value=120):
    """A PDF whose pages are gray images of one pixel a point."""
    pages = [np.full((h, w, 4), value, np.uint8) for w, h in sizes]
    return pdf.pdf_of([(png.encode_rgb(p), "image/png", p.shape[1], p.shape[0], float(p.shape[1]), float(p.shape[0])) for p in pages])


def test_files_come_in_the_order_given_and_folders_by_name(spark, tmp_path):
    for folder, names in (("b", ["ch10", "ch2"]), ("a", [f"ch{i}" for i in range(6)]), ("a/inner", ["x"])):
        (tmp_path / folder).mkdir(exist_ok=True, parents=True)
        for n in names:
            (tmp_path / folder / f"{n}.pdf").write_bytes(scan([(100, 200)]))
    (tmp_path / "a" / "note.txt").write_bytes(b"x")
    names = lambda *paths: [r["name"] for r in documents.scan_sources(spark, list(paths)).orderBy("source_order").collect()]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    chapters = [f"ch{i}.pdf" for i in range(6)]
    assert names(a) == [*chapters, "x.pdf"]
    assert names(b, a) == ["ch10.pdf", "ch2.pdf", *chapters, "x.pdf"]
    assert names(f"{a}/ch5.pdf", f"{b}/*.pdf", f"{a}/ch0.pdf") == ["ch5.pdf", "ch10.pdf", "ch2.pdf", "ch0.pdf"]
    twice = documents.scan_sources(spark, [f"{a}/ch1.pdf", f"{a}/ch0.pdf", f"{a}/ch1.pdf"]).orderBy("source_order").collect()
    assert [(r["source_order"], r["name"]) for r in twice] == [(0, "ch1.pdf"), (1, "ch0.pdf"), (2, "ch1.pdf")]
    assert len({r["source_id"] for r in twice}) == 3
    held = documents.scan_sources(spark, b, keep_content=True).orderBy("source_order").collect()
    assert [bytes(r["content"]) for r in held] == [scan([(100, 200)])] * 2


def test_pages_have_the_sizes_of_their_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(scan([(100, 200), (30, 40)]))
    (tmp_path / "b.pdf").write_bytes(scan([(7, 5)]))
    pages = catalog.expand_pages(documents.scan_sources(spark, str(tmp_path))).orderBy("position").collect()
    assert [(r["position"], r["source_page_index"], *r["page_size_pts"]) for r in pages] == [(0, 0, 100, 200), (1, 1, 30, 40), (2, 0, 7, 5)]


def test_boxes_are_inherited_cropped_and_turned():
    tree = {
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Count 6 /MediaBox [0 0 100 200] /Kids [3 0 R 4 0 R 5 0 R] >>",
        3: "<< /Type /Pages /Count 3 /Rotate 90 /Kids [6 0 R 7 0 R 8 0 R] >>", 4: "<< /Type /Page /MediaBox [10 20 5 0] >>",
        5: "<< /Type /Pages /Count 2 /Kids 12 0 R /CropBox [50 -10 400 90] >>", 6: "<< /Type /Page >>", 7: "<< /Type /Page /Rotate 180 >>",
        8: "<< /Type /Page /Rotate -90 /MediaBox 9 0 R >>", 9: "[0 0 11 0 R 8.5]", 10: "<< /Type /Page /Title (a ) \\\\) b (/Kids [1]) ) >>", 11: "4",
        12: "[10 0 R 13 0 R]", 13: "<< /Type /Page /CropBox [500 500 600 600] /Rotate 0 >>",
    }
    wanted = [(200, 100), (100, 200), (8.5, 4), (5, 20), (50, 90), (100, 200)]
    plain = "%PDF-1.4\n" + "".join(f"{n} 0 obj\n{x}\nendobj\n" for n, x in tree.items()) + "trailer\n<< /Root 1 0 R >>\n%%EOF"
    assert pdf.page_sizes(plain.encode()) == wanted and pdf.page_sizes(packed_pdf(tree)) == wanted
    loop = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [2 0 R 3 0 R] >>", 3: "<< /Type /Page >>"}
    assert pdf.page_sizes(packed_pdf(loop)) == [(612.0, 792.0)] * len(pdf.page_sizes(packed_pdf(loop)))
    assert pdf.page_sizes(b"") == [] and pdf.page_sizes(b"%PDF-1.4 1 0 obj << /Type /Page >> endobj") == [(612.0, 792.0)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_no_bytes_break_the_scan(data):
    pdf.page_sizes(data)
    pdf.page_sizes(b"%PDF 1 0 obj <<" + data + b" /Type /Page >> endobj trailer << /Root 1 0 R >>")


def test_files_that_cannot_be_read_are_no_empty_files(spark, tmp_path):
    tree = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: "<< /Type /Page >>"}
    (tmp_path / "a.pdf").write_bytes(packed_pdf(tree, flate=False))
    (tmp_path / "b.pdf").write_bytes(scan([(5, 5)]))
    sources = documents.scan_sources(spark, str(tmp_path))
    assert [r["num_pages"] for r in sources.orderBy("source_order").collect()] == [None, 1]
    with pytest.raises(Exception, match="cannot read the pages"):
        catalog.expand_pages(sources).collect()
    assert catalog.expand_pages(sources, unreadable="skip").count() == 1


def test_sources_of_a_table(spark):
    rows = [("/x/b.pdf", scan([(5, 5)])), ("/x/a.PDF", None), ("/w/z.pdf", b""), ("/x/a.doc", b"")]
    out = documents.sources_of(spark.createDataFrame(rows, "path string, content binary")).orderBy("source_order").collect()
    assert [(r["source_order"], r["name"], r["num_pages"]) for r in out] == [(0, "z.pdf", 0), (1, "a.PDF", None), (2, "b.pdf", 1)]


def read_by_java(spark, data):
    """height x width x 3 by the JVM's own reader."""
    jvm = spark.sparkContext._jvm
    found = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    h, w = found.getHeight(), found.getWidth()
    rgb = np.array([found.getRGB(x, y) for y in range(h) for x in range(w)], np.int64).reshape(h, w)
    return np.stack([(rgb >> s) & 255 for s in (16, 8, 0)], -1).astype(np.uint8)


def smooth(h, w):
    y, x = np.mgrid[0:h, 0:w]
    out = np.stack([np.sin(x / 9) * 100 + 128, y * 255 / h, (x + y) % 200, np.full((h, w), 255)], -1)
    return out.astype(np.uint8)


@pytest.mark.parametrize("h, w, quality", [(16, 16, 0.9), (37, 21, 0.5), (8, 40, 0.75), (1, 1, 0.85), (33, 50, 1.0)])
def test_jpeg_against_another_reader(spark, h, w, quality):
    for img in (smooth(h, w), image(h, w, 3), np.full((h, w, 4), 200, np.uint8)):
        data = jpeg.encode(img, quality)
        own, other = jpeg.decode(data).astype(int), read_by_java(spark, data).astype(int)
        # Readers put small chroma planes back in different ways, which noise shows; luma they must agree on.
        assert own.shape == (h, w, 3) and np.abs((own - other) @ (0.299, 0.587, 0.114)).mean() < 4
        assert img[..., :3].std() > 60 or np.abs(own - img[..., :3]).mean() < 12
    gray = np.repeat(smooth(h, w)[..., :1], 4, 2)
    data = jpeg.encode(gray, quality)
    assert np.abs(jpeg.decode(data).astype(int) - read_by_java(spark, data)).max() <= 3
    assert np.abs(jpeg.decode(data).astype(int) - gray[..., :3]).mean() < 6


def test_jpeg_of_another_writer(spark):
    jvm, img = spark.sparkContext._jvm, smooth(40, 29)
    held = jvm.java.awt.image.BufferedImage(29, 40, 1)
    for y in range(40):
        for x in range(29):
            held.setRGB(x, y, int(img[y, x, 0]) << 16 | int(img[y, x, 1]) << 8 | int(img[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(held, "jpg", out)
    data = bytes(out.toByteArray())
    assert np.abs(jpeg.decode(data).astype(int) - read_by_java(spark, data)).mean() < 4
    for broken in (b"", b"no", data[: len(data) // 3], b"\xff\xd8\xff\xc2" + struct.pack(">H", 17) + bytes(15)):
        with pytest.raises((ValueError, IndexError, struct.error)):
            jpeg.decode(broken)


def test_quality_sets_the_size():
    sizes = [len(jpeg.encode(image(64, 64, 1), q)) for q in (0.3, 0.5, 0.85)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[2] / 2


def plain_unfiltered(raw, step):
    out = []
    for kind, *line in raw.tolist():
        before = out[-1] if out else [0] * len(line)
        own = []
        for i, v in enumerate(line):
            left, up = own[i - step] if i >= step else 0, before[i]
            corner = before[i - step] if i >= step else 0
            guess = left + up - corner
            a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
            paeth = left if a <= b and a <= c else up if b <= c else corner
            own.append((v + (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        out.append(own)
    return np.array(out, np.uint8).reshape(len(raw), -1)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3, 4]), st.integers(0, 99), st.integers(3, 5))
def test_png_filters(h, w, step, seed, kinds):
    rng = np.random.default_rng(seed)
    raw = rng.integers(0, 256, (h, 1 + w * step)).astype(np.uint8)
    raw[:, 0] = rng.integers(0, kinds, h)
    assert np.array_equal(png.unfiltered(raw, step), plain_unfiltered(raw, step))


def test_png_of_a_page_in_time():
    import time

    raw = np.random.default_rng(1).integers(0, 256, (800, 1 + 600 * 3)).astype(np.uint8)
    raw[:, 0] = 4
    began = time.process_time()
    png.unfiltered(raw, 3)
    assert time.process_time() - began < 2


def test_blur_against_direct_sums():
    img = image(9, 7, 5)
    for radius in (0.4, 1.5):
        half = max(1, int(np.ceil(3 * radius)))
        wanted = np.zeros((9, 7, 3))
        for y in range(9):
            for x in range(7):
                near = [(j, i, np.exp(-((j - y) ** 2 + (i - x) ** 2) / (2 * radius**2))) for j in range(max(0, y - half), min(9, y + half + 1)) for i in range(max(0, x - half), min(7, x + half + 1))]
                wanted[y, x] = sum(w * img[j, i, :3].astype(float) for j, i, w in near) / sum(w for *_, w in near)
        out = kernels.blur(img, radius)
        assert np.abs(out[..., :3] - wanted).max() <= 0.5 + 1e-9 and np.array_equal(out[..., 3], img[..., 3])


def test_shading_against_direct_sums():
    img = image(12, 10, 6, 60, 200)
    for out, radius in ((kernels.remove_shading(img, 3), 3), (kernels.remove_shading_preview(img, 10 * 72 / 300 * 5), max(2, 4))):
        blurred = kernels.blur(img, radius)
        luma = lambda a: 0.299 * a[..., 0] + 0.587 * a[..., 1] + 0.114 * a[..., 2]
        wanted = np.clip(255 + (luma(img.astype(float)) - luma(blurred.astype(float))) * 1.2, 0, 255)
        assert np.abs(out[..., 0] - wanted).max() <= 0.5 + 1e-9 and np.array_equal(out[..., 0], out[..., 2])


def test_scaled_by_areas_and_by_nearest_pixels():
    img = image(6, 9, 7)
    half = kernels.scaled(img, 3, 2)
    wanted = img.reshape(2, 3, 3, 3, 4).astype(float).mean((1, 3))
    assert np.abs(half - wanted).max() <= 0.5
    near = kernels.scaled(img, 3, 3, smooth=False)
    assert np.array_equal(near, img[::2, ::3])
    clear = img.copy()
    clear[..., 3] = 0
    assert (kernels.scaled(clear, 3, 2, fill_white=True) == 255).all()


def test_results_by_index_are_in_order(spark):
    rows = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "index int, v int").repartition(7)
    assert [r["index"] for r in catalog.by_index(rows).collect()] == sorted(i * 7 % 50 for i in range(50))


def _catalogue(spark, folder):
    sources = documents.scan_sources(spark, folder, keep_content=True)
    return sources, documents.original_pages(catalog.expand_pages(sources))


def test_from_a_pdf_to_a_pdf(spark, tmp_path):
    first, second = image(60, 40, 1), image(30, 50, 2)
    made = pdf.pdf_of([(png.encode_rgb(x), "image/png", x.shape[1], x.shape[0], float(x.shape[1]), float(x.shape[0])) for x in (first, second)])
    (tmp_path / "in.pdf").write_bytes(made)
    sources, pages = _catalogue(spark, str(tmp_path))
    ops = F.from_json(F.lit('[{"type": "rotate", "degrees": 90}, {"type": "colorMode", "mode": "bw-otsu"}]'), OPS)
    gray = F.col("operations")
    turned = pages.withColumn("operations", F.when(F.col("position") == 0, ops).otherwise(gray))
    encode = lambda img, mode, quality: png.encode(img, mode)
    row = documents.exported(turned, sources, "high", encode=encode).first()
    data = bytes(row["content"])
    assert pdf.page_sizes(data) == [(60.0, 40.0), (50.0, 30.0)] and not row["ocr_used"]
    dpi = {0: 150, 1: 120}
    for i, (img, mode) in enumerate(((first, "bw-otsu"), (second, "gray"))):
        raster = pdf.render_scan(made, i, dpi[i])
        assert raster.shape[:2] == tuple(int(np.floor(n * dpi[i] / 72 + 0.5)) for n in img.shape[:2])
        wanted = kernels.apply_mode(kernels.rotate90(raster) if i == 0 else raster, mode)
        assert np.array_equal(pdf.page_image(data, i)[0][..., :3], wanted[..., :3])
    by_jpeg = bytes(documents.exported(turned, sources, "low", engine=lambda content, lang: f"found {lang}").first()["content"])
    assert pdf.page_sizes(by_jpeg) == [(60.0, 40.0), (50.0, 30.0)] and b"DCTDecode" in by_jpeg
    assert pdf.page_image(by_jpeg, 1)[0].shape[:2] == tuple(int(np.floor(n * 200 / 72 + 0.5)) for n in (30, 50))
    streams = [zlib.decompress(by_jpeg[a:b]) for n, (a, b) in pdf.Pdf(by_jpeg).streams.items() if b"/Subtype" not in pdf.Pdf(by_jpeg).bodies[n]]
    assert sum("found eng".encode().hex().encode() in x for x in streams) == 2


def test_one_page_from_file_to_image(spark, tmp_path):
    (tmp_path / "in.pdf").write_bytes(scan([(24, 12)]))
    sources, pages = _catalogue(spark, str(tmp_path))
    row = documents.processed(pages, sources).first()
    assert (row["width"], row["height"], row["mime_type"]) == (100, 50, "image/png")
    assert (png.decode(bytes(row["content"]))[..., :3] == 120).all()


def test_images_are_prepared_by_mode_and_compression(spark):
    img, first = image(100, 80, 3), image(100, 80, 4)
    rows = [(mode, mode, (20.0, 25.0), 80, 100, img.tobytes(), first.tobytes()) for mode in ("color", "gray", "bw", "bw-otsu")]
    schema = "id string, mode string, page_size_pts struct<width:double,height:double>, width int, height int, data binary, original binary"
    images = spark.createDataFrame(rows, schema)

    def raw(image, quality):
        return bytes([round(100 * quality)]) + image.tobytes()

    plain = {r["id"]: r for r in executor.prepared(images, "none", 0.85, raw).collect()}
    decoded = {k: png.decode(bytes(r["content"])) for k, r in plain.items()}
    assert {r["mime_type"] for r in plain.values()} == {"image/png"}
    assert np.array_equal(decoded["color"], first) and np.array_equal(decoded["gray"], img)
    assert np.array_equal(decoded["bw"], kernels.adaptive_gaussian(img)) and np.array_equal(decoded["bw-otsu"], kernels.otsu(img))
    small = {r["id"]: r for r in executor.prepared(images, "high", 0.5, raw).collect()}
    for mode, r in small.items():
        scaled = kernels.scaled(img, r["width"], r["height"], mode != "color", mode != "bw")
        assert (r["width"], r["height"]) != (80, 100)
        if mode in ("color", "gray"):
            wanted = kernels.blur(kernels.grayscale(scaled), 0.4) if mode == "gray" else scaled
            assert r["mime_type"] == "image/jpeg" and bytes(r["content"]) == raw(wanted, 0.5)
        else:
            assert np.array_equal(png.decode(bytes(r["content"])), kernels.apply_mode(scaled, mode))


def test_files_are_written_by_tasks(spark, tmp_path):
    img = image(4, 5)
    rows = [(f"page_{i}.png", 5, 4, img.tobytes()) for i in range(7)]
    made = documents.png_files(spark.createDataFrame(rows, "name string, width int, height int, data binary").repartition(3))
    assert {r["mime_type"] for r in made.collect()} == {"image/png"}
    for _ in range(2):
        written = {r["name"]: r["bytes"] for r in files.write_files(made.union(made.limit(0)), str(tmp_path / "out")).collect()}
    assert written == {f"page_{i}.png": len(png.encode_rgb(img)) for i in range(7)}
    assert np.array_equal(png.decode((tmp_path / "out" / "page_3.png").read_bytes()), img)
    escaping = spark.createDataFrame([("../../x/evil.png", b"1")], "name string, content binary")
    files.write_files(escaping, str(tmp_path / "in"))
    assert (tmp_path / "in" / "evil.png").exists() and not (tmp_path.parent / "x").exists()
