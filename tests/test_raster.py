import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.raster import executor, kernels
from quire.raster import pixels as X
from quire.sources import documents, png


def image(h, w, seed=0, low=0, high=256):
    rng = np.random.default_rng(seed)
    out = rng.integers(low, high, (h, w, 4)).astype(np.uint8)
    out[..., 3] = 255
    return out


def rows(spark, *images):
    found = [
        (i, y, x, *map(int, img[y, x])) for i, img in enumerate(images) for y in range(img.shape[0]) for x in range(img.shape[1])
    ]
    return spark.createDataFrame(found, "image_id long, y int, x int, r int, g int, b int, a int")


def arrays(df, n):
    found = df.toPandas()
    out = []
    for i in range(n):
        own = found[found.image_id == i]
        img = np.zeros((own.y.max() + 1, own.x.max() + 1, 4), np.uint8)
        img[own.y, own.x] = own[["r", "g", "b", "a"]]
        out.append(img)
    return out


IMAGES = image(6, 9), image(7, 4, 1, 90, 110), np.full((3, 3, 4), 77, np.uint8), image(1, 20, 2)


@pytest.mark.parametrize(
    "by_rows, by_array",
    [
        (X.grayscale, kernels.grayscale),
        (lambda p: X.posterize(p, 5), lambda a: kernels.posterize(a, 5)),
        (X.threshold, kernels.threshold),
        (X.quantized, kernels.quantize_bw),
        (X.otsu, kernels.otsu),
        (lambda p: X.otsu(p, 0), lambda a: kernels.otsu(a, 0)),
        (X.contrast, kernels.contrast),
        (lambda p: X.contrast(p, True), lambda a: kernels.contrast(a, True)),
        (lambda p: X.adaptive_box(p, 5, 3), lambda a: kernels.adaptive_box(a, 5, 3)),
        (X.rotate90, kernels.rotate90),
        (lambda p: X.crop_half(p, "left"), lambda a: kernels.crop_half(a, "left")),
        (lambda p: X.crop_half(p, "right"), lambda a: kernels.crop_half(a, "right")),
    ],
)
def test_rows_and_arrays_agree(spark, by_rows, by_array):
    for found, img in zip(arrays(by_rows(rows(spark, *IMAGES)), len(IMAGES)), IMAGES, strict=True):
        assert np.array_equal(found, by_array(img))


def test_packed_bits(spark):
    row = np.zeros((1, 20, 4), np.uint8)
    row[0, ::3] = 255
    assert kernels.packed_bits(row).tolist() == [[146, 73, 32]]
    found = X.packed_bits(rows(spark, row)).orderBy("byte_index").collect()
    assert [r["value"] for r in found] == [146, 73, 32]


def test_integral(spark):
    total = X.integral(rows(spark, IMAGES[0])).orderBy("y", "x").toPandas().total.to_numpy().reshape(6, 9)
    assert np.array_equal(total, kernels.gray(IMAGES[0]).cumsum(0).cumsum(1))


def test_flat_images():
    flat = np.full((4, 4, 4), 77, np.uint8)
    flat[..., 0] = 10
    assert np.array_equal(kernels.contrast(flat, preview=True), flat)
    assert (kernels.contrast(flat)[..., :3] == 57).all()
    assert kernels.otsu_threshold(flat) == 128 and kernels.otsu_threshold(flat, 0) == 0


def test_shading_of_an_even_page_is_white():
    assert (kernels.remove_shading(np.full((30, 40, 4), 200, np.uint8))[..., :3] == 255).all()
    assert (kernels.remove_shading_preview(np.full((30, 40, 4), 200, np.uint8), 612)[..., :3] == 255).all()


def test_gaussian_threshold_against_direct_sums():
    img = image(20, 17, 3)
    g, w = kernels.gray(img), kernels.gaussian(0.3 * ((15 - 1) / 2 - 1) + 0.8, 7)
    padded = np.pad(g, 7, mode="edge")
    mean = np.array([[(padded[y : y + 15, x : x + 15] * np.outer(w, w)).sum() for x in range(17)] for y in range(20)])
    wanted = np.where(g > np.floor(mean + 0.5) - 6, 255, 0)
    assert (kernels.adaptive_gaussian(img, 15, 6)[..., 0] != wanted).mean() < 0.01


def test_options():
    assert [kernels.bw_options(n, 9999) for n in (1000, 2000, 100)] == [(21, 6), (41, 8), (15, 6)]
    assert kernels.preview_block(300, 612) == (5, 2)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(2, 12), st.integers(0, 99))
def test_geometry(h, w, seed):
    img = image(h, w, seed)
    turned = img
    for _ in range(4):
        turned = kernels.rotate90(turned)
    assert np.array_equal(turned, img)
    assert np.array_equal(kernels.rotate90(img)[0, h - 1], img[0, 0])
    halves = kernels.crop_half(img, "left"), kernels.crop_half(img, "right")
    assert np.array_equal(np.concatenate(halves, 1), img)
    assert np.array_equal(png.decode(png.encode_rgb(img)), img)
    assert np.array_equal(png.decode(png.encode_bw(img))[..., 0] > 127, img[..., 0] > 127)
    assert kernels.scaled(img, 5, 4).shape == (4, 5, 4) and kernels.scaled(img, 5, 4, True, False).shape == (4, 5, 4)


def test_operations_go_in_canonical_order():
    img = image(6, 10)
    ops = [{"type": "enhanceContrast"}, {"type": "colorMode", "mode": "bw"}, {"type": "split", "side": "right"},
           {"type": "rotate", "degrees": 90}, {"type": "colorMode", "mode": "gray"}]
    wanted = kernels.contrast(kernels.grayscale(kernels.rotate90(kernels.crop_half(img, "right"))))
    assert np.array_equal(executor.apply_operations(img, ops), wanted)


def test_modes():
    img = image(30, 30)
    assert np.array_equal(kernels.apply_mode(img, "color"), img)
    for mode in ("gray", "bw", "bw-otsu"):
        out = kernels.apply_mode(img, mode)
        assert np.array_equal(out[..., 0], out[..., 1]) and (mode == "gray" or set(np.unique(out[..., 0])) <= {0, 255})


def _pages(spark, n=3):
    from quire.schema import OPS

    ops = [("rotate", 90, None, None), ("colorMode", None, None, "bw-otsu")]
    found = [(0, i, f"p{i}", ops, "bw-otsu", 612.0, 8, 6, image(6, 8, i).tobytes()) for i in range(n)]
    schema = f"document long, position long, id string, operations {OPS}, mode string, width_pts double, width int, height int, data binary"
    return spark.createDataFrame(found, schema)


def test_render_and_assemble(spark, tmp_path):
    out = executor.render(_pages(spark), png.encode)
    for r in out.collect():
        wanted = kernels.otsu(kernels.rotate90(image(6, 8, r["position"])))
        assert np.array_equal(png.decode(bytes(r["content"])), wanted) and (r["width"], r["height"]) == (6, 8)
    whole = documents.assembled(out.withColumns({"width_pts": F.lit(60.0), "height_pts": F.lit(80.0)}))
    names = spark.createDataFrame([(0, "book_gray.pdf")], "document long, name string")
    (written,) = documents.save(whole, names, str(tmp_path / "out")).collect()
    path = tmp_path / "out" / written["name"]
    with open(path, "rb") as f:
        data = f.read()
    assert data.startswith(b"%PDF") and documents.page_count(data) == 3
    found = documents.scan_sources(spark, str(tmp_path / "out"), True).collect()
    assert [(r["name"], r["num_pages"]) for r in found] == [("book_gray.pdf", 3)]


def packed_pdf(objects, head="", flate=True):
    """A PDF whose objects, by number, lie in an object stream, with a cross-reference stream."""
    bodies = [x.encode() for x in objects.values()]
    starts = [sum(len(x) + 1 for x in bodies[:i]) for i in range(len(bodies))]
    index = " ".join(f"{n} {at}" for n, at in zip(objects, starts, strict=True)).encode() + b" "
    data = zlib.compress(index + b" ".join(bodies)) if flate else b"\x00encrypted"
    stream = f"90 0 obj\n<< /Type /ObjStm /N {len(bodies)} /First {len(index)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n"
    return f"%PDF-1.5\n{head}".encode() + stream.encode() + data + (
        b"\nendstream\nendobj\n91 0 obj\n<< /Type /XRef /Root 1 0 R /Length 1 >>\nstream\nx\nendstream\nendobj\nstartxref\n9\n%%EOF\n"
    )


def test_page_counts_of_packed_and_nested_page_trees():
    tree = {
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R 4 0 R] /Resources << /Font << /F 9 0 R >> >> /Count 5 >>",
        3: "<< /Type /Pages /Parent 2 0 R /Kids [] /Count 3 >>", 4: "<< /Type /Pages /Parent 2 0 R /Kids [] /Count 2 >>",
    }
    plain = "%PDF-1.4\n" + "".join(f"{n} 0 obj\n{x}\nendobj\n" for n, x in tree.items()) + "trailer\n<< /Root 1 0 R >>\n%%EOF"
    assert documents.page_count(plain.encode()) == 5
    assert documents.page_count(packed_pdf(tree)) == 5
    assert documents.page_count(packed_pdf(tree | {2: "<< /Type /Pages /Kids [] /Count 8 0 R >>", 8: "7"})) == 7
    assert documents.page_count(packed_pdf(tree, flate=False)) is None
    assert documents.page_count(b"%PDF-1.4\n") == 0


def test_thumbnails(spark):
    small = executor.thumbnails(_pages(spark, 2), png.encode, 4).collect()
    assert {(r["width"], r["height"]) for r in small} == {(3, 4)}


def test_files_of_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png.encode_rgb(image(3, 5)))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    row = documents.decode_images(files).first()
    assert (row["width"], row["height"], bytes(row["data"])) == (5, 3, image(3, 5).tobytes())


def test_pages_that_are_no_image_need_a_renderer(spark):
    with pytest.raises(ValueError, match="renderer"):
        documents.render_scan(documents.pdf_of([]) .replace(b"/Kids []", b"/Kids [3 0 R]"), 0, 72)
    assert documents.recognised_text(None, None) is None
    assert png.encode_as_saved(image(2, 2), "bw", 0.5)[1] == "image/png" and png.encode_as_saved(image(2, 2), "gray", 0.5)[1] == "image/jpeg"


def test_plugged_in_renderer_and_ocr(spark):
    pages = spark.createDataFrame([("s", 1, 144)], "source_id string, source_page_index int, target_dpi int")
    sources = spark.createDataFrame([("s", b"%PDF")], "source_id string, content binary")
    draw = lambda content, index, dpi, most: documents.blank(dpi, index)
    row = documents.rasterize(pages, sources, draw).first()
    assert (row["width"], row["height"]) == (144, 1)
    rendered = spark.createDataFrame([(0, 4, b"x")], "document long, position long, content binary")
    row = documents.recognised_text(rendered, lambda content, lang: lang + content.decode(), "eng+deu").first()
    assert (row["image_name"], row["text"]) == ("page_0005.png", "eng+deux")


def test_streamed_sources(spark, tmp_path):
    from quire.streaming import watched_sources

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(documents.pdf_of([]))
    (folder / "b.txt").write_bytes(b"no")
    q = watched_sources(spark, str(folder)).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["name"], r["num_pages"]) for r in spark.table("seen").collect()] == [("a.pdf", 0)]
