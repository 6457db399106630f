import pytest
from pyspark.sql import functions as F

from quire.functions import pages as P
from quire.functions import strings as S
from quire.operators import catalog, edits, history, lookups, summaries
from quire.schema import PAGES, color_mode_op, no_ops, page_size, rotate_op, split_op

ROTATE, LEFT, RIGHT = ("rotate", 90, None, None), ("split", None, "left", None), ("split", None, "right", None)
SHADING = ("removeShading", None, None, None)


def mode(m):
    return ("colorMode", None, None, m)


def pages(spark, *rows):
    """rows: (id, operations, selected)."""
    full = [(0, i, id_, "s", i, (10.0, 20.0), list(ops), on) for i, (id_, ops, on) in enumerate(rows)]
    return spark.createDataFrame(full, PAGES)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name, stem", [("a.b.pdf", "a.b"), (".pdf", ".pdf"), ("noext", "noext"), ("", "file"), (None, "file"), ("x\ny.pdf", "x\ny")])
def test_stem(spark, name, stem):
    assert one(spark, S.file_stem(F.lit(name).cast("string"))) == stem


@pytest.mark.parametrize("value, part", [("__my: file  name?..", "my-file-name"), ("???", "file"), (None, "file"), ("a" * 39 + " b", "a" * 39 + "-")])
def test_sanitised_part(spark, value, part):
    assert one(spark, S.sanitize_filename_part(F.lit(value).cast("string"))) == part


def test_names(spark):
    name = lambda *x: one(spark, S.output_filename(*map(F.lit, x)))
    assert name("book", "high", "gray", True) == "book_highcomp_gray_ocr.pdf"
    assert name("merged", "none", "", False) == "merged.pdf"
    assert one(spark, S.ocr_image_name(F.lit(12345))) == "page_12345.png"
    assert one(spark, S.ocr_image_name(F.lit(7))) == "page_0007.png"
    assert [one(spark, S.counted(F.lit(n))) for n in (0, 1, 2)] == ["0 pages", "1 page", "2 pages"]
    assert one(spark, S.source_id(F.lit("a.pdf"), F.lit(3))) == one(spark, S.source_id(F.lit("a.pdf"), F.lit(3)))


def test_size_is_folded_in_order(spark):
    size = lambda s, *ops: tuple(one(spark, P.effective_page_size(page_size(*s), F.array(*ops))))
    assert size((612, 792), rotate_op(), split_op("left")) == (396, 612)
    assert size((10, 20), split_op("left"), rotate_op()) == (20, 5)
    assert size((10, 20), rotate_op(180)) == (10, 20)
    assert size((10, 20), rotate_op(-90)) == (20, 10)
    px = one(spark, P.effective_pixel_size(F.lit(5), F.lit(8), F.array(split_op("right"))))
    assert tuple(px) == (3, 8)


def test_modes_and_numbers(spark):
    assert one(spark, P.effective_color_mode(F.array(color_mode_op("gray"), color_mode_op("bw")))) == "bw"
    assert one(spark, P.effective_color_mode(no_ops())) == "color"
    assert one(spark, P.total_rotation(F.array(rotate_op(270), rotate_op(180)))) == 90
    assert [one(spark, P.normalize_odd(F.lit(x).cast("double"), 31)) for x in (None, 2.9, 4.0, 5.0, float("nan"))] == [31, 3, 5, 5, 31]
    assert [tuple(one(spark, P.bw_options(F.lit(n), F.lit(5000)))) for n in (1000, 2000, 100, 9000)] == [(21, 6), (41, 8), (15, 6), (75, 15)]
    assert [one(spark, P.jpeg_quality(F.lit(x))) for x in ("none", "low", "medium", "high")] == [0.85, 0.75, 0.6, 0.5]


def test_dpi(spark):
    rows = spark.createDataFrame([("bw-otsu", "high"), ("gray", "low"), ("color", "low"), ("gray", "?")], "m string, c string")
    new = {r["m"] + r["c"]: r["target_dpi"] for r in lookups.with_target_dpi(rows, F.col("m"), F.col("c")).collect()}
    assert new == {"bw-otsuhigh": 150, "graylow": 200, "colorlow": 180, "gray?": 150}
    old = lookups.with_target_dpi(rows, F.col("m"), F.col("c"), lookups.family_by_name).filter("m = 'bw-otsu'").first()
    assert old["target_dpi"] == 120


def test_split_stands_side_by_side(spark):
    out = edits.split_selected(pages(spark, ("a", [], False), ("b", [], True), ("c", [], None))).orderBy("position").collect()
    assert [(r["id"], r["selected"], r["page_size_pts"]["width"]) for r in out] == [
        ("a", False, 10.0), ("b_left", False, 5.0), ("b_right", False, 5.0), ("c", None, 10.0),
    ]
    assert [r["position"] for r in out] == [0, 1, 2, 3]


def test_four_turns_are_none(spark):
    own = pages(spark, ("a", [], True))
    out = own
    for _ in range(4):
        out = edits.rotate_selected(out)
    row = out.select("page_size_pts", P.total_rotation(F.col("operations")).alias("r")).first()
    assert (tuple(row["page_size_pts"]), row["r"]) == ((10.0, 20.0), 0)


def test_edits_happen_once(spark):
    own = pages(spark, ("a", [SHADING, mode("gray")], True), ("b", [mode("bw")], False))
    assert edits.remove_shading_selected(own).exceptAll(own).count() == 0
    twice = edits.enhance_contrast_selected(edits.enhance_contrast_selected(own)).filter("id = 'a'").first()["operations"]
    assert [o["type"] for o in twice] == ["removeShading", "colorMode", "enhanceContrast"]
    colored = edits.color_mode_selected(own, "color").orderBy("position").collect()
    assert [len(r["operations"]) for r in colored] == [1, 1]
    with pytest.raises(ValueError):
        edits.color_mode_selected(own, "sepia")


def test_delete_and_reorder(spark):
    own = pages(spark, ("a", [], False), ("b", [], True), ("c", [], False))
    assert [(r["id"], r["position"]) for r in edits.delete_selected(own).orderBy("position").collect()] == [("a", 0), ("c", 1)]
    order = spark.createDataFrame([("c", 0), ("b", 1)], "id string, rank int")
    assert [r["id"] for r in catalog.reordered(own, order).orderBy("position").collect()] == ["c", "b", "a"]


def test_selection(spark):
    own = pages(spark, ("a", [], False), ("b", [], True))
    everything = lambda df: catalog.all_selected(df).first()[0]
    assert not everything(own) and not everything(own.filter("false"))
    assert everything(catalog.toggled(own, "a")) and everything(catalog.select_all(own, True))


def test_commonest_mode_ties(spark):
    rows = lambda *modes: pages(spark, *((str(i), [mode(m)], False) for i, m in enumerate(modes)))
    label = lambda *modes: summaries.most_common_mode(rows(*modes)).first()["label"]
    assert label("color", "color", "gray", "gray") == ""
    assert label("gray", "bw-otsu", "gray", "bw-otsu", "gray", "bw-otsu", "color") == "gray"
    assert label("bw") == "bwprog"


def test_history(spark):
    own = history.snapshot(pages(spark, ("a", [], True)))
    versions, state = history.push(None, None, own)
    for _ in range(3):
        versions, state = history.push(versions, state, edits.rotate_selected(history.at(versions, state)))
    turns = lambda s: len(history.at(versions, s).first()["operations"])
    back = history.undo(history.undo(state))
    assert (turns(state), turns(back), turns(history.redo(back))) == (3, 1, 2)
    versions, state = history.push(versions, back, edits.remove_shading_selected(history.at(versions, back)))
    assert history.redo(state) == state and turns(state) == 2
    for _ in range(9):
        state = history.undo(state)
    assert turns(state) == 0
    assert history.restored(own, spark.createDataFrame([("a", b"x")], "id string, thumbnail binary")).first()["thumbnail"] == b"x"


def test_lookup_of_missing_sources(spark):
    own = pages(spark, ("a", [], True))
    none = spark.createDataFrame([], "source_id string, name string")
    assert lookups.with_source(own, none).first()["name"] is None
    assert lookups.with_source(own, none, "skip").count() == 0
    with pytest.raises(Exception, match="no source for page a"):
        lookups.with_source(own, none, "error").collect()


def test_offsets_go_over_ranges(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(50)], "o long, n int")
    out = catalog.running_offset(rows, "o", "n", "before", 8).orderBy("o").collect()
    assert [r["before"] for r in out] == [sum(j % 3 for j in range(i)) for i in range(50)]


def test_expansion_of_empty_sources(spark):
    sources = spark.createDataFrame([("x", 0, 2), ("y", 1, 0), ("z", 2, 1)], "source_id string, source_order long, num_pages int")
    out = catalog.expand_pages(sources).orderBy("position").collect()
    assert [(r["position"], r["id"]) for r in out] == [(0, "x_0"), (1, "x_1"), (2, "z_0")]
    assert catalog.by_index(sources, "source_order").count() == 3
