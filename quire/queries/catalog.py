"""Queries on the catalogue tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import pages as P
from quire.functions import strings as S
from quire.operators import catalog, edits, history, lookups, summaries
from quire.plans.export import export_plan, rescale_plan
from quire.queries.bindings import (
    LABEL,
    MODE,
    PAGES_OF_DOCUMENT,
    SCANS,
    SOURCES,
    ops_sql,
    pages,
    pages_sql,
    pixel_size_sql,
    scans,
    size_sql,
    sources,
    table,
)
from quire.sources.documents import sources_of

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_DPI = "CASE WHEN mode IN ('bw', 'bw-otsu') THEN 150 ELSE 120 END"


@query(f"""
    WITH {pages_sql()}, m AS (
        SELECT *, {MODE} AS mode FROM sized
    ), d AS (
        SELECT *, {_DPI} AS dpi FROM m
    ), p AS (
        SELECT *, {pixel_size_sql("round(612.0 * dpi / 72)", "round(792.0 * dpi / 72)")} AS px FROM d
    )
    SELECT document, position, id, mode, dpi AS target_dpi, 0.5::DOUBLE AS jpeg_quality, size.w AS width_pts, size.h AS height_pts,
           px.w AS width_px, px.h AS height_px, (90 * len([1 FOR o IN operations IF o.type = 'rotate'])) % 360 AS rotation,
           len([1 FOR o IN operations IF o.type = 'removeShading']) > 0 AS remove_shading,
           len([1 FOR o IN operations IF o.type = 'enhanceContrast']) > 0 AS enhance_contrast
    FROM p
""")
def export_plan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_plan(pages(spark, sf_dir))


QUERIES["export_plan"], SQL["export_plan"] = QUERIES.pop("export_plan_query"), SQL.pop("export_plan_query")


@query(f"""
    WITH {SOURCES}, s AS (
        SELECT *, coalesce(sum(num_pages) OVER (ORDER BY source_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM sources WHERE mime = 'application/pdf'
    )
    SELECT (before + i)::BIGINT AS position, source_id || '_' || i AS id, source_id, i::INT AS source_page_index
    FROM (SELECT *, unnest(range(num_pages)) AS i FROM s)
""")
def page_expand(spark, sf_dir):
    expanded = catalog.expand_pages(catalog.pdf_files(sources(spark, sf_dir)))
    return expanded.select("position", "id", "source_id", "source_page_index")


def _reported(df: DataFrame) -> DataFrame:
    size = F.col("page_size_pts")
    return df.select(
        "document", "position", "id", size["width"].alias("width"), size["height"].alias("height"),
        P.ops_text(F.col("operations")).alias("ops"), "selected",
    )


@query(f"""
    WITH {pages_sql()}
    SELECT document, position, id, CASE WHEN selected THEN size.h ELSE size.w END AS width,
           CASE WHEN selected THEN size.w ELSE size.h END AS height,
           concat_ws('|', {ops_sql()}, CASE WHEN selected THEN 'rotate:90' END) AS ops, selected
    FROM sized
""")
def rotate_selected(spark, sf_dir):
    return _reported(edits.rotate_selected(pages(spark, sf_dir)))


@query(f"""
    WITH {pages_sql()}, h AS (
        SELECT *, unnest(CASE WHEN selected THEN ['left', 'right'] ELSE [NULL] END) AS side FROM sized
    )
    SELECT document, row_number() OVER (PARTITION BY document ORDER BY position, side) - 1 AS position,
           concat_ws('_', id, side) AS id, CASE WHEN side IS NULL THEN size.w ELSE size.w / 2 END AS width, size.h AS height,
           concat_ws('|', {ops_sql()}, 'split:' || side) AS ops, selected AND side IS NULL AS selected
    FROM h
""")
def split_selected(spark, sf_dir):
    return _reported(edits.split_selected(pages(spark, sf_dir)))


@query(f"""
    WITH {pages_sql()}
    SELECT document, row_number() OVER (PARTITION BY document ORDER BY position) - 1 AS position, id, size.w AS width,
           size.h AS height, {ops_sql()} AS ops, selected
    FROM sized WHERE NOT selected
""")
def delete_selected(spark, sf_dir):
    return _reported(edits.delete_selected(pages(spark, sf_dir)))


@query(f"""
    WITH {pages_sql()}
    SELECT document, row_number() OVER (PARTITION BY document ORDER BY CASE WHEN position % 5 <> 0 THEN (position * 17) % 53 END NULLS LAST, position) - 1 AS position, id
    FROM sized
""")
def reorder_pages(spark, sf_dir):
    own = pages(spark, sf_dir)
    order = own.filter("position % 5 <> 0").select("id", (F.col("position") * 17 % 53).alias("rank"))
    return catalog.reordered(own, order).select("document", "position", "id")


@query(f"""
    WITH {pages_sql()}, r AS (
        SELECT *, [o FOR o IN operations IF o.type <> 'colorMode'] AS rest FROM sized
    )
    SELECT document, position, id, size.w AS width, size.h AS height,
           CASE WHEN selected THEN concat_ws('|', nullif({ops_sql("rest")}, ''), 'colorMode:bw') ELSE {ops_sql()} END AS ops, selected
    FROM r
""")
def color_mode_replace(spark, sf_dir):
    return _reported(edits.color_mode_selected(pages(spark, sf_dir), "bw"))


@query(f"""
    WITH {pages_sql()}, r AS (
        SELECT *, [o FOR o IN operations IF o.type <> 'colorMode'] AS rest FROM sized
    )
    SELECT document, position, id, size.w AS width, size.h AS height,
           CASE WHEN selected THEN {ops_sql("rest")} ELSE {ops_sql()} END AS ops, selected
    FROM r
""")
def color_mode_removed(spark, sf_dir):
    return _reported(edits.color_mode_selected(pages(spark, sf_dir), "color"))


def _once_sql(kind: str) -> str:
    return f"""
    WITH {pages_sql()}
    SELECT document, position, id, size.w AS width, size.h AS height,
           concat_ws('|', {ops_sql()}, CASE WHEN selected AND len([1 FOR o IN operations IF o.type = '{kind}']) = 0 THEN '{kind}' END) AS ops, selected
    FROM sized
    """


@query(_once_sql("removeShading"))
def remove_shading_once(spark, sf_dir):
    once = edits.remove_shading_selected(pages(spark, sf_dir))
    return _reported(edits.remove_shading_selected(once))


@query(_once_sql("enhanceContrast"))
def enhance_contrast_once(spark, sf_dir):
    once = edits.enhance_contrast_selected(pages(spark, sf_dir))
    return _reported(edits.enhance_contrast_selected(once))


@query(f"""
    WITH {pages_sql()}
    SELECT id, {MODE} AS mode, {LABEL} AS label, ((90 * len([1 FOR o IN operations IF o.type = 'rotate'])) % 360)::INT AS rotation,
           (len([1 FOR o IN operations IF o.type = 'rotate']) % 4)::INT AS quarter_turns
    FROM sized
""")
def effective_mode(spark, sf_dir):
    ops, rotation = F.col("operations"), P.total_rotation(F.col("operations"))
    mode = P.effective_color_mode(ops)
    return pages(spark, sf_dir).select(
        "id", mode.alias("mode"), S.mode_label(mode).alias("label"), rotation.cast("int").alias("rotation"),
        P.quarter_turns(rotation).alias("quarter_turns"),
    )


@query(f"""
    WITH {pages_sql()}
    SELECT id, a.w AS width, a.h AS height, b.w AS width_turned_first, b.h AS height_turned_first
    FROM (SELECT id, {size_sql("300.0", "500.0")} AS a, {size_sql("500.0", "300.0")} AS b FROM pages0)
""")
def effective_size(spark, sf_dir):
    from quire.schema import page_size

    a, b = (P.effective_page_size(page_size(*x), F.col("operations")) for x in ((300, 500), (500, 300)))
    return pages(spark, sf_dir).select(
        "id", a["width"].alias("width"), a["height"].alias("height"),
        b["width"].alias("width_turned_first"), b["height"].alias("height_turned_first"),
    )


_LEVELS = "(['none', 'low', 'medium', 'high', 'other'])[source_page_index % 5 + 1]"
_DPI_SQL = """CASE level WHEN 'none' THEN 300 WHEN 'low' THEN CASE {family} WHEN 'color' THEN 180 WHEN 'gray' THEN 200 ELSE 260 END
    WHEN 'high' THEN CASE {family} WHEN 'bw' THEN 150 ELSE 120 END ELSE CASE {family} WHEN 'bw' THEN 200 ELSE 150 END END"""
_NEW = "(CASE WHEN mode IN ('bw', 'bw-otsu') THEN 'bw' WHEN mode = 'gray' THEN 'gray' ELSE 'color' END)"
_OLD = "(CASE WHEN mode IN ('bw', 'gray', 'color') THEN mode ELSE 'gray' END)"


def _levels(spark, sf_dir) -> DataFrame:
    levels = F.array(*map(F.lit, ("none", "low", "medium", "high", "other")))
    level = F.element_at(levels, (F.col("source_page_index") % 5 + 1).cast("int"))
    own = pages(spark, sf_dir).select("id", P.effective_color_mode(F.col("operations")).alias("mode"), level.alias("level"))
    return own


@query(f"""
    WITH {pages_sql()}, m AS (SELECT id, {MODE} AS mode, {_LEVELS} AS level FROM sized)
    SELECT id, mode, level, {_DPI_SQL.format(family=_NEW)} AS target_dpi,
           (CASE level WHEN 'none' THEN 0.85 WHEN 'low' THEN 0.75 WHEN 'medium' THEN 0.6 ELSE 0.5 END)::DOUBLE AS quality,
           CASE level WHEN 'none' THEN '' WHEN 'low' THEN 'lowcomp' WHEN 'high' THEN 'highcomp' ELSE 'medcomp' END AS label
    FROM m
""")
def target_dpi(spark, sf_dir):
    found = lookups.with_target_dpi(_levels(spark, sf_dir), F.col("mode"), F.col("level"))
    level = F.col("level")
    return found.select(
        "id", "mode", "level", "target_dpi", P.jpeg_quality(level).alias("quality"), S.compression_label(level).alias("label")
    )


@query(f"""
    WITH {pages_sql()}, m AS (SELECT id, {MODE} AS mode, 'low' AS level, source_page_index AS n, size FROM sized), d AS (
        SELECT *, least((100 + n * 7) / (612.0::DOUBLE / 72), (90 + n * 11) / (792.0::DOUBLE / 72)) AS original,
               {_DPI_SQL.format(family=_OLD)} AS target FROM m
    ), o AS (
        SELECT *, least(original, target) AS dpi FROM d
    )
    SELECT id, mode, original AS original_dpi, dpi AS output_dpi, greatest(1, floor(612.0::DOUBLE / 72 * dpi + 0.5))::BIGINT AS width_out,
           greatest(1, floor(792.0::DOUBLE / 72 * dpi + 0.5))::BIGINT AS height_out
    FROM o
""")
def rescale_plan_query(spark, sf_dir):
    n = F.col("source_page_index")
    rasters = pages(spark, sf_dir).select(
        "id", P.effective_color_mode(F.col("operations")).alias("mode"), F.col("original_size_pts").alias("page_size_pts"),
        (n * 7 + 100).alias("width_px"), (n * 11 + 90).alias("height_px"),
    )
    return rescale_plan(rasters, "low")


QUERIES["rescale_plan"], SQL["rescale_plan"] = QUERIES.pop("rescale_plan_query"), SQL.pop("rescale_plan_query")


@query(f"""
    WITH {pages_sql()}, c AS (
        SELECT document, {LABEL} AS label, count(*) AS n FROM sized GROUP BY ALL
    )
    SELECT document, arg_max(label, n * 10 - list_position(['', 'gray', 'bw', 'bwprog'], label)) AS label FROM c GROUP BY document
""")
def most_common_mode(spark, sf_dir):
    return summaries.most_common_mode(pages(spark, sf_dir))


@query(f"""
    WITH {pages_sql()}, c AS (
        SELECT document, {LABEL} AS label, count(*) AS n FROM sized GROUP BY ALL
    ), l AS (
        SELECT document, arg_max(label, n * 10 - list_position(['', 'gray', 'bw', 'bwprog'], label)) AS label FROM c GROUP BY document
    ), s AS (
        SELECT document, CASE WHEN count(DISTINCT stem) = 1 THEN min(stem) ELSE 'merged' END AS base
        FROM (SELECT document, CASE WHEN document % 2 = 0 THEN source_id ELSE 's1' END AS stem FROM sized) GROUP BY document
    )
    SELECT document, concat_ws('_', base, 'highcomp', nullif(label, ''), 'ocr') || '.pdf' AS name FROM l JOIN s USING (document)
""")
def output_name(spark, sf_dir):
    own = pages(spark, sf_dir)
    # Every other document has a single source.
    name = F.concat(F.when(F.col("document") % 2 == 0, F.col("source_id")).otherwise("s1"), F.lit(".pdf"))
    stems = own.select("document", S.file_stem(name).alias("stem"))
    return summaries.output_names(own, stems, "high", True)


_STEM = r"coalesce(nullif(regexp_extract({x}, '(?s)^(.+)\.[^.]*$', 1), ''), nullif({x}, ''), 'file')"


@query(rf"""
    SELECT page_id, {_STEM.format(x="url")} AS stem,
           coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[/\\?%*:|"<>]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^[-_.]+|[-_.]+$', '', 'g'), 40), ''), 'file') AS part,
           CASE WHEN length(page_id::VARCHAR) >= 4 THEN 'page_' || page_id || '.png' ELSE 'page_' || lpad(page_id::VARCHAR, 4, '0') || '.png' END AS ocr_name,
           page_id || ' page' || CASE WHEN page_id = 1 THEN '' ELSE 's' END AS counted
    FROM pages
""")
def sanitize_name(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", S.file_stem(url).alias("stem"), S.sanitize_filename_part(url).alias("part"),
        S.ocr_image_name(F.col("page_id")).alias("ocr_name"), S.counted(F.col("page_id")).alias("counted"),
    )


def _with_thumbnails(own: DataFrame) -> DataFrame:
    n = F.col("source_page_index")
    return own.filter(n % 11 != 0).select(
        "id",
        "source_id",
        "source_page_index",
        F.when(n % 4 == 0, P.drop_ops(F.col("operations"), "removeShading")).otherwise(F.col("operations")).alias("operations"),
        F.when(n % 5 != 0, F.concat(F.lit("t"), "id")).alias("thumbnail"),
    )


@query(f"""
    WITH {pages_sql()}, fits AS (
        SELECT id, source_page_index % 11 <> 0 AND source_page_index % 5 <> 0
               AND (source_page_index % 4 <> 0 OR len([1 FOR o IN operations IF o.type = 'removeShading']) = 0) AS fit
        FROM sized
    )
    SELECT id, NOT fit AS needs_thumbnail, CASE WHEN fit THEN 't' || id END AS thumbnail FROM fits
""")
def snapshot_diff(spark, sf_dir):
    own = pages(spark, sf_dir)
    diff = history.snapshot_diff(history.snapshot(own), _with_thumbnails(own))
    return diff.select("id", F.coalesce("needs_thumbnail", F.lit(True)).alias("needs_thumbnail"), "thumbnail")


@query(f"""
    WITH {pages_sql()}, v AS (
        SELECT unnest(range(60)) AS version
    )
    SELECT version::INT AS version, id, {ops_sql("operations[:greatest(len(operations) - 59 + version, 0)]")} AS ops FROM v, sized
    WHERE version >= 10
""")
def history_cap(spark, sf_dir):
    """Sixty versions of all pages, the last with all operations, each one before with one fewer: fifty are kept."""
    own = history.snapshot(pages(spark, sf_dir))
    numbered = own.withColumn("version", F.explode(F.expr("sequence(0, 59)")))
    ops = F.expr("slice(operations, 1, greatest(size(operations) - 59 + version, 0))")
    kept = history.capped(numbered.withColumn("operations", ops))
    return kept.select("version", "id", P.ops_text(F.col("operations")).alias("ops"))


@query(f"""
    WITH {pages_sql()}
    SELECT document, position, id, size.w AS width, size.h AS height, {ops_sql()} AS ops, selected FROM sized
""")
def undo_to_start(spark, sf_dir):
    """Three edits, undone one by one, and one redone and undone again: the pages are as they were."""
    own = history.snapshot(pages(spark, sf_dir))
    versions, state = history.push(None, None, own)
    for edit in (edits.rotate_selected, edits.remove_shading_selected, edits.delete_selected):
        versions, state = history.push(versions, state, edit(history.at(versions, state)))
    for _ in range(3):
        state = history.undo(state)
    return _reported(history.at(versions, history.undo(history.redo(state))))


@query(f"""
    WITH {pages_sql()}, v AS (
        SELECT *, unnest(range(len(operations) + 1)) AS version FROM sized
    ), o AS (
        SELECT version, id, {ops_sql("operations[:version]")} AS ops FROM v
    )
    SELECT version::INT AS version, id, ops <> lag(ops) OVER (PARTITION BY id ORDER BY version) AS changed FROM o
""")
def version_changes(spark, sf_dir):
    own = history.snapshot(pages(spark, sf_dir)).withColumn("version", F.explode(F.expr("sequence(0, size(operations))")))
    ops = F.when(F.col("version") > 0, F.expr("slice(operations, 1, greatest(version, 1))")).otherwise(
        F.expr("filter(operations, o -> false)")
    )
    return history.changed(own.withColumn("operations", ops))


@query(f"""
    WITH {pages_sql()}
    SELECT document, count(*) AS pages, count(*) FILTER (selected) AS selected_pages, bool_and(selected) AS all_selected,
           bool_and(selected OR source_page_index % 3 <> 0) AS all_selected_after_toggle
    FROM sized GROUP BY document
""")
def page_counts(spark, sf_dir):
    own = pages(spark, sf_dir)
    state = own.groupBy("document").agg(
        F.coalesce(F.bool_and("selected"), F.lit(False)).alias("all_selected"),
        F.bool_and(F.col("selected") | (F.col("source_page_index") % 3 != 0)).alias("all_selected_after_toggle"),
    )
    return catalog.page_counts(own).join(state, "document")


@query(f"""
    WITH {pages_sql()}, a AS (SELECT 'selected' AS state, coalesce(bool_and(selected), false) AS all_selected FROM sized
        UNION ALL SELECT 'all', count(*) > 0 FROM sized UNION ALL SELECT 'none', false
        UNION ALL SELECT 'empty', false UNION ALL SELECT 'all but one', count(*) FILTER (id = '1') = 0 FROM sized)
    SELECT * FROM a
""")
def selection_states(spark, sf_dir):
    own = pages(spark, sf_dir)
    states = {
        "selected": own, "all": catalog.select_all(own, True), "none": catalog.select_all(own, False),
        "empty": own.filter("false"), "all but one": catalog.toggled(catalog.select_all(own, True), "1"),
    }
    out = None
    for name, df in states.items():
        row = catalog.all_selected(df).select(F.lit(name).alias("state"), "all_selected")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""
    WITH {SOURCES}, s AS (SELECT *, {_STEM.format(x="name")} AS stem FROM sources WHERE mime = 'application/pdf')
    SELECT sum(num_pages)::BIGINT AS total_pages, count(*) AS sources, count(DISTINCT stem) = 1 AS single_stem FROM s
""")
def source_totals(spark, sf_dir):
    return catalog.totals(catalog.pdf_files(sources(spark, sf_dir)))


@query(f"WITH {SOURCES} SELECT DISTINCT {_STEM.format(x='name')} AS stem FROM sources")
def distinct_stems(spark, sf_dir):
    return catalog.distinct_stems(sources(spark, sf_dir))


@query(f"""
    WITH {pages_sql()}, u AS (SELECT document, 0 AS part, position, id FROM sized UNION ALL SELECT document, 1, position, id || 'b' FROM sized WHERE selected)
    SELECT document, row_number() OVER (PARTITION BY document ORDER BY part, position) AS page_number, id FROM u
""")
def concatenated_pages(spark, sf_dir):
    own = pages(spark, sf_dir)
    second = catalog.selected_pages(own).withColumn("id", F.concat("id", F.lit("b")))
    return catalog.page_numbers(catalog.concatenated(own, second))


@query(f"""
    WITH {pages_sql()}, s AS (SELECT 's' || i AS source_id, 'book ' || i AS name FROM (SELECT unnest(range(5)) AS i))
    SELECT p.id, p.source_id, s.name, s.name IS NOT NULL AS found FROM sized p LEFT JOIN s ON p.source_id = s.source_id
""")
def source_lookup(spark, sf_dir):
    known = spark.range(5).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"), F.concat(F.lit("book "), F.col("id").cast("string")).alias("name")
    )
    own = pages(spark, sf_dir).select("id", "source_id")
    return lookups.with_source(own, known).select("id", "source_id", "name", F.col("name").isNotNull().alias("found"))


@query(f"""
    WITH {pages_sql()}, s AS (SELECT 's' || i AS source_id, 'book ' || i AS name FROM (SELECT unnest(range(5)) AS i))
    SELECT p.id, p.source_id, s.name FROM sized p JOIN s ON p.source_id = s.source_id
""")
def source_lookup_skip(spark, sf_dir):
    known = spark.range(5).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"), F.concat(F.lit("book "), F.col("id").cast("string")).alias("name")
    )
    own = pages(spark, sf_dir).select("id", "source_id")
    return lookups.with_source(own, known, "skip").select("id", "source_id", "name")


@query(f"""
    WITH {pages_sql()}
    SELECT a.document, a.position, a.id, b.id AS image_id FROM sized a JOIN (SELECT document - 1 AS document, position, id FROM sized WHERE document > 0) b
    ON a.position = b.position AND a.document = b.document
""")
def ocr_zip(spark, sf_dir):
    own = pages(spark, sf_dir).select("document", "position", "id")
    images = own.filter("document > 0").select((F.col("document") - 1).alias("document"), "position", F.col("id").alias("image_id"))
    return lookups.zipped(own, images).select("document", "position", "id", "image_id")


@query("""
    WITH s AS (SELECT p_partkey, p_size * 37 AS w, p_size * 53 AS h FROM part), b AS (
        SELECT *, floor(least(w, h) / 50.0::DOUBLE + 0.5::DOUBLE)::INT AS implied FROM s
    ), o AS (
        SELECT *, CASE WHEN implied < 3 THEN 3 WHEN implied % 2 = 1 THEN implied ELSE implied + 1 END AS odd FROM b
    ), c AS (
        SELECT *, least(greatest(odd, 15), 75) AS block FROM o
    )
    SELECT p_partkey, block AS block_size, least(greatest(floor(block * 0.2::DOUBLE + 0.5::DOUBLE), 6), 20)::INT AS c FROM c
""")
def bw_options(spark, sf_dir):
    found = P.bw_options(F.col("p_size") * 37, F.col("p_size") * 53)
    return table(spark, sf_dir, "part").select("p_partkey", found["block_size"].alias("block_size"), found["c"].alias("c"))


assert PAGES_OF_DOCUMENT < 53, "ranks of reorder_pages must differ"


@query(f"WITH {SCANS} SELECT source_order, name, 'application/pdf' AS mime, num_pages FROM scans")
def scanned_sources(spark, sf_dir):
    """PDF files that are made of documents, scanned: their order and page counts."""
    return sources_of(scans(spark, sf_dir)).select("source_order", "name", "mime", "num_pages")


@query(f"""
    WITH {SCANS}, p AS (
        SELECT *, unnest(range(num_pages)) AS i, sum(num_pages) OVER (ORDER BY source_order) - num_pages AS before FROM scans
    )
    SELECT (before + i)::BIGINT AS position, i::INT AS source_page_index,
           (CASE WHEN i % 3 = 2 THEN 300 + doc_id % 5 ELSE 200 END)::DOUBLE AS width,
           (CASE WHEN i % 3 = 2 THEN 200 ELSE 300 + doc_id % 5 END)::DOUBLE AS height
    FROM p
""")
def scanned_pages(spark, sf_dir):
    """The pages of these files, in the order of the files, each of its own size."""
    pages = catalog.expand_pages(sources_of(scans(spark, sf_dir)))
    return pages.select("position", "source_page_index", F.col("page_size_pts.width").alias("width"), F.col("page_size_pts.height").alias("height"))


@query(f"""WITH {SOURCES} SELECT source_order, 'source_' || source_order || '_' || substr(sha1(name), 1, 8) AS id FROM sources""")
def source_ids(spark, sf_dir):
    return sources(spark, sf_dir).select("source_order", S.source_id(F.col("name"), F.col("source_order")).alias("id"))


@query(f"""
    WITH {pages_sql()}
    SELECT p.id, {ops_sql()} AS operations, CASE WHEN p.position % 2 = 0 THEN 'image of ' || p.id END AS thumbnail FROM sized p
""")
def restored_pages(spark, sf_dir):
    """Snapshots with their thumbnails, where there is one."""
    own = pages(spark, sf_dir)
    images = own.filter("position % 2 = 0").select("id", F.concat(F.lit("image of "), F.col("id")).alias("thumbnail"))
    out = history.restored(history.snapshot(own), images)
    return out.select("id", P.ops_text(F.col("operations")).alias("operations"), "thumbnail")
