"""Names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What names of files cannot hold, what their ends are trimmed of, and the length of a part.
NOT_IN_NAMES, TRIMMED, MAX_LENGTH = r'[/\\?%*:|"<>]', r"^[-_.]+|[-_.]+$", 40


def file_stem(name: Column) -> Column:
    """The name up to its last dot, if that is not its first character; `file` for an empty or null name."""
    stem = F.nullif(F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1), F.lit(""))
    return F.coalesce(stem, F.nullif(name, F.lit("")), F.lit("file"))


def sanitize_filename_part(value: Column, max_length: int = MAX_LENGTH) -> Column:
    """Without characters that file names can't have; white space and runs of dashes one dash; trimmed, then cut."""
    kept = F.regexp_replace(F.coalesce(value, F.lit("")), NOT_IN_NAMES, "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", "-"), "-+", "-")
    trimmed = F.regexp_replace(dashed, TRIMMED, "")
    return F.coalesce(F.nullif(F.substring(trimmed, 1, max_length), F.lit("")), F.lit("file"))


def compression_label(value: Column) -> Column:
    return (
        F.when(value == "none", "").when(value == "low", "lowcomp").when(value == "high", "highcomp").otherwise("medcomp")
    )


def mode_label(mode: Column) -> Column:
    return F.when(mode == "bw", "bwprog").when(mode == "bw-otsu", "bw").when(mode == "gray", "gray").otherwise("")


def output_filename(base: Column, compression: Column, label: Column, ocr_used: Column) -> Column:
    """The base as it is, then each suffix that isn't empty, sanitised."""
    suffixes = [compression_label(compression), label, F.when(ocr_used, "ocr").otherwise("")]
    parts = [F.when(s != "", sanitize_filename_part(s, 24)) for s in suffixes]
    return F.concat(F.concat_ws("_", F.nullif(base, F.lit("")), *parts), F.lit(".pdf"))


def source_id(name: Column, order: Column) -> Column:
    """Of the source's place and name; a clock would give another id each time a task is run."""
    return F.concat_ws("_", F.lit("source"), order.cast("string"), F.substring(F.sha1(F.coalesce(name, F.lit(""))), 1, 8))


def ocr_image_name(index: Column) -> Column:
    """page_0001.png; longer numbers are not cut."""
    return F.format_string("page_%04d.png", index)


def counted(n: Column, noun: str = "page") -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
