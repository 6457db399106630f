"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Everything is computed within a row, so nothing is shuffled, whatever keys or copies the table has.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
    a an and are as at be by for from has he in is it of on or that the this to was were which with
    au avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une
    als auf aus das dem den der die ein eine er für im ist mit nicht sich sie und von werden zu
    al como con del el ella es las lo los más no para pero por su una y
""".split()


class Rule(NamedTuple):
    """A text passes if `low` <= `metric` <= `high`; None is no bound."""

    name: str
    metric: str
    low: float | None
    high: float | None


#: Metrics are names of METRICS. Stop words count in either case of A-Z. The bounds are wide: a rule is to catch what is no prose at all.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.5),
)

#: Least words, and the most percent of words in repeated windows, of the base.
BASE_WORDS, BASE_PERCENT = 10, 20

METRICS = {
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "stop_word_ratio": "(n_stop_words + 0.5) / n_words",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "bullet_line_ratio": "n_bullet_lines / n_lines",
    "ellipsis_line_ratio": "n_ellipsis_lines / n_lines",
}


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def _repeated(grams: Column) -> Column:
    """Hashes of windows with their places, sorted, where a hash occurs twice or more; else null."""
    pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(pairs))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text and the counts that rules build on."""
    w, lines = F.col("__words"), F.col("__lines")
    with_words = docs.select(
        "doc_id",
        "text",
        words(F.col("text")).alias("__words"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    positions = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW))
    with_grams = with_words.select(
        "doc_id",
        "text",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.coalesce(
            F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", "")), F.lit(0)
        ).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: ascii_lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        # Words one by one: slice() would copy the whole array for each window.
        F.transform(positions, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(WINDOW)))).alias("__grams"),
    )
    counts = [c for c in with_grams.columns if c != "__grams"]
    at = F.col("__sorted")
    sorted_ = with_grams.select(*counts, _repeated(F.col("__grams")).alias("__sorted"))
    same = lambda x, i: at[i]["h"] == x["h"]
    twice = F.filter(at, lambda x, i: ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))) | (
        (i < F.size(at) - 1) & same(x, F.least(i + 1, F.size(at) - 1))
    ))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(a["end"] - p, F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    return sorted_.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def compiled(rules=RULES) -> Column:
    """An array of the names of the rules that a row breaks. A metric without a value breaks none."""
    checks = []
    for r in rules:
        metric = F.expr(METRICS[r.metric].replace("/", "/ nullif(") + ", 0)")
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (metric < r.low)
        if r.high is not None:
            bad = bad | (metric > r.high)
        checks.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row for each row of docs (doc_id, text): its counts, base_failed, kept and the rules it breaks.

    A null or empty text has no words and fails the base. Repeated rows and rows without doc_id are judged
    like any other; no rows give no rows; other columns are not read.
    """
    base_failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))
    judged = counted(docs.select("doc_id", "text")).withColumns({"base_failed": base_failed, "broken": compiled(rules)})
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"),
        F.array_join("broken", ",").alias("broken_rules"),
    )
