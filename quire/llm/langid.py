"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters (letters in lower case, runs of anything else one space) are hashed to
`DIMENSIONS` columns. Document frequencies are counted over all rows that may be learned from. The classifier
is trained by follow-the-regularised-leader with L1 and L2 penalties on a sample of them, bounded by
`TRAIN_ROWS`, and its temperature is fitted on a part of the sample that it has not seen.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_small_batches, rows

ORDERS = 3
DIMENSION_BITS = 15
DIMENSIONS = 1 << DIMENSION_BITS
#: Whole labelled texts that the classifier is fitted on, in equal parts for each language, on average.
TRAIN_ROWS = 3000
#: One in so many of them calibrates the temperature and is not trained on.
CALIBRATE = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
FOLDS, HELD_OUT = 4, 2
#: Texts of a lower score are rejected by recognised().
LEAST_SCORE = 0.5
UNKNOWN = "und"
#: Languages that are learned at most, the most frequent ones.
MOST_LANGS = 200
#: Characters of a text that are looked at together.
SLICE = 1 << 20
_SPACE = 32

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str) -> np.ndarray | None:
    """How often each column's n-grams occur in a whole text; None without a letter. SLICE characters at a time."""
    out, table = np.zeros(DIMENSIONS, np.int64), _letter_table()
    # The codes that the next slice's n-grams begin with, which are counted, and whether a letter stands before it.
    held, counted, before, any_ = np.array([_SPACE], np.uint64), 0, False, False
    for at in range(0, len(text), SLICE):
        code = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = table[code]
        # Runs of other characters become one space; a space stands at either end.
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= before
        before, any_ = bool(letter[-1]), any_ or bool(letter.any())
        parts = [held, np.where(letter, code, _SPACE)[keep]]
        if at + SLICE >= len(text):
            parts.append([_SPACE])
        code = np.concatenate(parts).astype(np.uint64)
        h = np.zeros(len(code), np.uint64)
        for n in range(min(ORDERS, len(code))):
            h = (h[: len(code) - n] + code[n:] + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            column = (h[max(0, counted - n) :] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - DIMENSION_BITS)
            out += np.bincount(column.view(np.int64), minlength=DIMENSIONS)
        held = code[1 - ORDERS :]
        counted = len(held)
    return out if any_ else None


def tf_idf(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and their values, of length one."""
    at = np.flatnonzero(found)
    x = (1.0 + np.log(found[at])) * idf[at]
    norm = float(np.sqrt(x @ x))
    return at, x / norm if norm else x


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMENSIONS x languages
    bias: np.ndarray
    temperature: float

    def scores(self, text: str | None) -> np.ndarray | None:
        """A probability for each language; None without a letter."""
        found = counts(text) if text else None
        if found is None or not self.langs:
            return None
        at, x = tf_idf(found, self.idf)
        return softmax((x @ self.weights[at] + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal over the sample, in its order, then temperature calibration. sample: columns, values, class."""
    k = len(langs)
    z, n = np.zeros((DIMENSIONS + 1, k)), np.zeros((DIMENSIONS + 1, k))

    def weights(at):
        zs = z[at]
        w = (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    # The last column is the intercept.
    rows_ = [(np.append(at, DIMENSIONS), np.append(x, 1.0), y) for at, x, y in sample]
    held = rows_[::CALIBRATE] if len(rows_) > CALIBRATE else []
    learned = [r for i, r in enumerate(rows_) if i % CALIBRATE] if held else rows_
    for _ in range(EPOCHS):
        for at, x, y in learned:
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    temperature = 1.0
    if held:
        logits, y = np.array([x @ w[at] for at, x, _ in held]), np.array([c for _, _, c in held])
        grid = np.exp(np.linspace(np.log(0.02), np.log(5.0), 120))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(langs, idf, w[:-1], w[-1], temperature)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null without id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _frequencies(batches):
    total = np.zeros(DIMENSIONS, np.int64)
    for batch in rows(batches):
        for text in batch.column(0).to_pylist():
            found = counts(text)
            if found is not None:
                total += found > 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["col", "n"])


def _features(batches):
    for batch in rows(batches):
        found = [counts(text) for text in batch.column(2).to_pylist()]
        at = [None if f is None else np.flatnonzero(f).astype("<u2").tobytes() for f in found]
        n = [None if f is None else f[f > 0].astype("<u4").tobytes() for f in found]
        columns = [*batch.columns[:2], pa.array(at, pa.binary()), pa.array(n, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["order", "lang", "at", "n"])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, most_langs: int = MOST_LANGS) -> Model:
    """Learns from text and lang of rows whose fold is not HELD_OUT; of at most `most_langs` languages, those with most
    rows.

    To the driver come these languages with their counts, DIMENSIONS frequencies and the bounded sample. Rows without
    doc_id, text or lang are not learned from, texts without letters neither; from no rows nothing is learned.
    """
    known = in_small_batches(docs).select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.filter(fold(F.col("doc_id")) != HELD_OUT)
    frequent = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    of_lang = {r["lang"]: r["n"] for r in frequent.collect()}
    langs = sorted(of_lang)
    frequency = np.zeros(DIMENSIONS)
    counted = known.select("text").mapInArrow(_frequencies, "col int, n long").groupBy("col").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        frequency[r["col"]] = r["n"]
    total = known.count() if len(of_lang) == most_langs else sum(of_lang.values())
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0
    # By a hash of the row, so that each language gives about the same share, wherever its rows lie.
    share = F.lit(0.0)
    for lang in langs:
        wanted = train_rows / len(langs) / of_lang[lang]
        share = F.when(F.col("lang") == lang, F.lit(float(wanted))).otherwise(share)
    order = F.xxhash64("doc_id", "text")
    chosen = known.filter(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30))
    features = chosen.select(order.alias("order"), "lang", "text").mapInArrow(
        _features, "order long, lang string, at binary, n binary"
    )
    sample = []
    # An order that does not depend on how rows were dealt out.
    for r in sorted(features.collect(), key=lambda r: (r["order"], r["lang"])):
        if r["at"]:
            found = np.zeros(DIMENSIONS, np.int64)
            found[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
            sample.append((*tf_idf(found, idf), langs.index(r["lang"])))
    return train(sample, langs, idf)


def _best(model: Model, text: str | None) -> tuple[str, float]:
    p = model.scores(text)
    if p is None:
        return UNKNOWN, 0.0
    best = int(p.argmax())
    return model.langs[best], float(p[best])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, lang_pred, score (0 to 1).

    lang_pred is `und`, of score 0, for null and texts without a letter, and if nothing was learned. held_out is
    false without doc_id (such rows are not learned from either). Repeated rows each get their row; no rows give
    no rows; columns besides doc_id and text don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        own = shared.value
        for batch in rows(batches):
            found = [_best(own, text) for text in batch.column(2).to_pylist()]
            lang, score = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            names = ["doc_id", "held_out", "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lang, score], names)

    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    own = in_small_batches(docs).select(F.col("doc_id").cast("long"), held_out, "text")
    return own.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose language is recognised with a score of `least` or more.

    Null texts and texts without a letter are not recognised, and nothing is if nothing was learned. Repeated rows
    have one verdict, rows without doc_id theirs; no rows give no rows.
    """
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches):
        for batch in rows(batches):
            found = [_best(shared.value, x) for x in batch.column(text).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return in_small_batches(docs).mapInArrow(keep, docs.schema)
