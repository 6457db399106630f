"""What the operators of this subpackage share: word splitting, hashing, tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import filesystem, is_local, shared_folder  # noqa: F401

#: Words of plain text: runs without ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of normalised text: runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes to bytes: A-Z to a-z, every other ASCII byte that is no letter or digit to a space.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


#: Bytes of a text whose words are Python objects at a time.
CHUNK = 1 << 20
_SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def space_words(data: bytes) -> Iterator[list[bytes]]:
    """Words of SPACE_WORD, A-Z in lower case, chunk by chunk. bytes.split() takes the same six separators."""
    at = 0
    while len(data) - at > CHUNK and (end := _SPACE_BYTE.search(data, at + CHUNK)):
        yield data[at : end.start()].lower().split()
        at = end.start()
    yield (data[at:] if at else data).lower().split()


def alnum_words(data: bytes) -> Iterator[list[bytes]]:
    """Words of ALNUM_WORD in lower case, chunk by chunk."""
    at = 0
    data = data.translate(ALNUM_TABLE)
    while len(data) - at > CHUNK and (end := data.find(b" ", at + CHUNK)) >= 0:
        yield data[at:end].split()
        at = end
    yield (data[at:] if at else data).split()


class WordHashes(dict):
    """64-bit hashes of words; forgets everything when it has grown to `limit` words."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, chunks: Iterable[list[bytes]]) -> np.ndarray:
        """The hashes of all words of a text."""
        found = [np.fromiter(map(self.__getitem__, words), np.uint64, len(words)) for words in chunks]
        return found[0] if len(found) == 1 else np.concatenate(found)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, in order."""
    n = len(word_hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = mixed(out + np.uint64(0x9E3779B97F4A7C15)) ^ word_hashes[i : i + n] if i else word_hashes[:n].copy()
    return mixed(out)


def shingle_set(data: bytes, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text; of fewer words, one for the whole sequence."""
    words = hashes.of(space_words(data))
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(k, len(words))))


def rows(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `step`, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Rows of an Arrow batch that holds texts. Spark's default of 10,000 takes tens of MB for each batch, on both sides.
BATCH_ROWS = 1000
#: Bytes of such a batch, so that few long texts are held at a time; a text that is longer has a batch of its own.
BATCH_BYTES = 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df; from now on the session passes at most BATCH_ROWS rows and BATCH_BYTES at a time to Python.

    The setting is the session's and stays: results are lazy, and it must hold when they are read.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.max{}PerBatch"
    if not 0 < int(conf.get(name.format("Records"))) <= BATCH_ROWS:
        conf.set(name.format("Records"), str(BATCH_ROWS))
    conf.set(name.format("Bytes"), str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names made of the given ones that no column of df has, in any case of letters."""
    taken, n = {c.lower() for c in df.columns}, 0
    while any(f"{x}_{n}".lower() in taken for x in names):
        n += 1
    return [f"{x}_{n}" for x in names]


#: Paths of what this thread has put into the shared folder and not removed.
_held = threading.local()


def _paths() -> set[str]:
    if not hasattr(_held, "paths"):
        _held.paths = set()
    return _held.paths


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names; in a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(root)
    path = shared_folder(spark, f"{root.rstrip('/')}/quire-{uuid.uuid4().hex}/{name}")
    _paths().add(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table in the shared folder and read again: lineage ends there.

    The table stays until discard(), settled() or clear().
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what is put into the shared folder inside."""
    before = set(_paths())
    yield
    _remove(spark, _paths() - before)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """stored(make(), name), without the tables and files that make() put into the shared folder on its way."""
    before = set(_paths())
    out = stored(make(), name)
    _remove(spark, _paths() - before - {out._stored_at})
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of stored(); nothing that still reads them may run afterwards."""
    for table in tables:
        _remove(table.sparkSession, {table._stored_at})


def clear(spark: SparkSession) -> None:
    """Removes all that this thread's operators have left in the shared folder: once their results, which are read
    lazily, have been read or written elsewhere."""
    _remove(spark, set(_paths()))


def _remove(spark: SparkSession, paths: set[str]) -> None:
    sc = spark.sparkContext
    for path in paths:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
        _paths().discard(path)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, cells: int = 64) -> DataFrame:
    """An inner join on `on`, none of which is null, in which no task gets all rows of left that share a key.

    They are dealt to `cells` cells by a hash of the column `by`; each row of right, few for a key, is there once for
    each cell of its key that left has.
    """
    dealt = left.withColumn("__cell", F.pmod(F.xxhash64(by), F.lit(cells)))
    wanted = dealt.select(*on, "__cell").distinct().join(right, on)
    return dealt.join(wanted, [*on, "__cell"]).drop("__cell")
