"""Sources that arrive while a job runs, as a stream of the same rows that a scan gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources.documents import streamed_sources

FILES = "path string, modificationTime timestamp, length long, content binary"


def watched_sources(spark: SparkSession, path: str) -> DataFrame:
    """sources of PDF files as they appear in a folder. Stateless: write with a checkpoint for exactly-once rows."""
    return streamed_sources(spark.readStream.format("binaryFile").schema(FILES).load(path))
