"""Files in storage that the driver and all executors share: their order, and writing them from tasks."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schemes that Hadoop and Arrow name differently.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, path: str) -> str:
    """path as a full URI: without a scheme it lies where Spark itself would look, in the default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def is_local(spark: SparkSession) -> bool:
    return bool(re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master))


def shared_folder(spark: SparkSession, path: str) -> str:
    """The full URI of a folder that tasks may write to.

    One on a machine's own disk is refused on a cluster, unless it is in the one that spark.checkpoint.dir names.
    """
    uri = qualified(spark, path)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if uri.startswith("file:") and not is_local(spark) and not (root and f"{uri}/".startswith(f"{qualified(spark, root)}/")):
        raise ValueError(f"{path} is on a disk of one machine; the driver and all executors must share it")
    return uri


def arrow_uri(uri: str) -> str:
    """The URI under which Arrow reaches what Hadoop reaches under this one."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        raise ValueError(f"{uri} has no scheme; see shared_folder()")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system of a full URI, and the path in it."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(arrow_uri(uri))


def given_order(files: DataFrame, paths: Sequence[str]) -> DataFrame:
    """files (path and others) with `given`: the number of the path, a file or a folder, under which each was given.

    A file that was given twice, also by its folder, is there twice.
    """
    spark = files.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    known = []
    for i, path in enumerate(paths):
        found = hadoop(path).getFileSystem(conf).globStatus(hadoop(path))
        known += [(i, x.getPath().toString()) for x in found or ()]
    table = spark.createDataFrame(known, "given long, ancestor string")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.withColumn("ancestor", F.explode(above)).join(table, "ancestor").drop("ancestor")


def numbered(files: DataFrame, given: str | None = None) -> DataFrame:
    """files (path and others, none large) with source_order, from 0: by the column `given`, then folder, then name.

    Files are counted within their folder, and folders are summed: a single task sees one row for each folder.
    """
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.element_at(F.split("path", "/"), -1)
    place = F.col(given) if given else F.lit(0).cast("long")
    keyed = files.withColumns({"__given": place, "__folder": folder, "__name": name})
    key = ["__given", "__folder"]
    within = keyed.withColumn("__at", F.row_number().over(Window.partitionBy(*key).orderBy("__name", "path")) - 1)
    before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    folders = keyed.groupBy(*key).agg(F.count("*").alias("__n"))
    folders = folders.select(*key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = within.join(folders, key).withColumn("source_order", F.col("__before") + F.col("__at"))
    return placed.select(*files.columns, "source_order")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row of files (name, content) to a file of the folder, from tasks; returns name and bytes of each.

    A task that is run again writes the same files again. Of rows that share a name, one stays: give them others.
    """
    uri = shared_folder(files.sparkSession, folder)
    filesystem(uri)[0].create_dir(filesystem(uri)[1], recursive=True)

    def write(batches):
        fs, root = filesystem(uri)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1), strict=True):
                data = content.as_py() or b""
                with fs.open_output_stream(f"{root}/{name}", compression=None) as stream:
                    stream.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    # A name has no folders in it.
    name = F.element_at(F.split("name", "/"), -1).alias("name")
    written = files.select(name, F.col("content").cast("binary")).mapInArrow(write, "name string, bytes long")
    written.write.mode("overwrite").parquet(f"{uri}/_written")
    return files.sparkSession.read.parquet(f"{uri}/_written")
