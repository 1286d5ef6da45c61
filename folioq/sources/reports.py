"""Saved reports and extractions as files: found, paged and sorted by what the file system knows, and read only where they are asked for.

Files without a byte do not exist here, as Spark's listing leaves them out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions.json import strict
from folioq.operators.catalogue import page


def literal(name: str) -> str:
    """A file name as a glob that matches it alone."""
    return re.sub(r"([\\*?\[\]{},])", r"\\\1", name)


def list_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, folder, name, modified, length) of the files below a path whose name fits a glob; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    parts = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", parts[0].alias("folder"), parts[1].alias("name"), F.col("modificationTime").alias("modified"), "length")


def report_lookup(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, path, status, record) of every file of a name: success, or error if it is no JSON. A name without a file gives one row, not_found.

    The name is matched while files are listed, so no other file is opened; characters that mean something in a glob stand for themselves.
    """
    files = spark.read.option("pathGlobFilter", literal(name)).option("recursiveFileLookup", True).text(path, wholetext=True)
    read = files.select(F.lit(name).alias("name"), F.col("_metadata.file_path").alias("path"), strict(F.col("value")).alias("record"))
    asked = spark.range(1).select(F.lit(name).alias("name")).join(read, "name", "left")
    status = F.when(F.col("path").isNull(), "not_found").when(F.col("record").isNull(), "error").otherwise("success")
    return asked.select("name", "path", status.alias("status"), "record")


def report_page(spark: SparkSession, path: str, number: int = 1, size: int = 20, pattern: str = "*.json") -> DataFrame:
    """(total, path, name, modified, status, record): a page of saved reports, newest first, ties by path. total counts all files, unreadable ones too;
    those have status error and no record. A page beyond the last has no rows.

    The order comes from the listing. A page has at most 100 files, whose paths the driver knows, and only they are read; as many bytes as the files have.
    """
    files = list_files(spark, path, pattern)
    shown = page(files.select("path", "name", "modified"), "modified", "path", number, size).collect()
    total = files.count()
    if not shown:
        return spark.createDataFrame([], "total long, path string, name string, modified timestamp, status string, record variant")
    found = spark.createDataFrame(shown, "path string, name string, modified timestamp")
    read = records(spark, [r.path for r in shown])
    joined = found.join(read, "path", "left")
    return joined.select(F.lit(total).cast("long").alias("total"), "path", "name", "modified", F.when(F.col("record").isNull(), "error").otherwise("success").alias("status"), "record")


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, record) of the named files, null for those that are no JSON in UTF-8."""
    read = spark.read.format("binaryFile").load([literal(p) for p in paths])
    return read.select("path", strict(F.try_validate_utf8(F.col("content").cast("string"))).alias("record"))


def latest_extraction(spark: SparkSession, path: str, name: str = "extraction.json") -> DataFrame:
    """(folder, modified): the folder below a path whose file of that name is the most recent, ties by path; no row if there is none. Partially aggregated, from the listing alone."""
    newest = list_files(spark, path, literal(name)).agg(F.max(F.struct("modified", "folder")).alias("m")).filter("m is not null")
    return newest.select("m.folder", "m.modified")


def output_sizes(spark: SparkSession, outputs: DataFrame, path: str, uri: str = "storage_uri") -> DataFrame:
    """outputs with size_bytes, from the listing of the files below a path; null for an output whose file is gone. A uri is the file's path below `path`."""
    files = list_files(spark, path, "*")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    sizes = files.select(F.substr("path", F.lit(len(full) + 2)).alias("_uri"), F.col("length").alias("_size"))
    kept = [c for c in outputs.columns if c != "size_bytes"]
    joined = outputs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{uri}`").alias("_asked")).join(sizes, F.col("_asked") == F.col("_uri"), "left")
    return joined.select("_row.*", F.col("_size").alias("size_bytes"))
