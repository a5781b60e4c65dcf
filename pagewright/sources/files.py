"""Plain files: a folder as a manifest, and text with its encoding found out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def listed(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, size, mtime, reason: every file of a folder; reason is null for those to convert. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), paths.skip_reason(F.col("path")).alias("reason"))


def contents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, size, mtime, content of the files that listed() takes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.filter(paths.skip_reason(F.col("path")).isNull()).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def decoded(files: DataFrame) -> DataFrame:
    """files (content, ...) -> the same with encoding and text. Only rows that are neither marked nor UTF-8 meet Python."""
    kind = paths.encoding(F.col("content"))
    rest = lambda n: F.expr(f"substring(content, {n})")
    marked = files.withColumn("encoding", kind)
    known = marked.filter("encoding <> 'gb18030'")
    text = F.when(F.col("encoding") == "utf-8-sig", F.decode(rest(4), "UTF-8")).when(F.col("encoding") == "utf-16le", F.decode(rest(3), "UTF-16LE")).when(F.col("encoding") == "utf-16be", F.decode(rest(3), "UTF-16BE")).otherwise(F.decode("content", "UTF-8"))
    other = marked.filter("encoding = 'gb18030'").withColumn("text", paths.gb18030(F.col("content")))
    return known.withColumn("text", text).unionByName(other)
