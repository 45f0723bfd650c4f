"""Listings of files, and lines and whole texts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, extension: str = "", level: int | None = None) -> DataFrame:
    """path, dir, name, size and modified of files under path, whose names end so (in either case), to a depth (1: in path itself)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = found.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), "size", "modified")
    if extension:
        rows = rows.where(F.lower("name").endswith(extension.lower()))
    if level is not None:
        base = path.removeprefix("file:").rstrip("/")
        under = F.substring_index(F.col("path"), base, -1)
        rows = rows.where(F.size(F.split(F.ltrim(under, F.lit("/")), "/")) <= level)
    return rows


def folders(spark: SparkSession, path: str) -> DataFrame:
    """dir of every folder that holds files."""
    return files(spark, path).select("dir").distinct()


def lines(spark: SparkSession, path: str, tokens: bool = False) -> DataFrame:
    """path and line of text files, or their tokens (split at white space)."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return rows.select("path", F.filter(F.split("line", r"\s+"), lambda t: t != "").alias("tokens")) if tokens else rows


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Parquet tables of a folder by name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
