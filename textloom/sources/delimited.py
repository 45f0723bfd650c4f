"""Delimited text: reading with tidy headers and cells, and writing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, strings
from ..operators.reshape import normalized_columns


def _tidy(df: DataFrame, numbers: bool, normalize_names: bool) -> DataFrame:
    names = [c.strip() for c in df.columns]
    import re

    names = [re.sub(r"\s*<\s*br\s*/?\s*>\s*$", "", n, flags=re.I) for n in names]
    df = df.toDF(*[f"c{i}" for i in range(len(names))])
    some = F.lit(False)
    for c in df.columns:
        some = some | (F.coalesce(F.trim(c), F.lit("")) != "")
    df = df.where(some)
    last = df.columns[-1]
    df = df.withColumn(last, strings.strip_br(F.col(last)))
    if numbers:
        # A column is numeric if all of its cells are: one pass over the data.
        checks = df.agg(*[F.bool_and(coerce.null_if_blank(F.col(c)).isNull() | F.trim(F.replace(F.col(c), F.lit(","), F.lit(""))).try_cast("double").isNotNull()).alias(c) for c in df.columns]).first()
        df = df.select(*[F.trim(F.replace(coerce.null_if_blank(F.col(c)), F.lit(","), F.lit(""))).try_cast("double").alias(c) if checks[c] else F.trim(c).alias(c) for c in df.columns])
    out = df.toDF(*names)
    return normalized_columns(out) if normalize_names else out


def read(spark: SparkSession, path: str | list[str], separator: str = ",", header: bool = True, numbers: bool = False, normalize_names: bool = False, encoding: str = "UTF-8", schema=None, recursive: bool = False, glob: str | None = None, multi_line: bool = False) -> DataFrame:
    """Rows of delimited files. Blank rows go, and a line-break tag at the end of the header and of rows.

    Quoted cells may hold separators, and line ends if multi_line; files can't be split then. Without a schema all cells are strings, or numbers where a whole column is."""
    r = spark.read.options(sep=separator, header=header, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE", encoding=encoding, recursiveFileLookup=recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is not None:
        return r.schema(schema).csv(path)
    return _tidy(r.csv(path), numbers, normalize_names)


def parse(spark: SparkSession, text: str, separator: str = ",", numbers: bool = False, normalize_names: bool = False) -> DataFrame:
    """Rows of a delimited text in the program."""
    import csv
    import io

    rows = [r for r in csv.reader(io.StringIO(text), delimiter=separator) if r]
    width = len(rows[0])
    body = [tuple([*r[:width], *[None] * (width - len(r))]) for r in rows[1:]]
    from pyspark.sql.types import StringType, StructField, StructType

    return _tidy(spark.createDataFrame(body, StructType([StructField(n or f"column_{i}", StringType()) for i, n in enumerate(rows[0])])), numbers, normalize_names)


def write(df: DataFrame, path: str, separator: str | None = None, header: bool = True, mode: str = "errorifexists") -> None:
    """Delimited files under path; tabs if its name ends in tsv."""
    df.write.mode(mode).options(sep=separator or ("\t" if path.rstrip("/").endswith("tsv") else ","), header=header).csv(path)


def write_many(tables: list[DataFrame], path: str, **options) -> list[str]:
    """A folder for each table, numbered."""
    stem, dot, ext = path.rpartition(".")
    paths = [f"{stem}_Sheet{i}{dot}{ext}" if dot else f"{path}_Sheet{i}" for i in range(len(tables))]
    for t, p in zip(tables, paths, strict=True):
        write(t, p, **options)
    return paths


def _first_line(paths: pd.Series) -> pd.Series:
    import pyarrow.fs as pafs

    out = []
    for p in paths:
        fs, at = pafs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
        head = b""
        with fs.open_input_stream(at) as f:
            while b"\n" not in head and (more := f.read(1 << 16)):
                head += more
        out.append(head.split(b"\n", 1)[0].decode("utf-8", "replace").strip())
    return pd.Series(out)


def flattened_files(spark: SparkSession, path: str, glob: str = "*.csv", separator: str = ",") -> DataFrame:
    """path, ts and value of all files under path that have a date column and a column for each time of day.

    Files of one header are read in one scan; the driver sees the files' names and each distinct header."""
    from ..operators.reshape import flattened_times

    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(path).select("path")
    out = None
    for group in files.groupBy(F.pandas_udf(_first_line, "string")("path").alias("head")).agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("head").collect():
        table = spark.read.options(sep=separator, header=True, quote='"', escape='"').csv(group.paths)
        names = [c.strip() for c in table.columns]
        table = table.select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path")).toDF(*names, "path")
        one = flattened_times(table, keep=("path",)).select("path", "ts", "value")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "path string, ts timestamp, value double")


def transcoded(spark: SparkSession, path: str, source: str = "shift_jis") -> DataFrame:
    """path and text of whole files in any encoding that Python knows; bytes that aren't valid are replaced."""
    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else bytes(b).decode(source, "replace"))

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("text"))
