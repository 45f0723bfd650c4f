"""Sheets of .xlsx workbooks (ZIP files of XML), read without an Excel library: one task a file."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import flattened_times
from .folders import settled

SCHEMA = "path string, sheet string, row_num int, cells array<string>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the formats that are dates or times in every workbook.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCH = dt.datetime(1899, 12, 30)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _when(days: float) -> str:
    """A serial number as a date, a time or both."""
    at = EPOCH + dt.timedelta(seconds=round(days * 86_400))
    if days < 1:
        return f"{at:%H:%M:%S}"
    return f"{at:%Y-%m-%d}" if at.time() == dt.time() else f"{at:%Y-%m-%d %H:%M:%S}"


def rows_of(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, cells) of every row that has any; dates and times as text, numbers as they are written."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        parsed = lambda n: ElementTree.fromstring(z.read(n))
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{MAIN}t"))
        shared = [text(s) for s in parsed("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = parsed("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
            formats = styles.find(f"{MAIN}cellXfs")
            for x in formats if formats is not None else ():
                k = int(x.get("numFmtId", 0))
                dates.append(k in DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\\[[^\\]]*\\]', "", own.get(k, "")), re.I)))
        targets = {r.get("Id"): r.get("Target") for r in parsed("xl/_rels/workbook.xml.rels")}
        for sheet in parsed("xl/workbook.xml").iter(f"{MAIN}sheet"):
            target = targets[sheet.get(REL)]
            at = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for i, row in enumerate(parsed(at).iter(f"{MAIN}row")):
                cells: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
                    value = text(c) if kind == "inlineStr" else v.text if v is not None else None
                    if value is not None and kind == "s":
                        value = shared[int(value)]
                    elif value is not None and kind == "b":
                        value = "true" if value == "1" else "false"
                    elif value is not None and kind == "n" and int(c.get("s", 0)) < len(dates) and dates[int(c.get("s", 0))]:
                        value = _when(float(value))
                    place = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    cells[place] = value
                if any(x not in (None, "") for x in cells):
                    yield sheet.get("name"), int(row.get("r", i + 1)) - 1, cells


def sheets(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """path, sheet, row_num and cells of every row of every workbook under path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(p, *r) for r in rows_of(bytes(content))], columns=["path", "sheet", "row_num", "cells"])

    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMA)


def as_table(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """path and the columns of a sheet (the first by name if none is given) of workbooks with one header: the header row's names, cells as strings."""
    name = sheet if sheet is not None else rows.agg(F.min("sheet")).first()[0]
    own = rows.where(F.col("sheet") == name).withColumn("first", F.min("row_num").over(_of_file()))
    header = own.where("row_num = first").select("cells").distinct().collect()
    if len(header) != 1:
        raise ValueError(f"{len(header)} headers")
    names = [(h or f"c{i}").strip() for i, h in enumerate(header[0].cells)]
    return own.where("row_num > first").select("path", *[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def _of_file():
    from pyspark.sql import Window

    return Window.partitionBy("path", "sheet")


def flattened_sheets(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """path, ts and value of the first sheet of all workbooks under path that have a date column and a column for each time of day.

    Workbooks of one header are one table; the driver sees each distinct header."""
    rows = settled(sheets(spark, path, glob))
    firsts = rows.groupBy("path").agg(F.min("sheet").alias("sheet"))
    own = rows.join(firsts, ["path", "sheet"])
    heads = own.groupBy("path").agg(F.min_by("cells", "row_num").alias("head"))
    out = None
    for h in heads.select("head").distinct().collect():
        some = own.join(heads.where(F.to_json("head") == F.to_json(F.array(*[F.lit(x) for x in h.head]))).select("path"), "path").withColumn("sheet", F.lit(""))
        one = flattened_times(as_table(some, ""), keep=("path",)).select("path", "ts", "value")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "path string, ts timestamp, value double")
