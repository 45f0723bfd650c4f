"""Tables in HTML pages, as rows of cells."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id bigint, table_num int, row_num int, header boolean, cells array<string>"


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, bool, list[str]]] = []
        self.open: list[dict] = []
        self.tables = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"n": self.tables, "rows": 0, "row": None, "cell": None, "header": True})
            self.tables += 1
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self._end_row(t)
                t["row"], t["header"] = [], True
            elif tag in ("td", "th"):
                self._end_cell(t)
                if t["row"] is None:
                    t["row"], t["header"] = [], True
                t["cell"] = []
                t["header"] = t["header"] and tag == "th"
            elif tag == "br" and t["cell"] is not None:
                t["cell"].append(" ")

    def handle_endtag(self, tag):
        if self.open:
            t = self.open[-1]
            if tag in ("td", "th"):
                self._end_cell(t)
            elif tag == "tr":
                self._end_row(t)
            elif tag == "table":
                self._end_row(t)
                self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(data)

    def _end_cell(self, t):
        if t["cell"] is not None:
            t["row"].append(" ".join("".join(t["cell"]).split()))
            t["cell"] = None

    def _end_row(self, t):
        self._end_cell(t)
        if t["row"]:
            self.rows.append((t["n"], t["rows"], t["header"], t["row"]))
            t["rows"] += 1
        t["row"] = None


def rows_of(html: str | None) -> list[tuple[int, int, bool, list[str]]]:
    """(table, row, header, cells) of all tables of a page; nested tables are tables of their own."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    for t in reversed(p.open):
        p._end_row(t)
    return sorted(p.rows, key=lambda r: r[:2])


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, table_num, row_num, header and cells of every row of every table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, *r) for i, h in zip(b["page_id"], b["html"], strict=True) for r in rows_of(h)]
            yield pd.DataFrame(out, columns=["page_id", "table_num", "row_num", "header", "cells"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).where(F.lower("html").contains("<table")).mapInPandas(run, SCHEMA)


def exploded_column(rows: DataFrame, key: int = 1, value: int = 2) -> DataFrame:
    """One row for each string in a cell of several, with another cell: such as icons and their meaning. Cells count from 1."""
    body = rows.where("not header").select("page_id", "table_num", F.try_element_at("cells", F.lit(key)).alias("k"), F.try_element_at("cells", F.lit(value)).alias("meaning"))
    return body.select("page_id", "table_num", F.explode(F.split(F.trim("k"), r"\s+")).alias("icon"), "meaning").where("icon <> ''")


def as_table(rows: DataFrame, page_id: int, table_num: int = 0, header: bool = True) -> DataFrame:
    """One table of one page (rows of html_tables) as a table: columns named by its header row, or else by its first row.

    Cells that a row lacks are null, those beyond the header go, and names that come twice get a number. header False: columns c0, c1, ..."""
    own = rows.where((F.col("page_id") == page_id) & (F.col("table_num") == table_num))
    top = own.orderBy(F.desc("header"), "row_num").limit(1).collect() if header else []
    width = own.agg(F.max(F.size("cells"))).first()[0] or 0
    names: list[str] = []
    for i, name in enumerate(top[0].cells if top else [f"c{i}" for i in range(width)]):
        base = name or f"c{i}"
        names.append(base if base not in names else f"{base}_{i}")
    body = own.where(F.col("row_num") != top[0].row_num) if top else own
    return body.orderBy("row_num").select(*[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
