from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.sources import delimited, files, html_tables
from textloom.streaming import windows as W


def test_delimited(spark, tmp_path):
    text = '"who\r\n",place,"part\nno",seen <BR />\nAda,1,"77001",5/6<BR>\n,,,\nBob,"1,000",,x\n'
    t = delimited.parse(spark, text, numbers=True, normalize_names=True)
    assert t.columns == ["who", "place", "part_no", "seen"]
    assert [tuple(r) for r in t.orderBy("who").collect()] == [("Ada", 1.0, 77001.0, "5/6"), ("Bob", 1000.0, None, "x")]
    delimited.write(t, f"{tmp_path}/a.tsv")
    again = delimited.read(spark, f"{tmp_path}/a.tsv", "\t")
    assert again.count() == 2 and again.columns == t.columns
    assert delimited.write_many([t, t], f"{tmp_path}/b.csv") == [f"{tmp_path}/b_Sheet0.csv", f"{tmp_path}/b_Sheet1.csv"]


def test_flattened_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,09:00,09:15\n2020-01-01,1,2\n")
    (tmp_path / "y.csv").write_text("Date,09:00,09:15\n2020-01-02,3,4\n")
    got = delimited.flattened_files(spark, str(tmp_path))
    assert sorted(r.value for r in got.collect()) == [1.0, 2.0, 3.0, 4.0] and got.select("path").distinct().count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "one.TXT").write_text("x y\n")
    (tmp_path / "a" / "two.txt").write_text("z\n\nw")
    found = files.files(spark, str(tmp_path), ".txt")
    assert sorted(r.name for r in found.collect()) == ["one.TXT", "two.txt"]
    assert [r.name for r in files.files(spark, str(tmp_path), level=1).collect()] == ["one.TXT"]
    assert files.folders(spark, str(tmp_path)).count() == 2
    assert files.lines(spark, str(tmp_path)).count() == 4 and files.texts(spark, str(tmp_path)).count() == 2
    (tmp_path / "sjis.dat").write_bytes("日本".encode("shift_jis"))
    assert delimited.transcoded(spark, f"{tmp_path}/sjis.dat").first().text == "日本"


def test_html_tables(spark):
    page = "<table><tr><th>Icon</th><th>Meaning</th></tr><tr><td>:) :-)</td><td>smile<br>y</td></tr><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table><table><tr><td>1<td>2<tr><td>3"
    pages = spark.createDataFrame([(1, page), (2, "<p>none"), (3, None)], "page_id bigint, html string")
    rows = sorted((r.table_num, r.row_num, r.header, r.cells) for r in html_tables.html_tables(pages).collect())
    assert rows[0] == (0, 0, True, ["Icon", "Meaning"]) and rows[1] == (0, 1, False, [":) :-)", "smile y"])
    assert (1, 0, False, ["in"]) in rows and (2, 0, False, ["1", "2"]) in rows and (2, 1, False, ["3"]) in rows
    icons = html_tables.exploded_column(html_tables.html_tables(pages).where("table_num = 0"))
    assert {(r.icon, r.meaning) for r in icons.collect()} >= {(":)", "smile y"), (":-)", "smile y")}


@pytest.fixture(scope="module")
def event_files(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "parts")
    spark.read.parquet(f"{small}/events.parquet").repartition(4).write.parquet(path)
    return path


@pytest.mark.parametrize("kind", ["tumbling", "sliding"])
def test_streamed_windows_are_those_of_a_batch(spark, event_files, tmp_path, kind):
    f = getattr(W, kind)
    batch = f(spark.read.parquet(event_files))
    streamed = W.run_to_table(f(W.stream(spark, event_files)), f"streamed_{kind}", f"{tmp_path}/c")
    r = lambda d: d.select("start", "event_type", "n", F.round("total", 4).alias("t"))
    assert r(batch).exceptAll(r(streamed)).isEmpty() and r(streamed).exceptAll(r(batch)).isEmpty()


def test_streamed_sessions_are_closed_ones_of_the_batch(spark, event_files, tmp_path):
    batch = {(r.user_id, r.start, r.end, r.n) for r in W.sessions(spark.read.parquet(event_files)).collect()}
    q = W.run_to_table(W.sessions(W.stream(spark, event_files)), "streamed_sessions", f"{tmp_path}/c", "append")
    got = {(r.user_id, r.start, r.end, r.n) for r in q.collect()}
    assert got <= batch and len(got) > 0.9 * len(batch)


def test_stream_state_and_sinks(spark, event_files, tmp_path):
    counts = W.run_to_table(W.running_counts(W.stream(spark, event_files).select("event_type"), "event_type"), "running", f"{tmp_path}/a", "update")
    want = {r.event_type: r["count"] for r in spark.read.parquet(event_files).groupBy("event_type").count().collect()}
    assert {r.event_type: r.n for r in counts.groupBy("event_type").agg(F.max("n").alias("n")).collect()} == want
    W.run_to_files(W.deduplicated(W.stream(spark, event_files), "event_id"), f"{tmp_path}/out", f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(event_files).count()
    e = spark.read.parquet(event_files)
    assert W.joined(e, e, "event_id").count() == e.count()


def workbook(path, rows, dates=(), name="Data"):
    """A small .xlsx: strings shared, numbers and serial dates (rows, columns in dates) as they are."""
    import zipfile
    from xml.sax.saxutils import escape

    strings = []

    def cell(i, j, v):
        at = f"{chr(65 + j)}{i + 1}"
        if v is None:
            return ""
        if isinstance(v, str):
            strings.append(v)
            return f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{at}" s="{int((i, j) in dates)}"><v>{v}</v></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in strings) + "</sst>")


def test_workbooks(spark, tmp_path):
    from textloom.sources import sheets

    for k in range(2):
        workbook(tmp_path / f"b{k}.xlsx", [["Date", "9:00", "10:00", "note"], [45292 + k, 1.5 + k, 2, "a & b"], [None, None, None, None], [45300.0 + k, 3, None, None]], {(1, 0), (3, 0)})
    rows = sheets.sheets(spark, str(tmp_path))
    assert rows.count() == 6 and {r.sheet for r in rows.collect()} == {"Data"}
    t = sorted((r["Date"], r["9:00"], r["10:00"], r["note"]) for r in sheets.as_table(rows).collect())
    assert t[0] == ("2024-01-01", "1.5", "2", "a & b") and t[-1][0] == "2024-01-10" and t[-1][2] is None
    got = sorted((str(r.ts), r.value) for r in sheets.flattened_sheets(spark, str(tmp_path)).collect() if r.value is not None)
    assert got[0] == ("2024-01-01 09:00:00", 1.5) and len(got) == 6


def test_html_table_as_table(spark):
    html = "<table><tr><th>name</th><th>name</th><th></th></tr><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td><td>e</td></tr></table>"
    rows = html_tables.html_tables(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    t = html_tables.as_table(rows, 1)
    assert t.columns == ["name", "name_1", "c2"] and [tuple(r) for r in t.collect()] == [("a", "b", None), ("c", "d", "e")]
    assert html_tables.as_table(rows, 1, header=False).count() == 3


def test_batches_of_a_stream(spark, tmp_path):
    from textloom.streaming import windows as event_windows

    spark.range(10).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
    event_windows.run_batches(stream, lambda batch, n: seen.append((n, batch.count())), f"{tmp_path}/checkpoint")
    assert sum(n for _, n in seen) == 10 and [i for i, _ in seen] == list(range(len(seen)))


def test_streamed_pairs_are_written_by_executors(spark, small):
    """An in-memory table would hold every pair on the driver."""
    from textloom import plans

    assert plans.QUERIES["streamed_pairs"](spark, small).inputFiles()


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_streamed_folders_of_several_batches(spark, event_files, tmp_path, mode):
    stream = W.stream(spark, event_files, files_per_trigger=1)
    built = W.sessions(stream, late=None) if mode == "complete" else stream.select("event_id")
    got = W.run_to_folder(built, f"{tmp_path}/rows", f"{tmp_path}/c", mode)
    table = spark.read.parquet(event_files)
    want = W.sessions(table) if mode == "complete" else table.select("event_id")
    keys = ["user_id", "start", "end", "n"] if mode == "complete" else ["event_id"]
    assert sorted(got.select(keys).collect()) == sorted(want.select(keys).collect())


def test_streamed_sessions_are_written_by_executors(spark, small):
    from textloom import plans

    assert plans.QUERIES["streamed_sessions"](spark, small).inputFiles()
