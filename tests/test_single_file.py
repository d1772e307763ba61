"""Single-file exports against the standard library's readers."""

from __future__ import annotations

import csv
import io
import json
import random
import zipfile
import zlib
from datetime import date
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from weftwork import more_queries, queries
from weftwork.sources import single_file, sinks

ODD = ["plain", "", None, 'quo"te', "line\nend\r\n", " blank ", "a,b;c", "<&>", "é漢🎈", "=1+1", "bell\x07", "\t"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(k, ODD[k % len(ODD)], rng.random() if k % 3 else None, bool(k % 2), [k, None], {"k": k}, date(2024, 1, 1 + k % 28), Decimal(k)) for k in range(500)]
    return spark.createDataFrame(data, "id long, text string, x double, b boolean, l array<int>, m map<string,int>, d date, n decimal(9,2)").repartition(7).sortWithinPartitions("id").cache()


def test_crc_of_joined_texts():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (rng.randbytes(rng.randrange(400)) for _ in range(2))
        assert single_file.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_csv(rows, tmp_path):
    path = f"{tmp_path}/a.csv"
    sinks.csv_file(rows, path, rows.columns)
    raw = Path(path).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and [p.name for p in tmp_path.iterdir()] == ["a.csv"]
    found = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    want = rows.select(*[sinks.cell(rows, c).alias(c) for c in rows.columns]).collect()
    assert found[0] == rows.columns and found[1:] == [["" if x is None else x for x in r] for r in want]


def test_json(rows, tmp_path):
    path = f"file://{tmp_path}/a.json"
    sinks.json_file(rows, path, ["id", "text", "x", "l", "m"])
    text = Path(tmp_path, "a.json").read_text()
    found = json.loads(text)
    assert [(r["id"], r.get("text"), r.get("x"), r["l"], r["m"]) for r in found] == [(r.id, r.text, r.x, r.l, r.m) for r in rows.collect()]
    assert text == json.dumps(found, ensure_ascii=False, indent=2) + "\n"


def test_xlsx_by_sheets(spark, rows, tmp_path, monkeypatch):
    """More rows than a sheet holds: fragments fill sheets, every member's sum is right, and Spark reads all of it back."""
    monkeypatch.setattr(single_file, "FRAGMENT_ROWS", 20)
    monkeypatch.setattr(single_file, "SHEET_ROWS", 101)
    path = f"{tmp_path}/a.xlsx"
    options = {"path": path, "kind": "xlsx", "sheet": "Ä & B"}
    shown = rows.select("id", "text", "x", "b", F.array_join("l", "; ").alias("l"))
    w = single_file.SingleFileWriter(options, shown.schema, True)
    parts = [b for b in shown.toArrow().to_batches(max_chunksize=70)]
    made = []
    for k, b in enumerate(parts):
        monkeypatch.setattr(single_file, "TaskContext", type("C", (), {"get": staticmethod(lambda k=k: type("T", (), {"partitionId": lambda s: k, "taskAttemptId": lambda s: 9})())}))
        made.append(w.write(iter([b])))
    w.commit([*reversed(made), None])
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        sheets = [n for n in z.namelist() if "worksheets" in n]
        assert len(sheets) >= 5 and all(z.read(n).count(b"<row>") <= 101 for n in sheets)
        assert 'name="Ä &amp; B (2)"' in z.read("xl/workbook.xml").decode()
        first = z.read("xl/worksheets/sheet1.xml").decode()
        assert '<c s="1"' not in first and '<c t="inlineStr" s="1">' in first and 'ref="A1:E' in first and "<c><v>" in first and '<c t="b">' in first
    got = [tuple(r) for r in single_file.workbook(spark, path).orderBy("_sheet", "_row").drop("_sheet", "_row").collect()]
    legal = lambda t: None if not t else t.replace("\x07", "").replace("\r\n", "\n")
    assert [(int(a), legal(b), None if c is None else float(c), d, e) for a, b, c, d, e in got] == [(r.id, legal(r.text), r.x, str(int(r.b)), r.l or None) for r in shown.collect()]


def test_xlsx_by_spark(spark, rows, tmp_path):
    path = f"{tmp_path}/b.xlsx"
    for _ in range(2):  # a second export replaces the first
        sinks.xlsx_file(rows, path, ["id", "d", "n", "m"])
    assert [p.name for p in tmp_path.iterdir()] == ["b.xlsx"]
    got = single_file.workbook(spark, path)
    assert got.columns == ["_sheet", "_row", "id", "d", "n", "m"]
    assert [(int(r.id), r.d, r.n, r.m) for r in got.orderBy("_row").collect()] == [(r.id, str(r.d), str(r.n), json.dumps(r.m, separators=(",", ":"))) for r in rows.collect()]


def test_nothing_to_export(spark, tmp_path):
    none = spark.createDataFrame([], "a string, b int")
    for kind in ("csv", "json", "xlsx"):
        getattr(sinks, f"{kind}_file")(none, f"{tmp_path}/n.{kind}", ["a", "b"])
    assert (tmp_path / "n.csv").read_text(encoding="utf-8-sig") == "a,b\n" and json.loads((tmp_path / "n.json").read_text()) == []
    assert single_file.workbook(spark, f"{tmp_path}/n.xlsx").columns[2:] == ["a", "b"] and single_file.workbook(spark, f"{tmp_path}/n.xlsx").count() == 0


def test_failed_export_leaves_nothing(spark, tmp_path):
    df = spark.range(50).repartition(3).select(F.when(F.col("id") == 30, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("a"))
    with pytest.raises(Exception, match="broken"):
        single_file.write(df, f"{tmp_path}/a.csv", "csv")
    assert not list(tmp_path.iterdir())
    Path(tmp_path, "b.csv").write_text("kept")
    spark.range(3).write.format("single_file").option("kind", "json").mode("overwrite")
    with pytest.raises(Exception, match="overwrite it or take another name"):
        spark.range(3).select(F.col("id").cast("string")).write.format("single_file").mode("append").save(f"{tmp_path}/b.csv")
    assert Path(tmp_path, "b.csv").read_text() == "kept" and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError, match="no format"):
        single_file.SingleFileWriter({"path": "x", "kind": "pdf"}, df.schema, True)


@pytest.mark.parametrize("width", [7, 64, 1000, 1 << 20])
def test_csv_rows_by_ranges(spark, tmp_path, monkeypatch, width):
    """records with quotes and line ends come whole and once wherever ranges are cut."""
    monkeypatch.setattr(single_file, "RANGE", width if width > 7 else 37)
    texts = [f'{k} "q" \n, {"x" * (k * 37 % 300)}\r\n""' if k % 3 else f"plain {k} é" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    path = f"{tmp_path}/a.csv"
    single_file.write(df.repartition(3, "id"), path, "csv")
    got = single_file.csv_rows(spark, path, "id long, text string")
    assert width > 1000 or got.rdd.getNumPartitions() > 5
    assert sorted((r.id, r.text) for r in got.collect()) == list(enumerate(texts))


def test_fragments_are_bounded_by_text():
    """F16: a fragment holds no more than some characters, however long its rows are."""
    rows = iter([[k, "x" * 1000] for k in range(100)])
    assert [len(s) for s in single_file._some(rows, 65_536, 30_000)] == [30, 30, 30, 10]


@pytest.mark.parametrize("name", ["export_texts_csv", "export_texts_xlsx"])
def test_odd_texts_as_the_sql_has_them(spark, tmp_path, name):
    """empty texts and nulls stay apart, and every character comes back."""
    texts = ["plain", "", None, "a\r\nb\r", "\r", "\n", "\t", " ", "\x07", "x\x00y", '"', '""', ",", "\ufeffa", "\ufffe", "\x85\u2028\x0b", "&#13; &amp; <&>]]>", "_x000D_", "é漢🎈", "=1+1"]
    langs = ["en", "", None]
    rows = [(k, t, langs[k % 3], None if t is None else len(t)) for k, t in enumerate(texts * 3)] + [(None, "", "", 0), (None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.SQL[name]).fetchall()
    assert sorted(map(str, map(tuple, getattr(more_queries, name)(spark, str(tmp_path)).collect()))) == sorted(map(str, want))
