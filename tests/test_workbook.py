"""A workbook read back cell by cell, and pages of the explorer."""

import os
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import functions as F

from corvane.operators import stats
from corvane.sources import workbook

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def back(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", NS)]
        out = {}
        for i, name in enumerate(names, 1):
            rows = ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).findall("m:sheetData/m:row", NS)
            out[name] = [[float(c.find("m:v", NS).text) if c.find("m:v", NS) is not None else c.findtext("m:is/m:t", None, NS) for c in r.findall("m:c", NS)] for r in rows]
    return out


ROWS = [
    ("1", "a <&> \x01 \"b\"", ["X", "Y"], "cs/AI", 5, "v", "2020-01-02", float("nan")), ("2", "z" * 600, None, "cs/AI", 9, "w", "2021-01-02", 1.5), ("3", None, [], "CS_ai", None, None, None, float("inf")), ("4", " s ", ["Ü"], None, 0, "v", "2020-05-05", None),
]
SCHEMA = "arxiv_id string, title string, author_list array<string>, primary_category string, citations int, venue string, published_date string, score double"


def test_workbook_cell_by_cell(spark, tmp_path):
    path = f"{tmp_path}/w.xlsx"
    workbook.workbook(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path)
    got = back(path)
    head = ["arxiv_id", "title", "published_date", "primary_category", "citations", "author_list", "score", "venue"]
    assert list(got) == ["Summary", "CS_ai", "cs_AI (2)", "none"]
    assert got["cs_AI (2)"] == [head, ["2", "z" * 500, "2021-01-02", "cs/AI", 9.0, None, 1.5, "w"], ["1", 'a <&>   "b"', "2020-01-02", "cs/AI", 5.0, "X; Y", "NaN", "v"]]
    assert got["CS_ai"][1:] == [["3", None, None, "CS_ai", None, "", "Infinity", None]] and got["none"][1][1] == " s "
    assert got["Summary"][0][:3] == ["primary_category", "papers", "citations"] and {r[0]: r[1] for r in got["Summary"][1:]} == {"cs/AI": 2.0, "CS_ai": 1.0, None: 1.0}
    assert os.listdir(tmp_path) == ["w.xlsx"]
    workbook.workbook(spark.createDataFrame(ROWS, SCHEMA).limit(0), path)
    assert list(back(path)) == ["Summary"] and len(back(path)["Summary"]) == 1


def test_long_sheets_go_on_in_another(tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 5)
    w = workbook.WorkbookWriter(f"{tmp_path}/w.xlsx")
    os.makedirs(w.folder)
    parts = []
    for k in range(4):
        (tmp_path / "w.xlsx.parts" / f"{k}.xml").write_text(f"<row><c><v>{k}</v></c></row>" * 2)
        parts.append(workbook.Parts(3 - k, [("s", 2, f"{k}.xml")]))
    w.commit(parts)
    got = back(f"{tmp_path}/w.xlsx")
    assert {n: [r[0] for r in rows] for n, rows in got.items()} == {"s": [3, 3, 2, 2], "s (2)": [1, 1, 0, 0]}


def test_pages_of_ranks_and_keys(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("arxiv_id"), F.when(F.col("id") % 50 != 7, F.col("id") % 13).alias("citations"))
    whole = [r["arxiv_id"] for r in rows.orderBy(F.desc_nulls_last("citations"), "arxiv_id").collect()]
    stats.save_ranks(rows, f"{tmp_path}/r")
    assert [r["arxiv_id"] for r in stats.ranked_page(spark, f"{tmp_path}/r", 7).collect()] == whole[140:160]
    seen, after = [], None
    while got := stats.page_after(rows, after, size=60).collect():
        seen += [r["arxiv_id"] for r in got]
        after = (got[-1]["citations"], got[-1]["arxiv_id"])
    assert seen == whole
