"""Workbooks: a Spark sink whose tasks write parts of sheets, put together into one archive when all are there.

Rows are (sheet, cells), in the order they shall have; cells are structs of a text or a number. A task writes each run of
rows of one sheet to a part of its own, in the folder ``path`+ ".parts"``; the commit copies the parts, block by block,
into the archive, in the order of the partitions, and begins "name (2)" where a sheet would pass the format's rows. Parts of
failed attempts are never named by a message and go with the folder. The path may be on any file system that pyarrow knows.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .sinks import flat, sheet

SCHEMA = "sheet string, cells array<struct<text:string,number:double>>"
#: Rows of a sheet that the format allows, of a part, and letters of a sheet's name.
SHEET_ROWS, PART_ROWS, NAME_LETTERS = 1_048_576, 50_000, 31
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Characters that XML doesn't know.
_ILLEGAL = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


@dataclass
class Parts(WriterCommitMessage):
    partition: int
    parts: list[tuple[str, int, str]]  # sheet, rows, file


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _cell(cell) -> str:
    if cell is None or cell["text"] is None and cell["number"] is None:
        return "<c/>"
    if cell["number"] is not None:
        return f"<c><v>{cell['number']:.17g}</v></c>"
    text = escape(_ILLEGAL.sub(" ", cell["text"]))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _names(wanted: list[str]) -> list[str]:
    """Names that the format allows, each once whatever the case."""
    out: list[str] = []
    for w in wanted:
        base = re.sub(r"[\[\]:*?/\\]", "_", w).strip("'")[:NAME_LETTERS] or "sheet"
        name, i = base, 2
        while name.lower() in {o.lower() for o in out}:
            name, i = f"{base[: NAME_LETTERS - len(f' ({i})')]} ({i})", i + 1
        out.append(name)
    return out


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.folder = path, path + ".parts"

    def write(self, iterator: Iterator) -> Parts:
        from pyspark import TaskContext

        fs, folder = _files(self.folder)
        fs.create_dir(folder, recursive=True)
        parts: list[tuple[str, int, str]] = []
        out, now, n = None, None, 0
        for row in iterator:
            if out is None or row["sheet"] != now or n == PART_ROWS:
                if out is not None:
                    out.close()
                    parts.append((now, n, file))
                now, n, file = row["sheet"], 0, f"{uuid.uuid4().hex}.xml"
                out = fs.open_output_stream(f"{folder}/{file}")
            out.write(f"<row>{''.join(map(_cell, row['cells']))}</row>".encode())
            n += 1
        if out is not None:
            out.close()
            parts.append((now, n, file))
        return Parts(TaskContext.get().partitionId(), parts)

    def commit(self, messages: list) -> None:
        fs, folder = _files(self.folder)
        sheets: list[tuple[str, int, list[str]]] = []
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, n, file in m.parts:
                if not sheets or sheets[-1][0] != name or sheets[-1][1] + n > SHEET_ROWS:
                    sheets.append((name, 0, []))
                sheets[-1] = (name, sheets[-1][1] + n, [*sheets[-1][2], file])
        sheets = sheets or [("sheet", 0, [])]
        names = _names([s[0] for s in sheets])
        out_fs, path = _files(self.path)
        with out_fs.open_output_stream(path) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            kinds = '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
            z.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')
            z.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
            z.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
            links = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
            z.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
            for i, (_, _, files) in enumerate(sheets, 1):
                with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as entry:
                    entry.write(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    for file in files:
                        with fs.open_input_stream(f"{folder}/{file}") as part:
                            while block := part.read(1 << 20):
                                entry.write(block)
                    entry.write(b"</sheetData></worksheet>")
        self._clear(fs, folder)

    def abort(self, messages: list) -> None:
        self._clear(*_files(self.folder))

    def _clear(self, fs, folder: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(folder).type != FileType.NotFound:
            fs.delete_dir(folder)


class WorkbookSource(DataSource):
    """spark.dataSource.register(WorkbookSource); rows.write.format("workbook").mode("append").save(path)"""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"])


def _cells(df: DataFrame, columns: list[str], letters: int) -> Column:
    """The columns of a row as cells: finite numbers as such, all else as text, cut at some letters."""
    kinds = dict(df.dtypes)

    def cell(name: str) -> Column:
        x = F.col(f"`{name}`")
        text = F.substring(x.cast("string"), 1, letters)
        if kinds[name] not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kinds[name].startswith("decimal"):
            return F.struct(text.alias("text"), F.lit(None).cast("double").alias("number"))
        n = x.cast("double")
        finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
        return F.struct(F.when(~finite, text).alias("text"), F.when(finite, n).alias("number"))

    return F.array(*[cell(c) for c in columns])


def workbook(papers: DataFrame, path: str, key: str = "primary_category", order: str = "citations", id_column: str = "arxiv_id", letters: int = 500) -> None:
    """A summary sheet and one sheet for each category, the most cited first, each with a row of headings. Null category: "none"."""
    spark = papers.sparkSession
    spark.dataSource.register(WorkbookSource)
    rows, short = flat(papers), sheet(papers, key)
    head = lambda columns: F.array(*[F.struct(F.lit(c).alias("text"), F.lit(None).cast("double").alias("number")) for c in columns])
    place = lambda first, line, by, tie: [F.lit(first).alias("__first"), F.lit(line).alias("__line"), by.cast("double").alias("__by"), tie.cast("string").alias("__tie")]
    none, name = F.lit(None), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("none"))
    parts = [
        spark.range(1).select(F.lit("Summary").alias("sheet"), head(short.columns).alias("cells"), *place(0, 0, none, none)),
        short.select(F.lit("Summary").alias("sheet"), _cells(short, short.columns, letters).alias("cells"), *place(0, 1, none, name)),
        rows.select(name.alias("sheet")).distinct().select("sheet", head(rows.columns).alias("cells"), *place(1, 0, none, none)),
        rows.select(name.alias("sheet"), _cells(rows, rows.columns, letters).alias("cells"), *place(1, 1, -F.coalesce(F.col(order), F.lit(0)), F.col(id_column))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by = ["__first", "sheet", "__line", "__by", "__tie"]
    out.repartitionByRange(*by).sortWithinPartitions(*by).select("sheet", "cells").write.format("workbook").mode("append").save(path)
