"""Workbooks (xlsx): one file for each key, written in a task each."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook_bytes(rows: pd.DataFrame, sheet: str) -> bytes:
    """A workbook of one sheet: a header row, numbers as numbers, all else as text."""

    def cell(value) -> str:
        if value is None or (isinstance(value, float) and value != value) or value is pd.NaT:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    def letters(n: int) -> str:
        out = ""
        while n >= 0:
            n, rest = divmod(n, 26)
            out, n = chr(65 + rest) + out, n - 1
        return out

    lines = [list(rows.columns), *rows.astype(object).where(rows.notna(), None).values.tolist()]
    body = "".join(f'<row r="{r}">' + "".join(cell(v).replace("<c", f'<c r="{letters(c)}{r}"', 1) for c, v in enumerate(line)) + "</row>" for r, line in enumerate(lines, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook {_NS} xmlns:r="{_RELS}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_RELS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_NS}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def write_workbooks(df: DataFrame, folder: str, key: Column, columns: list[str], order: list[str], sheet: str = "Sheet1") -> DataFrame:
    """A workbook <key>.xlsx below folder, a URI that all executors share, for each value of key; returns
    (key, path, rows).  A key's rows make one file, so they must fit a task."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = str(group["__key"].iloc[0])
        path = f"{root}/{name}.xlsx"
        with store.open_output_stream(path) as out:
            out.write(workbook_bytes(group.sort_values(order)[columns], sheet))
        return pd.DataFrame({"key": [name], "path": [path], "rows": [len(group)]})

    rows = df.withColumn("__key", key.cast("string"))
    return rows.groupBy("__key").applyInPandas(write, "key string, path string, rows long")
