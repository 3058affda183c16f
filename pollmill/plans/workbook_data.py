"""Workbooks built by Spark from a table: one small .xlsx per group of rows."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_RNS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _letters(n: int) -> str:
    out = ""
    while n:
        n, rem = divmod(n - 1, 26)
        out = chr(65 + rem) + out
    return out


def workbook_bytes(rows: list[list], shared: bool) -> bytes:
    """A minimal one-sheet workbook; None leaves the cell out."""
    strings: dict[str, int] = {}
    body = []
    for r, row in enumerate(rows, 1):
        cells = []
        for k, v in enumerate(row, 1):
            ref = f"{_letters(k)}{r}"
            if v is None:
                continue
            if isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif shared:
                cells.append(f'<c r="{ref}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>')
            else:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {_NS} {_RNS}><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        if shared:
            items = "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
            z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>{items}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {_NS}><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(df: DataFrame, chunk: str, order: str, widths: list[int] | None = None) -> DataFrame:
    """(path, content): one workbook per value of ``chunk`` (a bounded number of rows each)."""
    columns = [c for c in df.columns if c != chunk]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        no = int(pdf[chunk].iloc[0])
        width = widths[no % len(widths)] if widths else len(columns)
        header: list = [f"h_{c}" for c in columns][:width]
        header += [None if k % 2 else f"q{k}" for k in range(len(header) + 1, width)] + (["last"] if len(header) < width else [])
        if not widths and no % 2:
            header[1] = None
        rows = [[v.item() if hasattr(v, "item") else v for v in rec] for rec in pdf.sort_values(order)[columns].itertuples(index=False)]
        return pd.DataFrame({"path": [f"{no:06d}.xlsx"], "content": [workbook_bytes([header, *rows], shared=bool(no % 2))]})

    return df.groupBy(chunk).applyInPandas(build, "path string, content binary")
