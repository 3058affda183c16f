"""Reading survey workbooks: a directory of .xlsx files becomes long cell rows."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import norm_ws

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELL_SCHEMA = "file string, row int, col int, value string"
_CELLS_PER_BATCH = 200_000


def _column_number(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = 26 * n + ord(ch.upper()) - 64
    return n


def _joined_text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_MAIN + "t"))


def _first_sheet_part(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[sheet.get(_REL + "id")]
    return target.lstrip("/") if target.startswith("/xl/") else "xl/" + target.lstrip("/")


def _cells(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the first sheet, streamed; the header is row 1."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            strings = [_joined_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_MAIN + "si")]
        row_no = 0
        with book.open(_first_sheet_part(book)) as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag != _MAIN + "row":
                    continue
                row_no += 1
                for cell in node.iter(_MAIN + "c"):
                    kind, value, inline = cell.get("t"), cell.find(_MAIN + "v"), cell.find(_MAIN + "is")
                    if kind == "inlineStr" and inline is not None:
                        text = _joined_text(inline)
                    elif value is None or value.text is None:
                        text = ""
                    elif kind == "s":
                        k = int(value.text)
                        text = strings[k] if 0 <= k < len(strings) else ""
                    else:
                        text = value.text
                    yield row_no, _column_number(cell.get("r", "A1")), text
                node.clear()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows: list[tuple] = []
            for r, k, text in _cells(content):
                rows.append((path, r, k, text))
                if len(rows) >= _CELLS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=["file", "row", "col", "value"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["file", "row", "col", "value"])


def parse_workbooks(files: DataFrame) -> DataFrame:
    """Cells of the first sheet of each workbook in (path, content): (file, row, col, value).

    One task parses whole workbooks; the sheet format caps one at 1,048,576 rows.
    """
    return files.select("path", "content").mapInPandas(_parse, CELL_SCHEMA).withColumn("value", norm_ws("value"))


def scan_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every workbook under a folder; ``file`` is its full path."""
    return parse_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path))


def file_name(path: str = "file") -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def write_workbooks(books: DataFrame, path: str) -> None:
    """The workbooks of (path, content) as files below the folder ``path``, each named by its row's path.

    Tasks write through Arrow's file systems, and a file shows up under its name only when whole: a task that runs again puts the same
    bytes in its place.
    """
    from pyarrow import fs
    system, base = fs.FileSystem.from_uri(path)
    system.create_dir(base, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(path)
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                part = f"{base}/_{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as out:
                    out.write(content)
                system.move(part, f"{base}/{name}")
            yield pdf[["path"]]

    books.select("path", "content").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def sheet_headers(cells: DataFrame) -> DataFrame:
    """(file, col, header); a missing header becomes its column code, the last header gives the width."""
    head = cells.filter("row = 1")
    width = head.groupBy("file").agg(F.max("col").alias("w"))
    slots = width.select("file", F.explode(F.sequence(F.lit(1), F.col("w"))).alias("col"))
    return slots.join(head.select("file", "col", "value"), ["file", "col"], "left").select(
        "file", "col", F.coalesce("value", F.format_string("C%03d", F.col("col"))).alias("header"))


def detect_layout(cells: DataFrame, layouts: dict[int, str] | None = None) -> DataFrame:
    """(file, n_columns, layout) by header count; an unknown width has layout NULL."""
    # The two known layouts.
    layouts = layouts or {64: "new961_64", 108: "amethyst_108"}
    name = F.create_map(*[F.lit(x) for kv in layouts.items() for x in kv])
    width = cells.filter("row = 1").groupBy("file").agg(F.max("col").alias("n_columns"))
    return width.withColumn("layout", name[F.col("n_columns")])


def sheet_rows(cells: DataFrame, n_columns: int, names: list[str] | None = None) -> DataFrame:
    """Dense rows of sheets: (file, row_no, columns...); absent cells are empty strings.

    ``row_no`` counts data rows from 1 and is the respondent number of a single workbook.
    """
    names = names or [f"R{i:02d}" for i in range(1, n_columns + 1)]
    wide = (cells.filter("row > 1").groupBy("file", "row").pivot("col", list(range(1, n_columns + 1)))
            .agg(F.first("value")))
    return wide.select("file", (F.col("row") - 1).cast("bigint").alias("row_no"),
                       *[F.coalesce(F.col(str(i)), F.lit("")).alias(n) for i, n in enumerate(names, 1)])


def require_layout(n_columns: int, layouts=(64, 108)) -> int:
    """Reject an unknown sheet width at plan time."""
    if n_columns not in layouts:
        raise ValueError(f"unsupported sheet width: {n_columns} (expected one of {list(layouts)})")
    return n_columns
