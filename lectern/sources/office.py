"""Documents from office files and OCR answers."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import html_table_to_pipe, strip

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def blocks(paragraphs: Column, tables: Column) -> Column:
    """Non-blank paragraphs, then all tables as pipe rows with a rule below the first row; blank lines between."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    table = lambda t: F.array_join(F.flatten(F.transform(t, lambda r, i: F.when(i == 0, F.array(row(r), row(F.transform(r, lambda _: F.lit("---"))))).otherwise(F.array(row(r))))), "\n")
    return F.array_join(F.concat(F.filter(paragraphs, lambda p: strip(p) != ""), F.transform(tables, table)), "\n\n")


def docx_parts(content: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """Paragraphs outside tables, and tables as rows of cells."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    body = root.find(f"{_W}body")
    tables = [[[words(c) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    return [words(p) for p in body.findall(f"{_W}p")], tables


Cell = str | float | bool | None


def xlsx_cells(content: bytes) -> tuple[str, list[list[Cell]]]:
    """The name of a workbook's one sheet and its rows, blank ones left out; numbers and booleans stay what they are, more sheets are an error."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = [s.get("name", "") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")] if "xl/workbook.xml" in z.namelist() else []
    sheets = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
    if len(sheets) != 1:
        raise ValueError(f"a workbook needs one sheet, not {len(sheets)}")
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]

    def value(c: ET.Element) -> Cell:
        v, kind = c.find(f"{_S}v"), c.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_S}t"))
        if v is None or v.text is None:
            return None
        return {"s": lambda x: shared[int(x)], "b": lambda x: x.strip() in ("1", "true"), "n": float}.get(kind, str)(v.text)

    out = []
    for r in ET.fromstring(z.read(sheets[0])).iter(f"{_S}row"):
        cells: dict[int, Cell] = {}
        for n, c in enumerate(r.findall(f"{_S}c")):
            at = 0
            for ch in (c.get("r") or "").rstrip("0123456789"):
                at = at * 26 + ord(ch) - 64
            cells[at - 1 if at else n] = value(c)
        row = [cells.get(i) for i in range(max(cells, default=-1) + 1)]
        if any(x not in (None, "") for x in row):
            out.append(row)
    return names[0] if names else "", out


def shown(cell: Cell) -> str | None:
    """A cell as text: whole numbers have no point, booleans are true and false."""
    if isinstance(cell, bool):
        return str(cell).lower()
    return str(int(cell)) if isinstance(cell, float) and cell.is_integer() else None if cell is None else str(cell)


def xlsx_rows(content: bytes) -> list[list[str | None]]:
    return [[shown(x) for x in row] for row in xlsx_cells(content)[1]]


WORKBOOK = "path string, file_name string, sheet string, row int, headers array<string>, cells array<struct<text:string,number:double,flag:boolean>>, error string"


def read_workbooks(spark: SparkSession, path: str, at_a_time: int = 2000) -> DataFrame:
    """Rows of .xlsx workbooks with typed cells (``WORKBOOK``): of text, number and flag one is set, none in an empty cell.

    The first row that is not blank gives the headers, which stand in the row of number 0,
    with names for empty ones ("Spalte 3"); further rows have as many cells. A workbook
    without rows, with more than one sheet, or that cannot be read is one row with an error
    and stops no other; the older .xls format is such a case.
    """
    cell = pa.struct([("text", pa.string()), ("number", pa.float64()), ("flag", pa.bool_())])
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(cell), pa.string()]
    names = [c.split()[0] for c in WORKBOOK.split(", ")]

    def typed(x: Cell) -> dict:
        return {"text": x if isinstance(x, str) else None, "number": x if isinstance(x, float) else None, "flag": x if isinstance(x, bool) else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = where.rsplit("/", 1)[-1]
                try:
                    if not name.lower().endswith(".xlsx"):
                        raise ValueError("only .xlsx workbooks can be read")
                    sheet, rows = xlsx_cells(content)
                    if not rows:
                        raise ValueError("the workbook has no rows")
                    heads = [shown(h) or f"Spalte {i}" for i, h in enumerate(rows[0], 1)]
                    made = [(where, name, sheet, 0, heads, [], None)]
                    made += [(where, name, sheet, n, None, [typed(x) for x in (r + [None] * len(heads))[: len(heads)]], None) for n, r in enumerate(rows[1:], 1)]
                except Exception as e:  # one file's error is its row's
                    made = [(where, name, None, None, None, None, f"{type(e).__name__}: {e}")]
                for lo in range(0, len(made), at_a_time):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made[lo : lo + at_a_time], strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, WORKBOOK)


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """file_name, text, error of .docx and .xlsx files; a file that cannot be read has an error and stops nothing."""
    schema = "path string, paragraphs array<string>, tables array<array<array<string>>>, error string"
    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.list_(pa.string()))), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    made = docx_parts(content) if name.lower().endswith(".docx") else ([], [[[x or "" for x in r] for r in xlsx_rows(content)]])
                    row = (name, *made, None)
                except Exception as e:  # noqa: BLE001
                    row = (name, [], [], f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["path", "paragraphs", "tables", "error"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    return found.select(F.substring_index("path", "/", -1).alias("file_name"), blocks(F.col("paragraphs"), F.col("tables")).alias("text"), "error")


ITEMS = "array<struct<doc_id:long,page_idx:int,text:string,img_path:string,table_caption:array<string>,img_caption:array<string>,image_caption:array<string>,table_body:string>>"


def ocr_content(answers: DataFrame, doc: str, content: str) -> DataFrame:
    """Items of OCR answers whose content list is JSON text; bad JSON gives no items. Pages count from 1."""
    return answers.select(doc, F.posexplode(F.from_json(content, ITEMS)).alias("pos", "i")).select(doc, "pos", (F.coalesce("i.page_idx", F.lit(0)) + 1).alias("page"), "i.text", "i.img_path", "i.table_caption", "i.img_caption", "i.image_caption", "i.table_body")


def item_text() -> Column:
    """Text of an OCR item: its text, its captions, its table as pipe rows."""
    none = F.expr("cast(array() as array<string>)")
    captions = [F.coalesce(F.col(c), none) for c in ("table_caption", "img_caption", "image_caption")]
    parts = F.concat(F.array("text"), *captions, F.array(html_table_to_pipe(F.col("table_body"))))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
