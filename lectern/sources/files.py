"""Files: formats, dispatch, names, content addresses, text and CSV pages."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.places import placed

# The formats that are read, and the media types that are shown inline.
FORMATS = (".csv", ".docx", ".md", ".pdf", ".txt")
INLINE = {".pdf": "application/pdf", ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv"}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def dispatched(files: DataFrame, name: str = "file_name") -> DataFrame:
    """With the extension, whether it is supported, and an error that lists what is."""
    ext = extension(F.col(name))
    known = ext.isin(*FORMATS)
    return files.withColumns({"ext": ext, "supported": known, "error": F.when(~known, F.concat(F.lit("Unsupported format '"), ext, F.lit(f"'. Supported: {', '.join(sorted(FORMATS))}")))})


def named_files(docs: DataFrame) -> DataFrame:
    """The test documents as files of seven endings, two of them not supported."""
    endings = F.array(*[F.lit(e) for e in (".csv", ".DOCX", ".md", ".Pdf", ".txt", ".xyz", "")])
    return docs.withColumn("file_name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.element_at(endings, (F.col("doc_id") % 7 + 1).cast("int"))))


def display_name(path: Column) -> Column:
    """The name that a stored original is shown under: what follows the first underscore."""
    base = F.substring_index(path, "/", -1)
    return F.regexp_replace(base, r"^[^_]*_", "")


def media_type(name: Column) -> Column:
    ext = extension(name)
    return reduce(lambda out, kv: out.when(ext == kv[0], kv[1]), INLINE.items(), F.when(F.lit(False), ""))


def resolved_path(wanted: DataFrame, stored: DataFrame, path: str = "path") -> DataFrame:
    """``wanted`` with ``resolved``: its path if an original is stored under it, else null. ``stored`` has each path once."""
    known = stored.select(F.col(path), F.col(path).alias("resolved"))
    return wanted.join(known, path, "left")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files: one page each, bytes that are no UTF-8 become U+FFFD."""
    text = F.expr("make_valid_utf8(cast(content as string))")
    return spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file_name"), F.lit(1).alias("page"), text.alias("text"), F.sha2("content", 256).alias("file_hash"))


#: Rows of a CSV file that go on as one Arrow batch.
CSV_ROWS = 5000
CSV_FILE = "path string, file_name string, page int, text string, row_count long, columns array<string>, error string"


def read_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files as pages, in the order of their records, beside a row of page 0 for each file (``CSV_FILE``).

    Fields are those of the usual dialect: commas, doubled quotes, line breaks inside quotes,
    no types; a byte-order mark is left out. Page 1 is the header, the record behind it page
    2, and so on; cells are joined by " | ". Page 0 has the number of records behind the
    header and the header's cells. A file of a mark alone has page 0 alone, with no columns
    (Spark's file source leaves files of no bytes out, so they have no row); a file that is no UTF-8 or cannot be cut into records has page 0 alone, with its error, and
    stops no other. A file is read by one task, and goes on in batches of rows.
    """
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
    names = [c.split()[0] for c in CSV_FILE.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    # once to see that all of it can be read, once for the rows
                    text = content.decode("utf-8-sig")
                    header = next(csv.reader(io.StringIO(text, newline="")), [])
                    size = sum(1 for _ in csv.reader(io.StringIO(text, newline="")))
                except (UnicodeDecodeError, csv.Error) as e:
                    yield made([(path, name, 0, None, 0, [], f"{type(e).__name__}: {e}")])
                    continue
                rows = [(path, name, 0, None, max(0, size - 1), header, None)]
                for n, row in enumerate(csv.reader(io.StringIO(text, newline="")), 1):
                    rows.append((path, name, n, " | ".join(row), None, None, None))
                    if len(rows) == CSV_ROWS:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CSV_FILE)


def csv_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """line (from 1) and text of a table as pipe text, with its row_count and columns beside each: the header, a rule, and a line for each row.

    Lines joined in order by line feeds are the whole text. Nulls are empty cells. Rows are
    numbered in ``order``, whatever values that holds, by a range sort; rows that tie in it must be equal.
    """
    cells = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), " | ")
    head = rows.sparkSession.createDataFrame([(1, " | ".join(columns)), (2, " | ".join("---" for _ in columns))], "line long, text string")
    body = placed(rows, [], order, "_place").select((F.col("_place") + 3).alias("line"), cells.alias("text"))
    # one row, there for an empty table too
    size = rows.agg(F.count("*").alias("row_count"))
    return head.unionByName(body).crossJoin(F.broadcast(size)).withColumn("columns", F.lit(", ".join(columns)))


def csv_pages(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Pages of a table: the header is page 1, each row one more. ``order`` must hold 0, 1, 2 and so on."""
    cells = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), " | ")
    spark = rows.sparkSession
    head = spark.createDataFrame([(1, " | ".join(columns))], "page long, text string")
    return head.unionByName(rows.select((F.col(order) + 2).cast("long").alias("page"), cells.alias("text")))


def dual_delimiter_fields(line: Column) -> Column:
    """Fields of a CSV line in which both comma and semicolon separate; doubled quotes stand for one."""
    raw = F.regexp_extract_all(F.concat(F.replace(line, F.lit("\r"), F.lit("")), F.lit(",")), F.lit(r'((?:[^",;]|"(?:[^"]|"")*")*)[,;]'), 1)
    unquoted = lambda x: F.regexp_replace(F.regexp_replace(x, r'"((?:[^"]|"")*)"', "\u0001$1\u0001"), "\u0001", "")
    return F.transform(raw, lambda x: F.replace(unquoted(x), F.lit('""'), F.lit('"')))


def table_headers(header: Column, width: Column) -> Column:
    """Headers with names for empty ones, as many as the table is wide."""
    return F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.nullif(F.get(header, i - 1), F.lit("")), F.concat(F.lit("Spalte "), i.cast("string"))))
