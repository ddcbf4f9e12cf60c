"""Text transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of personal data, in the order in which they are replaced.
PII = (
    ("EMAIL", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    ("PHONE", r"(?:\+43|0043|0)[\s\-/]?\d{1,4}[\s\-/]?\d{3,10}"),
    ("IP", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)
# A page's anchor, and what is a table, a row, a cell and a tag in HTML.
PAGE_ANCHOR = r"<!--\s*[Pp]age\s*[:.]?\s*(\d+)\s*-->"
HTML_TABLE = r"(?is)(<table\b[^>]*>.*?</table>)"
HTML_ROW, HTML_CELL, HTML_TAG = r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[hd][^>]*>(.*?)</t[hd]>", r"<[^>]+>"
MARK = "\u0001"


def strip(c: Column) -> Column:
    """Without white space at both ends (trim() takes blanks alone)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def redact_pii(c: Column) -> Column:
    for label, pattern in PII:
        c = F.regexp_replace(c, pattern, f"[{label}_REMOVED]")
    return c


def normal_line(line: Column) -> Column:
    """A line's form for comparing pages: numbers are #, white space is one blank."""
    return strip(F.regexp_replace(F.regexp_replace(strip(line), r"\d+", "#"), r"\s+", " "))


def generic_mask(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 2, F.repeat(F.lit("•"), n)).otherwise(F.concat(F.left(c, F.lit(1)), F.repeat(F.lit("•"), n - 2), F.right(c, F.lit(1))))


def redact_secret(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(F.length(c) <= 4, "****").otherwise(F.concat(F.lit("****"), F.right(c, F.lit(4))))


def format_score(c: Column) -> Column:
    c = F.when(c == 0, 0.0).otherwise(c)  # zero has no sign; what is rounded to it keeps its own
    return F.when(c.isNull(), "–").when(F.abs(c) >= 10, F.format_string("%.2f", c)).otherwise(F.format_string("%.3f", c))


def chunk_summary(c: Column) -> Column:
    t = collapse(F.coalesce(c, F.lit("")))
    return F.when(t == "", "(leerer Chunk)").when(F.length(t) > 120, F.concat(F.left(t, F.lit(120)), F.lit("…"))).otherwise(t)


def html_table_to_pipe(c: Column) -> Column:
    """Rows of an HTML table as pipe rows; without rows the text without tags."""
    plain = collapse(F.regexp_replace(c, HTML_TAG, ""))
    rows = F.transform(
        F.regexp_extract_all(c, F.lit(HTML_ROW), 1),
        lambda r: F.transform(F.regexp_extract_all(r, F.lit(HTML_CELL), 1), lambda x: collapse(F.regexp_replace(x, HTML_TAG, ""))),
    )
    full = F.filter(rows, lambda r: F.exists(r, lambda x: x != ""))
    lines = F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(plain)


def convert_html_tables(c: Column) -> Column:
    """Every table inside a text as pipe rows; the rest stays."""
    marked = F.regexp_replace(c, HTML_TABLE, f"{MARK}$1{MARK}")
    parts = F.transform(F.split(marked, MARK), lambda p: F.when(F.lower(p).startswith("<table"), html_table_to_pipe(p)).otherwise(p))
    return F.when(F.lower(c).contains("<table"), F.array_join(parts, "")).otherwise(c)


def safe_name(c: Column) -> Column:
    return F.translate(c, "/\\", "__")


def stored_path(digest: Column, use_case: Column, name: Column) -> Column:
    """Content address of an original: use case / first two digits / first twelve digits and name."""
    return F.concat_ws("/", use_case, F.left(digest, F.lit(2)), F.concat_ws("_", F.left(digest, F.lit(12)), safe_name(name)))


def csv_field(c: Column) -> Column:
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


# Artefacts around an answer, in the order in which they are cut.
ANSWER_CUTS = (
    r"^[\s*]*FINAL_ANSWER\s*\(\s*\{?\s*",
    r'^[\s*]*"answer"\s*:\s*"?\s*',
    r'(?s)["\s]*,\s*"extras"\s*:\s*\{.*$',
    r"\s*\}?\s*\)\s*$",
    r"(?m)^[ \t*]*(?:THOUGHT|ACTION|OBSERVATION|FINAL_ANSWER)[:({\s].*$",
)
NO_ANSWER = "Die Anfrage konnte nicht vollständig beantwortet werden. Bitte präzisieren Sie Ihre Frage."


def clean_answer(c: Column) -> Column:
    for pattern in ANSWER_CUTS:
        c = F.regexp_replace(c, pattern, "")
    c = F.regexp_replace(strip(c), r'^[" \n]+|[" \n]+$', "")
    c = strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))
    return F.when(c == "", NO_ANSWER).otherwise(c)


def clean_synthesized(c: Column) -> Column:
    c = F.regexp_replace(strip(c), r"^```(?:\w+)?\s*", "")
    c = F.regexp_replace(c, r"\s*```\s*$", "")
    c = F.regexp_replace(c, r"(?i)^\s*(?:FINAL_ANSWER|ANTWORT)\s*[:(]\s*", "")
    return F.regexp_replace(c, r'^[" \n]+|[" \n]+$', "")
