"""Operators on pages and lines of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import MARK, PAGE_ANCHOR, normal_line, strip


def page_lines(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, page, pos, line, k): lines in order, with their normal forms."""
    return pages.select(doc, page, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("k", normal_line(F.col("line")))


def repeating_lines(pages: DataFrame, doc: str, page: str, min_ratio: float = 0.5) -> DataFrame:
    """(doc, k, n): normal forms of lines on at least min_ratio of a document's pages, of three pages or more.

    Pages are counted apart from lines, so only (doc, page, k) is shuffled.
    """
    total = pages.groupBy(doc).agg(F.count("*").alias("total")).where("total >= 3")
    seen = page_lines(pages, doc, page).where(F.length(strip(F.col("line"))) > 2).select(doc, page, "k").distinct()
    return seen.groupBy(doc, "k").agg(F.count("*").alias("n")).join(total, doc).where(F.col("n") >= F.col("total") * min_ratio).select(doc, "k", "n")


def strip_repeating(pages: DataFrame, doc: str, page: str, min_ratio: float = 0.5) -> DataFrame:
    """(doc, page, text): pages without their documents' repeating lines."""
    kept = page_lines(pages, doc, page).join(repeating_lines(pages, doc, page, min_ratio), [doc, "k"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    made = kept.groupBy(doc, page).agg(text.alias("text"))
    return pages.select(doc, page).join(made, [doc, page], "left").withColumn("text", F.coalesce("text", F.lit("")))


def assemble_pages(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, total_pages, text_pages, text): page texts behind anchors, blank pages dropped."""
    full = strip(F.col("text")) != ""
    block = F.when(full, F.struct(F.col(page).alias("page"), F.concat(F.lit("<!-- page:"), F.col(page).cast("string"), F.lit(" -->\n"), F.col("text")).alias("block")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["block"]), "\n\n")
    return pages.groupBy(doc).agg(F.count("*").alias("total_pages"), F.count_if(full).alias("text_pages"), joined.alias("text"))


def degenerate(total_pages: Column, text_pages: Column, text_chars: Column) -> Column:
    """Whether an extraction gave so little text that it must not be indexed."""
    return (total_pages >= 1) & ((text_pages == 0) | ((total_pages >= 5) & (text_chars < 15 * total_pages)))


def split_pages(markdown: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, pos, page, base, text): sections between page anchors and where they begin; text before the first has no page; blank ones are dropped."""
    cut = markdown.select(doc, F.split(F.regexp_replace(text, PAGE_ANCHOR, f"{MARK}$1{MARK}{MARK}"), MARK).alias("_parts"), F.regexp_extract_all(text, F.lit(PAGE_ANCHOR), F.lit(0)).alias("_anchors"))
    # parts: preamble, then for each anchor its number, an empty one, and the section
    parts = F.col("_parts")
    sizes = F.transform("_anchors", lambda a, i: F.length(F.get(parts, 3 * i)) + F.length(a))
    cut = cut.select(doc, "_parts", sizes.alias("_sizes"))
    base = lambda i: F.aggregate(F.slice("_sizes", F.lit(1), i), F.lit(0), lambda n, x: n + x)
    sections = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / 3).cast("int")), lambda i: F.struct(i.alias("pos"), F.when(i > 0, F.get(parts, 3 * i - 2).cast("int")).alias("page"), base(i).alias("base"), F.get(parts, 3 * i).alias("text")))
    made = cut.select(doc, F.explode(sections).alias("s"), (F.size(parts) > 1).alias("_any")).select(doc, "s.pos", "s.page", "s.base", "s.text", "_any")
    return made.where((strip(F.col("text")) != "") | ~F.col("_any")).drop("_any")


def inject_anchors(md: Column, snippets: Column) -> Column:
    """``<!-- page:N -->`` before the place of each page's first snippet, found from where the last one was.

    ``snippets``: array of struct(page, snippet) in page order; texts with anchors of their own stay.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        found = F.position(s["snippet"], md, acc["at"])
        put = F.concat(acc["out"], F.substring(md, acc["at"], found - acc["at"]), F.lit("<!-- page:"), s["page"].cast("string"), F.lit(" -->\n"))
        return F.when(found > 0, F.struct(put.alias("out"), found.alias("at"))).otherwise(F.struct(acc["out"].alias("out"), acc["at"].alias("at")))

    done = F.aggregate(snippets, start, step, lambda acc: F.concat(acc["out"], F.substring(md, acc["at"], F.length(md))))
    keep = md.rlike(r"(?i)<!--\s*Page\s+\d+\s*-->") | (F.size(snippets) == 0)
    return F.when(keep, md).otherwise(F.regexp_replace(done, r"^\s+", ""))
