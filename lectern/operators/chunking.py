"""From pages to chunks: headings, breadcrumbs, boilerplate, sentence packing."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.batches import slices, small_batches
from lectern.functions.text import strip

# Limits of the chunker, in tokens and characters.
CHUNK_TOKENS, OVERLAP_TOKENS = 256, 32
LEAST_CHARS, TABLE_PIPES, TABLE_LETTERS, LEAST_LETTERS = 30, 4, 40, 0.3

#: What ends a sentence that has begun: punctuation before white space, or two line feeds; white space behind it belongs to it.
END = re.compile(r"[.!?\n](?:(?<=[.!?])[.!?]*(?=\s)|(?<=\n)\n+)\s*")
# A token is a run of word characters, or one character that is neither word nor white space.
WORD, OTHER = 1, 2


@cache
def character_kinds() -> np.ndarray:
    """The kind of every code point; 0 is white space."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    kinds = np.zeros(len(every), np.uint8)
    for kind, pattern in ((WORD, r"\w+"), (OTHER, r"[^\w\s]+")):
        for m in re.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def token_starts(text: str) -> np.ndarray:
    """Where the tokens of a text begin, in order."""
    kind = character_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    first = kind != 0
    first[1:] &= (kind[1:] == OTHER) | (kind[:-1] != WORD)
    return np.flatnonzero(first)


def boilerplate(text: Column) -> Column:
    """Whether a chunk is too short, has few letters, or is filled with dots; tables with letters stay."""
    # inside a lambda a value is made once, outside it once for each place that it stands in
    once = lambda value, use: F.transform(F.array(value), use)[0]
    letters = lambda t: F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    pipes = lambda t: F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    judged = lambda t, n: (
        F.when(F.length(t) < LEAST_CHARS, True)
        .when((n >= TABLE_LETTERS) & (pipes(t) >= TABLE_PIPES), False)
        .when(n / F.length(t) < LEAST_LETTERS, True)
        .otherwise(F.length(F.regexp_replace(t, r"\.{5,}", "")) < F.length(t) * 0.5)
    )
    return once(strip(text), lambda t: once(letters(t), lambda n: judged(t, n)))


#: Levels of Markdown headings; where a line begins that is one (a line ends at a line feed alone).
LEVELS = 6
HEADING_STARTS = r"(?md)(?=^#{1,6}[^\S\n]+\S)"


def heading_rows(markdown: DataFrame, doc: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc, off, level, title (and the ``keep`` columns): a row for each heading, and one of level 0 for what stands before the first.

    A text is cut where its headings begin; offsets (characters from 0) are running sums of
    the lengths of the pieces, over rows that hold a length and a title and no text.
    """
    more = keep or []
    line = lambda s: F.substring_index(s, "\n", 1)
    piece = lambda s: F.struct(F.length(s).alias("n"), F.length(F.regexp_extract(line(s), r"^(#{1,6})\s+\S", 1)).alias("level"), F.regexp_extract(line(s), r"^#{1,6}\s+(.+?)\s*$", 1).alias("title"))
    # a text that begins with a heading has an empty piece before it
    every = F.concat(F.array(F.lit("")), F.split(text, HEADING_STARTS, -1))
    cut = markdown.select(doc, *more, F.posexplode(F.transform(every, piece)).alias("_pos", "_s"))
    off = F.sum("_s.n").over(W.partitionBy(doc).orderBy("_pos").rowsBetween(W.unboundedPreceding, -1))
    rows = cut.select(doc, *more, "_pos", F.coalesce(off, F.lit(0)).cast("int").alias("off"), F.col("_s.level").alias("level"), F.col("_s.title").alias("title"))
    return rows.where((F.col("level") > 0) | (F.col("_pos") == 0)).drop("_pos")


def breadcrumbs(rows: DataFrame, doc: str, off: str = "off", order: str = "kind", depth: int = 3) -> DataFrame:
    """``rows`` with ``breadcrumb``: the titles above each row's offset; a heading ends those of its level and below.

    An as-of join by window: rows with a level are headings, and each row looks up the last
    heading of each level at or before it. That of a level still stands if none of a higher
    level came after it. ``order`` puts headings before other rows of the same offset.
    """
    before = W.partitionBy(doc).orderBy(off, order).rowsBetween(W.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == n, F.struct(F.col(off).alias("off"), "title")), ignorenulls=True).over(before).alias(f"_h{n}") for n in range(1, LEVELS + 1)]
    at = lambda n: F.coalesce(F.col(f"_h{n}.off"), F.lit(-1))
    higher = lambda n: F.greatest(*[at(m) for m in range(1, n)], F.lit(-1)) if n > 1 else F.lit(-1)
    stack = F.array_compact(F.array(*[F.when(at(n) > higher(n), F.col(f"_h{n}.title")) for n in range(1, LEVELS + 1)]))
    return rows.select("*", *last).withColumn("breadcrumb", F.array_join(F.slice(stack, 1, depth), " > ")).drop(*[f"_h{n}" for n in range(1, LEVELS + 1)])


def page_at(anchors: Column, offset: Column) -> Column:
    """Page of the last anchor (struct(off, page), in order) that is not after an offset."""
    return F.element_at(F.filter(anchors, lambda a: a["off"] <= offset), -1)["page"]


def chunk_text(file_name: Column, crumb: Column, text: Column) -> Column:
    head = F.array_join(F.filter(F.array(file_name, crumb), lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    return F.when(head != "", F.concat(F.lit("["), head, F.lit("]\n\n"), text)).otherwise(text)


def sentences(text: str) -> list[tuple[int, str, int]]:
    """(offset, sentence, tokens); a sentence over the limit is cut at tokens."""
    ends, lo = [0], 0
    while lo < len(text):
        m = END.search(text, lo + 1)
        lo = m.end() if m else len(text)
        ends.append(lo)
    starts = token_starts(text)
    # no token lies across two sentences: each ends behind white space or with the text
    upto = np.searchsorted(starts, ends).tolist()
    out = []
    for lo, hi, i, j in zip(ends, ends[1:], upto, upto[1:]):
        if j - i > CHUNK_TOKENS:
            cuts = [lo, *starts[i + CHUNK_TOKENS : j : CHUNK_TOKENS].tolist(), hi]
            out += [(a, text[a:b], min(CHUNK_TOKENS, j - i - n * CHUNK_TOKENS)) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        elif j > i:
            out.append((lo, text[lo:hi], j - i))
    return out


def packed(text: str, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, str, int]]:
    """(offset, chunk, tokens): whole sentences up to the limit; the next chunk begins with the last sentences within the overlap."""
    out: list[tuple[int, str, int]] = []
    now: list[tuple[int, str, int]] = []
    size = 0
    for s in sentences(text):
        if now and size + s[2] > limit:
            out.append((now[0][0], "".join(x[1] for x in now).strip(), size))
            keep: list[tuple[int, str, int]] = []
            held = 0
            for x in reversed(now):
                if held + x[2] > overlap or held + x[2] + s[2] > limit:
                    break
                keep.insert(0, x)
                held += x[2]
            now, size = keep, held
        now.append(s)
        size += s[2]
    if now:
        out.append((now[0][0], "".join(x[1] for x in now).strip(), size))
    return out


def sentence_chunks(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, seq, offset, chunk, tokens. Sequential over the sentences of a page, hence Arrow batches, worked off in slices."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*keys).schema) + ", seq int, offset int, chunk string, tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keys)):
                at, made = [], []
                for i, t in enumerate(part.column(len(keys)).to_pylist()):
                    for n, c in enumerate(packed(t or "")):
                        at.append(i)
                        made.append((n, *c))
                cols = list(zip(*made, strict=True)) or [[]] * 4
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*keys, "seq", "offset", "chunk", "tokens"])

    small_batches(pages.sparkSession)
    return pages.select(*keys, text).mapInArrow(run, schema)


def chunked(markdown: DataFrame, doc: str, file_name: Column, text: str = "text") -> DataFrame:
    """chunk_id, doc, page, seq, breadcrumb, text, tokens: pages are cut apart, packed, filtered and given their headings.

    Ids are digests of place and text, so a retried task gives the same ones.
    """
    from lectern.operators.pages import split_pages

    heads = heading_rows(markdown.withColumn("_file", file_name), doc, text, ["_file"]).withColumn("kind", F.lit(0))
    # only a section's first chunk begins behind white space: sentences end with what follows them
    lead = F.length(F.regexp_extract("text", r"^[\s\p{Z}\x1c-\x1f\x85]*", 0))
    sections = split_pages(markdown, doc, text).withColumn("lead", lead)
    made = sentence_chunks(sections, [doc, "pos", "page", "base", "lead"])
    kept = made.where(~boilerplate(F.col("chunk")))
    at = F.col("base") + F.col("offset") + F.when(F.col("offset") == 0, F.col("lead")).otherwise(0)
    chunks = kept.select(doc, at.alias("off"), F.lit(1).alias("kind"), "pos", "seq", "page", "chunk", "tokens")
    lined = breadcrumbs(chunks.unionByName(heads, allowMissingColumns=True), doc)
    before = W.partitionBy(doc).orderBy("off", "kind").rowsBetween(W.unboundedPreceding, 0)
    found = lined.withColumn("_name", F.last("_file", ignorenulls=True).over(before)).where("kind = 1")
    return found.select(
        F.sha2(F.concat_ws("|", F.col(doc).cast("string"), F.coalesce(F.col("page").cast("string"), F.lit("")), "pos", "seq", "chunk"), 256).alias("chunk_id"),
        doc, "page", "pos", "seq", "breadcrumb", chunk_text(F.col("_name"), F.col("breadcrumb"), F.col("chunk")).alias("text"), "tokens",
    )


def row_chunks(table: DataFrame, columns: list[str], order: str) -> DataFrame:
    """row_index (from 1) and text: ``header: value`` lines of a table's rows, empty values and empty rows left out.

    ``order`` must number the rows from 0.
    """
    lines = F.concat_ws("\n", *[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])
    return table.select((F.col(order) + 1).alias("row_index"), lines.alias("text")).where("text <> ''")
