"""Hashed n-gram features of texts, and the bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed

#: Hashed features.
SPACE = 1 << 18

_SHAPES = [(re.compile(p), c) for p, c in ((r"[^\W\d_]+", ""), (r"\d+", "0"), (r"([^\w])\1{2,}", r"\1\1\1"))]


def shape(chunk: str) -> str:
    """What a chunk looks like: letters by case, digits, punctuation with long runs cut."""

    def letters(m: re.Match) -> str:
        s = m[0]
        return "a" if s.islower() else "A" if s.isupper() and len(s) > 1 else "Aa"

    out = _SHAPES[0][0].sub(letters, chunk)
    out = _SHAPES[1][0].sub("0", out)
    return _SHAPES[2][0].sub(_SHAPES[2][1], out)[:12]


class NGrams:
    """Indicators of words, pairs of words, and one to three shapes in a row."""

    KEEP = 200_000

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}
        self.flags = np.zeros(SPACE, bool)

    def of(self, text: str) -> np.ndarray:
        """Places of the features that the text has, ascending."""
        chunks = text.split()
        known = self.known
        new = {c for c in chunks if c not in known}
        if len(known) + len(new) > self.KEEP:
            known.clear()
            new = set(chunks)
        for c in new:
            word = c.lower().strip("\"'()[]{}.,;:!?*&%$#|-+=/<>") or c
            known[c] = xxhash.xxh3_64_intdigest("w" + word), xxhash.xxh3_64_intdigest("s" + shape(c))
        got = [known[c] for c in chunks]
        if not got:
            return np.zeros(0, np.int32)
        both = np.array(got, np.uint64)
        word, look = both[:, 0], both[:, 1]
        flags, mask = self.flags, np.uint64(SPACE - 1)
        with np.errstate(over="ignore"):
            pair = mixed(look[:-1] * np.uint64(3) + look[1:])
            for x in (word, look, mixed(word[:-1] * np.uint64(5) + word[1:]), pair, mixed(pair[:-1] * np.uint64(7) + look[2:])):
                flags[(x >> np.uint64(20)) & mask] = True
        out = np.flatnonzero(flags)
        flags[out] = False
        return out.astype(np.int32)


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, but: int | None, rows: int, make: Callable[[str], bytes]) -> tuple[list[bytes], np.ndarray]:
    """What ``make`` gives for at most ``rows`` labelled texts, and their labels.

    Only rows count whose crc32 of the doc_id as text, modulo ``fold``, is (but < 0: is not) as asked:
    ``but`` = r leaves remainder r out, ``but`` = ~r takes all remainders other than r. Rows are taken in
    the order of a hash of the doc_id, so the sample is the same in every run; its size bounds the broadcast.
    A doc_id with contradicting labels is left out, and of several texts of a doc_id the smallest by hash is taken,
    so repeated rows on either side change nothing.
    """
    remainder = F.crc32(F.col("doc_id").cast("string")) % fold
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(remainder != but)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("top")).where("y = top")
    chosen = chosen.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], names=["doc_id", "made", "y"])

    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("m")).select("doc_id", "m.text", "m.y")
    got = one.mapInArrow(run, "doc_id long, made binary, y int").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    made = got.column("made").to_pylist()
    return [made[i] for i in order], got.column("y").to_numpy()[order]


def held_out(fold: int, remainder: int):
    """Whether a document's labels were kept from the fit; null ids count as not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == remainder, F.lit(False))
