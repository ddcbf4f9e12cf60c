"""Benchmark decontamination with SimHash over item-sized windows.

Every item of the benchmark has a SimHash fingerprint of its five-word shingles.  A
document is read with windows of the items' sizes; a window starts where a shingle of
an item of that size starts.  (Moving a window on to its first such shingle loses no
match and brings in no more words, so the best window of each size is among these.)
Fingerprints are looked up in a multi-index: 64 bits in eight blocks; two fingerprints
that differ in at most RADIUS bits differ in at most RADIUS // 8 bits in some block, so
the items near in some block hold all items within the radius.  These candidates
are verified by the exact similarity of shingles weighted by how often they occur.

RADIUS is far out: at a similarity of 0.8 fingerprints differ in 10 of 64 bits in the
mean, and in more than 23 with a probability below 1e-5.

Rows: null and empty texts match nothing, nor do items without words; an item of under
five words is one shingle; of equally similar windows the first counts; repeated rows
give repeated results; long texts are worked off by themselves; an empty table, or a benchmark
without items, gives no rows; other columns, whatever their names, are not read.  Items are taken in blocks of
BLOCK_ITEMS, each searched against all documents, so the benchmark may grow.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, shingle_hashes, slices, word_hashes

WIDTH, LEAST = 5, 0.8
RADIUS, BLOCKS = 23, 8
#: Items, and words in them, that are searched at a time: what is sent to the executors stays below some 30 MB.
BLOCK_ITEMS, BLOCK_WORDS = 10_000, 1_000_000

#: Words are runs without white space and ASCII punctuation, in lower case.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def fingerprints(tokens: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of tokens[s : s + size] for each start; windows at the end are shorter."""
    out = np.zeros(len(starts), np.uint64)
    step = max(1, 50_000 // size)
    for lo in range(0, len(starts), step):
        at = starts[lo : lo + step, None] + np.arange(size)
        inside = at < len(tokens)
        bits = np.unpackbits(tokens[np.where(inside, at, 0)].view(np.uint8).reshape(*at.shape, 8), axis=2)
        ones = np.einsum("wsb,ws->wb", bits, inside, dtype=np.int32)
        out[lo : lo + step] = np.packbits(2 * ones > inside.sum(1)[:, None], axis=1).view(np.uint64).ravel()
    return out


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (a.total() + b.total() - both)


class Index:
    """A block of items: where windows start, the multi-index over fingerprints, and the weighted shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.bags, prints, self.sizes = [], [], [], []
        first: dict[int, dict[int, set[int]]] = {}  # shingle width: shingle: window sizes
        for item, text in items:
            words = plain_words(text or "")
            if not words:
                continue
            k = min(WIDTH, len(words))
            s = shingle_hashes(word_hashes(words), k)
            self.ids.append(item)
            self.bags.append(Counter(s.tolist()))
            self.sizes.append((k, len(s)))
            prints.append(fingerprints(s, np.zeros(1, np.int64), len(s))[0])
            for x in set(s.tolist()):
                first.setdefault(k, {}).setdefault(x, set()).add(len(s))
        self.prints = np.array(prints, np.uint64)
        self.starts = {}
        for k, of in first.items():
            by_size: dict[int, list[int]] = {}
            for x, sizes in of.items():
                for n in sizes:
                    by_size.setdefault(n, []).append(x)
            known = np.sort(np.array(list(of), np.uint64))
            maybe = np.zeros(1 << 22, bool)
            maybe[known & np.uint64(len(maybe) - 1)] = True
            self.starts[k] = known, np.packbits(maybe), {n: np.sort(np.array(x, np.uint64)) for n, x in by_size.items()}
        n = len(self.ids)
        self.of_size = {size: np.packbits([x == size for x in self.sizes]) for size in set(self.sizes)}
        blocks = self.prints.view(np.uint8).reshape(n, BLOCKS) if n else np.zeros((0, BLOCKS), np.uint8)
        values = np.arange(256, dtype=np.uint8)
        self.near = [np.packbits(np.bitwise_count(values[:, None] ^ blocks[:, b]) <= RADIUS // BLOCKS, axis=1) for b in range(BLOCKS)]
        self._maybe: dict[int, np.ndarray] = {}

    def lookup(self, prints: np.ndarray, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of all items of the size within RADIUS."""
        raw = prints.view(np.uint8).reshape(len(prints), BLOCKS)
        found = self.near[0][raw[:, 0]]
        for b in range(1, BLOCKS):
            found = found | self.near[b][raw[:, b]]
        found &= self.of_size[size]
        window, item = np.nonzero(np.unpackbits(found, axis=1, count=len(self.ids)))
        ok = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[ok], item[ok]

    def search(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window for each item that is similar enough."""
        hashed = word_hashes(plain_words(text))
        best: dict[int, tuple[float, int, int]] = {}
        for k, (known, packed, by_size) in self.starts.items():
            if len(hashed) < k:
                continue
            if k not in self._maybe:
                self._maybe[k] = np.unpackbits(packed).view(bool)
            tokens = shingle_hashes(hashed, k)
            at = np.flatnonzero(self._maybe[k][tokens & np.uint64(len(self._maybe[k]) - 1)])
            at = at[np.isin(tokens[at], known)] if len(at) else at
            if not len(at):
                continue
            for size, starters in by_size.items():
                starts = at[np.isin(tokens[at], starters)]
                for lo in range(0, len(starts), 1000):
                    part = starts[lo : lo + 1000]
                    for w, i in zip(*self.lookup(fingerprints(tokens, part, size), (k, size)), strict=True):
                        s = int(part[w])
                        got = similarity(Counter(tokens[s : s + size].tolist()), self.bags[i])
                        if got >= LEAST and got > best.get(i, (0.0,))[0]:
                            best[i] = got, s, min(size + k - 1, len(hashed) - s)
        return [(self.ids[i], *found) for i, found in best.items()]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    held, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        held.append((row[0], row[1]))
        words += len(row[1].split())
        if len(held) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


LEAK = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity and place of the best window, for every document and item that match."""
    spark = docs.sparkSession
    out = None
    for items in _blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1):
                    rows = [(d, *x) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t for x in index.value.search(t)]
                    cols = list(zip(*rows, strict=True)) or [[]] * 5
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in LEAK.split(", ")])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LEAK)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], LEAK) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns as they were, in which no item is found. Rows without a doc_id are judged by their text too."""
    spark = docs.sparkSession
    out = docs
    for items in _blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(items))

        out = out.mapInArrow(filtered(lambda t, index=index: not t or not index.value.search(t)), docs.schema)
    return out
