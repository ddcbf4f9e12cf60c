"""Shared pieces of the corpus operators: the shared folder, tables written to it, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.batches import slices as slices
from lectern.batches import small_batches
from lectern.session import fresh_path as fresh_path
from lectern.session import removed as removed
from lectern.session import spread
from lectern.session import written as written_table

MASK = (1 << 64) - 1


def bounded(spark: SparkSession) -> None:
    """From now on Arrow batches are small, and Parquet's column chunks are not read whole into memory beside the heap,
    so that an executor's memory does not follow the size of files and partitions."""
    small_batches(spark)
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    bounded(df.sparkSession)
    return written_table(df, name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def partitions(spark: SparkSession, factor: int = 1) -> int:
    """Shuffle partitions of the session, for explicit repartitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * factor)


def filtered(keep: Callable[[str], bool]) -> Callable:
    """An Arrow batch function that keeps the rows whose text (null: empty) ``keep`` accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, at):
                yield part.filter(pa.array([keep(t or "") for t in part.column(at).to_pylist()], pa.bool_()))

    return run


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the things of one operator (key[0]), so that caches of several do not add up."""
    if key not in _kept:
        for k in [k for k in _kept if k[0] != key[0]]:
            del _kept[k]
        _kept[key] = make()
    return _kept[key]


def group_ids(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Numbers of the runs of equal keys in a table sorted by them; null equals null."""
    new = np.zeros(table.num_rows, bool)
    for c in keys:
        codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of some ``rows`` rows, or of one larger group, that hold whole groups of a partition sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    size, least = 0, rows
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.searchsorted(ids := group_ids(table, keys), ids[-1]))
        if cut:
            yield table.slice(0, cut)
        held, size = table.slice(cut).to_batches(), size - cut
        least = max(rows, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


def by_text(make: Callable[[list[str]], dict[str, list]], schema: pa.Schema, column: str = "text") -> Callable:
    """An Arrow batch function: ``make`` gets the texts of a batch (null: empty) and returns new columns.

    Other columns of ``schema`` are passed through from the input batch by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                made = make([t or "" for t in part.column(column).to_pylist()])
                cols = [pa.array(made[f.name], f.type) if f.name in made else part.column(f.name).cast(f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; a shorter text is one shingle, an empty one has none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return out


#: ASCII whitespace is what bytes.split() splits at: \x20 and \x09-\x0D; bytes.lower() changes A-Z only.
def lower_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


#: A bitmap has 16 bits for each entry, but not more than 2**BITMAP bits (32 MB); beyond that it lets more rows pass.
BITMAP = 28


def fits_bitmap(n: int) -> bool:
    """Whether a bitmap of the greatest size still tells n entries from others."""
    return 16 * n <= 1 << BITMAP


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """Bits of the low bits of hashes (one long column). It is built in pieces on the executors; its size is bounded."""
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, hashes.count()))), 18, BITMAP))
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & mask
            for piece in np.unique(at >> np.uint64(15)).tolist():
                of = (at[at >> np.uint64(15) == piece] & np.uint64(32767)).astype(np.int64)
                pieces.setdefault(piece, np.zeros(32768, bool))[of] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([np.packbits(x).tobytes() for x in pieces.values()], pa.binary())], names=["piece", "bits"])

    piece = F.shiftright(F.col(hashes.columns[0]).bitwiseAND(F.lit(int(mask))), 15)
    got = hashes.repartition(partitions(hashes.sparkSession), piece).mapInArrow(run, "piece long, bits binary").toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for p, b in zip(got.column("piece").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[p * 4096 : (p + 1) * 4096] |= np.frombuffer(b, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
