"""Model-backed steps behind small interfaces, with deterministic defaults.

Each provider maps columns to a column, so a default can be a native expression or, as the
embedder's, an Arrow-batched UDF, which a real model is too.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.batches import slices, small_batches
from lectern.operators.places import placed

Provider = Callable[..., Column]

_providers: dict[str, Provider] = {}


def provide(role: str, provider: Provider) -> None:
    _providers[role.lower()] = provider


def provider(role: str) -> Provider:
    try:
        return _providers[role.lower()]
    except KeyError:
        raise ValueError(f"no provider for {role!r}; known: {', '.join(sorted(_providers))}") from None


#: Items that a batched provider is called with at a time.
BATCH = 50


def attempted(call: Callable[[list], list], kind: str, size: int = BATCH) -> Provider:
    """A provider from a function on lists: struct(value, error) for each item.

    The function gets slices of ``size`` items of an Arrow batch. Where a slice fails, each
    of its items is tried alone, and one that fails has its error and no value; the others
    are not lost. A null item is not sent and has neither.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            items = [None if isinstance(x, float) and x != x else x for x in batch]
            values: list = [None] * len(items)
            errors: list = [None] * len(items)
            there = [i for i, x in enumerate(items) if x is not None]
            for lo in range(0, len(there), size):
                part = there[lo : lo + size]
                try:
                    for i, v in zip(part, call([items[i] for i in part]), strict=True):
                        values[i] = v
                except Exception:
                    for i in part:
                        try:
                            values[i] = call([items[i]])[0]
                        except Exception as e:
                            errors[i] = str(e) or type(e).__name__
            yield pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    # the annotations say what kind of Arrow function this is
    return F.pandas_udf(run, f"struct<value:{kind},error:string>")


def embedded_batch(chunks: DataFrame, call: Callable[[list], list], order: list[str], chunk_id: Column | None = None, text: str = "text", size: int = BATCH) -> DataFrame:
    """The chunks with their place (``i``, from 0), batch_id, chunk_id, vector, dimension and error.

    Places count in the order given over all chunks, by a range sort; a batch is ``size``
    of them. ``call`` makes vectors of a list of texts (``attempted``); a chunk without a
    vector is a row of its own with an error, and its batch's others are not lost.
    """
    small_batches(chunks.sparkSession)
    lined = placed(chunks, [], order, "i")
    named = F.concat(F.lit("chunk_"), F.col("i").cast("string"))
    made = lined.withColumns({"batch_id": F.floor(F.col("i") / size).cast("long"), "chunk_id": F.coalesce(chunk_id, named) if chunk_id is not None else named, "_v": attempted(call, "array<double>", size)(F.col(text))})
    missing = F.concat(F.lit("Missing vector for chunk "), F.col("chunk_id"), F.when(F.col("_v.error").isNotNull(), F.concat(F.lit(": "), "_v.error")).otherwise(""))
    return made.select(*chunks.columns, "i", "batch_id", "chunk_id", F.col("_v.value").alias("vector"), F.size("_v.value").alias("dimension"), F.when(F.col("_v.value").isNull(), missing).alias("error"))


def batch_report(embedded: DataFrame) -> DataFrame:
    """batch_id, total, success, failed, and the errors of each batch in order."""
    errors = F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("i", "error")))), lambda x: x["error"])
    return embedded.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count("error").alias("failed"), errors.alias("errors"))


def describe_image(context: Column) -> Column:
    """Alternative text of an image, given the text around it."""
    return provider("vision")(context)


def embed(text: Column) -> Column:
    return provider("embedding")(text)


#: Dimension of the default embedder.
DIMENSION = 32
#: Which bytes are part of words: of ASCII letters, digits and underscores; others are not ASCII and were cut before.
IN_WORD = np.array([c > 127 or chr(c).isalnum() or chr(c) == "_" for c in range(256)])
#: Table of the crc32, and bytes of words that are hashed together; longer ones are hashed one by one.
CRC, LONG_WORD = np.arange(256, dtype=np.uint32), 64
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1)


def crc32s(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """crc32 of many stretches of bytes, one byte of all that are long enough at a time."""
    sizes = np.minimum(stops - starts, LONG_WORD + 1).astype(np.uint8)
    order = np.argsort(sizes, kind="stable")[::-1]
    at, crc = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    # how many are longer than p, which stand first
    longer = len(order) - np.searchsorted(sizes[order][::-1], np.arange(LONG_WORD + 1), "right")
    for p, n in enumerate(longer[:LONG_WORD]):
        if not n:
            break
        crc[:n] = CRC.take(crc[:n].astype(np.uint8) ^ data.take(at[:n] + p)) ^ crc[:n] >> 8
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in order[: longer[LONG_WORD]]:
        out[i] = zlib.crc32(data[starts[i] : stops[i]])
    return out


def word_counts(texts: pa.Array, dimension: int) -> np.ndarray:
    """How many words of each text fall in each dimension, which the word's crc32 gives; a word is letters, numbers and underscores."""
    kept = pc.replace_substring_regex(pc.fill_null(texts, ""), r"[^\x00-\x7F\p{L}\p{N}]+", " ")
    _, offsets, bytes_ = kept.buffers()
    ends = np.frombuffer(offsets, np.int32)[kept.offset : kept.offset + len(kept) + 1]
    data = np.frombuffer(bytes_, np.uint8)[ends[0] : ends[-1]] if bytes_ is not None and bytes_.size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD.take(data)
    edges = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32)
    # a word also ends where its text does
    cut = np.unique(ends)
    cut = cut[inside[cut] & inside[cut + 1]]
    starts, stops = (np.sort(np.concatenate([x, cut]), kind="stable") for x in (edges[::2], edges[1::2]))
    of = np.repeat(np.arange(len(kept)), np.diff(np.searchsorted(starts, ends)))
    return np.bincount(of * dimension + crc32s(data, starts, stops) % np.uint32(dimension), minlength=len(kept) * dimension).reshape(-1, dimension)


def hash_embed(text: Column, dimension: int = DIMENSION) -> Column:
    """Feature hashing of words: a word adds 1 to the dimension that its crc32 gives. A null text has no words.

    Words are cut, hashed and counted in Arrow batches, a slice of bounded bytes at a time.
    """

    def vectors(texts: pa.Array) -> pa.Array:
        parts = [word_counts(s.column(0), dimension) for s in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        counts = np.concatenate([np.zeros((0, dimension)), *parts])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * dimension, pa.int32()), pa.array(counts.ravel()))

    return F.arrow_udf(vectors, "array<double>")(F.lower(text))


provide("vision", lambda context: F.concat(F.lit("Bild zu "), F.left(context, F.lit(20))))
provide("embedding", hash_embed)
