"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Ids are counted over all documents; package-merge gives the best code lengths of at
most LIMIT bits, and the canonical code follows from the lengths.  Documents in
ascending doc_id order are cut into blocks of whole documents, each of which begins at
a whole byte.  A block row holds the bit stream, the bit offset of every STEP-th id of
each document, and the documents' ids and lengths, so blocks are decoded apart from
each other, and all checkpoints of a block in lockstep, LIMIT bits at a time through a
table.

Files: ``<path>/codes`` (id, count, bits) and ``<path>/blocks``, both Parquet.

Rows: null and empty texts are just the end id; a long text is a block of its own;
repeated rows are written each; rows without doc_id come first; rows of one doc_id, or
of none, are in the order of a hash of their ids, so every run writes the same; an
empty table gives empty files; other columns, whatever their names, are not written.
"""

from __future__ import annotations

import array
import gc
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .bpe import byte_symbols
from .common import fresh_path, kept, partitions, removed, slices

#: Longest code in bits; ids in a block; ids between checkpoints.
LIMIT, BLOCK, STEP = 18, 1 << 18, 128
#: Words that a worker's cache holds before it starts anew.
KEEP = 600_000


# How byte-level BPE cuts text into pieces, and up to where alphabets are the same in all tables.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LATIN = "\u024f"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Ids as the tokenizers library gives them, asked once for each piece.

    A space with other characters on both sides always begins a new piece of byte-level
    BPE, so what lies between such spaces can be encoded alone; texts in which a chunk
    is empty or has white space at an edge, and chunks with special tokens or letters
    beyond Latin, are encoded by the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.kind = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.symbols = byte_symbols()
        self.raw = [np.array([i], self.kind).tobytes() for i in range(self.tok.get_vocab_size())]
        self.pieces: dict[str, bytes] = {}
        self.first, self.rest = Chunks(self, ""), Chunks(self, " ")
        # with such tokens a text could not be cut at spaces, or letters with punctuation behind them could hold one
        if any(" " in s or s.rstrip(PUNCTUATION).isalpha() for s in self.special):
            raise ValueError("added tokens with spaces or of letters alone are not supported")

    def whole(self, text: str) -> bytes:
        return array.array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def tokens(self, symbols: str) -> bytes:
        got, raw = self.model.tokenize(symbols), self.raw
        return raw[got[0].id] if len(got) == 1 else b"".join([raw[t.id] for t in got])

    def piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            symbols = self.symbols
            got = self.pieces[p] = self.tokens("".join([symbols[b] for b in p.encode()]))
        return got

    def ids(self, texts: list[str]) -> list[bytes]:
        for known in (self.first, self.rest, self.pieces):
            if len(known) > KEEP:
                known.clear()
        running = gc.isenabled()
        gc.disable()  # nothing here has cycles
        try:
            return [self._ids(t) for t in texts]
        finally:
            if running:
                gc.enable()

    def _ids(self, text: str) -> bytes:
        chunks = text.split(" ")
        head = chunks.pop(0)
        try:
            return self.first[head] + b"".join(map(self.rest.__getitem__, chunks))
        except TypeError:  # a chunk that can't be encoded alone
            return self.whole(text)


class Chunks(dict):
    """Ids of chunks that ``lead`` comes before, learned when they are asked for; None for what can't be encoded alone."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead
        self.front = "".join([encoder.symbols[b] for b in lead.encode()])

    def __missing__(self, c: str) -> bytes | None:
        e = self.encoder
        core = c.rstrip(PUNCTUATION)
        if core.isalpha():  # letters, and perhaps one piece of punctuation behind them
            got = self.get(core)
            if got is None:
                if core.isascii():  # their own symbols
                    got = e.tokens(self.front + core)
                elif max(core) > LATIN:
                    got = e.whole(self.lead + c)
                    core = c
                else:
                    got = e.tokens("".join([e.symbols[b] for b in (self.lead + core).encode()]))
                self[core] = got
            if len(core) < len(c):
                got = self[c] = got + e.piece(c[len(core) :])
            return got
        if not c or c[0].isspace() or c[-1].isspace():
            got = None
        elif not c.isascii() and max(c) > LATIN or any(s in c for s in e.special):
            got = e.whole(self.lead + c)
        else:
            got = b"".join([e.piece(p) for p in PIECES.findall(self.lead + c)])
        self[c] = got
        return got


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return kept(("tokens", path), lambda: Encoder(path))


# codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths (0: not used) by package-merge; ``limit`` is raised if there are too many ids for it."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    if limit > 24:
        raise ValueError("too many ids for the decoding table")
    used = used[np.lexsort((used, counts[used]))]
    leaf = counts[used].astype(np.int64)
    level, flags = leaf, []
    for _ in range(limit):
        packed = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, packed])
        order = np.argsort(both, kind="stable")
        flags.append(order < len(leaf))
        level = both[order]
    # the lists were leaf, then limit times packages of the list before merged with leaves; the first one is all leaves
    flags = [np.ones(len(leaf), bool), *flags[:-1]]
    take = 2 * (len(leaf) - 1)
    for is_leaf in reversed(flags):
        n = int(is_leaf[:take].sum())
        out[used[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    used = np.flatnonzero(bits)
    used = used[np.lexsort((used, bits[used]))]
    out = np.zeros(len(bits), np.uint64)
    code = last = 0
    for i in used.tolist():
        code <<= int(bits[i]) - last
        last = int(bits[i])
        out[i] = code
        code += 1
    return out


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each document (``lengths`` ids) its bit stream, high bits first, and the bit offsets of every STEP-th id."""
    size = bits[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    end = np.cumsum(lengths)
    first = end - lengths
    wide = total[end] - total[first]
    taken = (wide + 7) // 8
    begin = np.cumsum(taken) - taken
    # documents begin at whole bytes
    within = total[:-1] - np.repeat(total[first], lengths)
    at = within + np.repeat(begin * 8, lengths)
    code = codes[ids] << (64 - size).astype(np.uint64)
    word, off = at >> 6, (at & 63).astype(np.uint64)
    buffer = np.zeros(int(taken.sum()) // 8 + 2, np.uint64)
    if len(ids):
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        buffer[word[start]] = np.bitwise_or.reduceat(code >> off, start)
        over = np.flatnonzero((at & 63) + size > 64)
        buffer[word[over] + 1] |= code[over] << (np.uint64(64) - off[over])
    raw = buffer.astype(">u8").tobytes()
    streams = [raw[b : b + n] for b, n in zip(begin.tolist(), taken.tolist(), strict=True)]
    return streams, [within[f:e:STEP].astype("<u4").tobytes() for f, e in zip(first.tolist(), end.tolist(), strict=True)]


class Table:
    """Decoding table: the id and its bits for every run of as many bits as the longest code has."""

    def __init__(self, bits: np.ndarray):
        self.wide = int(bits.max(initial=1))
        codes = canonical(bits)
        used = np.flatnonzero(bits)
        used = used[np.lexsort((used, bits[used]))]
        share = 1 << (self.wide - bits[used])
        self.id = np.zeros(1 << self.wide, np.uint32)
        self.bits = np.ones(1 << self.wide, np.uint8)
        full = int(share.sum())
        self.id[:full] = np.repeat(used, share)
        self.bits[:full] = np.repeat(bits[used], share)
        self.codes = codes

    def unpack(self, stream: bytes, checkpoints: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ids of documents that lie one after the other: all checkpoints (bit offsets in the stream) in lockstep."""
        raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, out = checkpoints.astype(np.int64), np.zeros((len(checkpoints), STEP), np.uint32)
        last, mask = len(window) - 1, np.uint32((1 << self.wide) - 1)
        lanes = -(-lengths // STEP)
        # the last stretch of a document is shorter
        ends = np.cumsum(lanes) - 1
        held = np.full(len(checkpoints), STEP)
        held[ends[lanes > 0]] = (lengths - (lanes - 1) * STEP)[lanes > 0]
        for i in range(int(held.max(initial=0))):
            seen = window[np.minimum(at >> 3, last)] >> (32 - self.wide - (at & 7)).astype(np.uint32) & mask
            out[:, i] = self.id[seen]
            at += self.bits[seen]
        return out[np.arange(STEP) < held[:, None]]


# files


TOKENS = "doc_id long, ids binary, counts binary"


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id and ids (little-endian bytes of the encoder's kind, with the end id) of every text.

    The last row of a task has no ids; its ``counts`` say how often the task has met each id.
    """
    kinds = {"doc_id": pa.int64(), "ids": pa.binary(), "counts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        tail = np.array([end], tok.kind).tobytes()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [x + tail for x in tok.ids([t or "" for t in part.column(1).to_pylist()])]
                n = np.bincount(np.frombuffer(b"".join(ids), tok.kind))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=list(kinds))
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, total.astype("<i8").tobytes()), kinds.values(), strict=True)], names=list(kinds))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS)


BLOCKS = "shard int, block long, first long, n_ids long, stream binary, checkpoints binary, docs array<long>, lengths array<long>"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end: int = 0) -> None:
    """Encode every text, append ``end``, and write codes and blocks under ``path``."""
    spark = docs.sparkSession
    kind = encoder(tokenizer).kind
    tokens_path = fresh_path(spark, "tokens")
    tokenized(docs, tokenizer, end).withColumn("tie", F.xxhash64("ids")).write.option("compression", "zstd").parquet(tokens_path)
    tokens = spark.read.schema(f"{TOKENS}, tie long").parquet(tokens_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n = np.frombuffer(x, "<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    # as many rows as the vocabulary has ids at most
    got = tokens.select("counts").where("counts is not null").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column("id").to_numpy(), got.column("n").to_numpy()
    counts = np.zeros(int(at.max(initial=end)) + 1, np.int64)
    counts[at] = n
    counts[end] = max(counts[end], 1)
    bits = code_lengths(counts)
    spark.createDataFrame([(int(i), int(counts[i]), int(bits[i])) for i in np.flatnonzero(bits)], "id long, count long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((bits, canonical(bits)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            names, each = zip(*rows, strict=True)
            lengths = np.array([len(x) for x in each], np.int64)
            streams, marks = pack(np.concatenate(each), lengths, shared.value[1], shared.value[0])
            begin, places = 0, []
            for stream, m in zip(streams, marks, strict=True):
                places.append(np.frombuffer(m, "<u4").astype("<u8") + 8 * begin)
                begin += len(stream)
            row = [shard, block, first, held, b"".join(streams), np.concatenate(places).tobytes(), list(names), lengths.tolist()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([r], k) for r, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(x, kind)
                if held and held + len(ids) > BLOCK:
                    yield made()
                    block, first, rows, held = block + 1, first + held, [], 0
                rows.append((doc, ids))
                held += len(ids)
        if held:
            yield made()

    # ranges are sampled from two columns of the written table; what the ids are orders rows of one doc_id, and spreads them
    order = ["doc_id", "tie"]
    tokens.where("counts is null").select("doc_id", "ids", "tie").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    removed(spark, tokens_path)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document, decoded from the files."""
    codes = spark.read.parquet(f"{path}/codes").toArrow()
    at = codes.column("id").to_numpy()
    bits = np.zeros(int(at.max(initial=0)) + 1, np.int64)
    bits[at] = codes.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bits)
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row for each shard
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(W.Window.orderBy("shard")) - F.col("n")).alias("base"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                base, first, stream, marks, names, lengths = (c[r].as_py() for c in batch.columns)
                ids = table.unpack(stream, np.frombuffer(marks, "<u8"), np.array(lengths, np.int64)).astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                cols = [names, (starts + base + first).tolist(), lengths, [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]]
                if keep_ids:
                    cols.append([ids[s:e].tolist() for s, e in zip(starts, ends, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return blocks.join(F.broadcast(shards), "shard").select("base", "first", "stream", "checkpoints", "docs", "lengths").mapInArrow(run, ddl)
