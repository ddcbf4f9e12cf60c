"""Media columns: images in archives, read by a Spark data source of byte ranges.

Texts are stored as PNG images (8-bit RGB, 64 pixels a row), the images as members of
tar archives.  The data source ``archive`` lists the archives of a directory, plans
partitions that are byte ranges of them, and streams members through Arrow in batches
of bounded size; each range owns the members that begin in it.  A member is read by its
offset; if that fails, it alone is read again from a newly opened file.

Writing goes through the data source too: a task's archives count only once the job has
committed a manifest that names them.  Archives of executors that were lost and of tasks
that were tried again stay in the directory, but no manifest names them and none is read.

Rows: null and empty texts are one row of spaces; a text of any length is one image;
equal texts give equal values; repeated rows, and rows of one doc_id (ties), are members
each; a null doc_id is kept; an empty table gives an empty directory; other columns,
whatever their names, are not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import by_text

#: Bytes of a row of samples (64 pixels of three), of a planned range, of an archive, and of a batch.
ROW, RANGE, ARCHIVE, BATCH = 192, 16 << 20, 128 << 20, 4 << 20
ATTEMPTS, PAUSE = 3, 0.2
SIGNATURE = b"\x89PNG\r\n\x1a\n"

# images


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def image_of(text: str) -> bytes:
    """A PNG image whose samples are the payload; the length without padding is a text chunk."""
    samples = np.frombuffer(payload(text), np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(samples), ROW + 1), np.uint8)
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", ROW // 3, len(samples), 8, 2, 0, 0, 0)
    size = len(text.encode("utf-8", "surrogatepass"))
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0%d" % size) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def samples_of(image: bytes) -> tuple[np.ndarray, int | None]:
    """Samples by row, and the length without padding if the image tells it."""
    if not image.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, wide, size, data = len(SIGNATURE), 0, None, []
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            wide, high, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if depth != 8 or colour not in (0, 2) or rest[2]:
                raise ValueError("only 8-bit grey or RGB images without interlacing")
            step = 3 if colour == 2 else 1
        elif kind == b"tEXt" and body.startswith(b"Bytes\0"):
            size = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(high, wide * step + 1)
    out = lines[:, 1:].copy()
    for i in np.flatnonzero(lines[:, 0]):
        if lines[i, 0] == 1:
            out[i] = np.add.accumulate(out[i].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif lines[i, 0] == 2:
            out[i] += out[i - 1] if i else 0
        else:
            raise ValueError("only line filters 0 to 2")
    return out, size


def feature(samples: np.ndarray) -> str:
    """Mean and spread of the samples, and a hash of whether each of 64 stretches is brighter than the one before."""
    flat = samples.ravel().astype(np.int64)
    n = len(flat)
    mean = int(flat.sum()) / n
    spread = (int((flat * flat).sum()) / n - mean * mean) ** 0.5
    cuts = np.arange(66) * n // 65
    total = np.concatenate([[0], np.cumsum(flat)])
    means = (total[cuts[1:]] - total[cuts[:-1]]) / np.maximum(np.diff(cuts), 1)
    bits = int.from_bytes(np.packbits(means[1:] > means[:-1]).tobytes(), "big")
    return f"mean={mean:.4f};spread={spread:.4f};hash={bits:016x}"


# archives


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        files, top = _opened(self.path)
        listed = {f.base_name: f for f in files.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.File}
        names = sorted(n for n in listed if n.endswith(".tar"))
        manifests = [n for n in listed if n.startswith("manifest-")]
        if manifests:  # only what a job has committed
            known = set()
            for m in manifests:
                with files.open_input_stream(f"{top}/{m}") as f:
                    known |= set(json.loads(f.read()))
            names = [n for n in names if n in known]
        return [Range(f"{self.path}/{n}", lo, min(lo + self.size, listed[n].size)) for n in names for lo in range(0, listed[n].size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows: list[tuple] = []
        held = 0
        files, name = _opened(partition.path)
        for offset, size, member in _members(files, name, partition.start, partition.end):
            image = read_member(files, name, offset, size)
            rows.append((None if member == "none" else int(member), partition.path.rsplit("/", 1)[1], offset, image))
            held += size
            if held >= BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MEMBER, strict=True)], schema=MEMBER)


MEMBER = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("image", pa.binary())])
MEMBER_DDL = "doc_id long, archive string, offset long, image binary"


def _members(files: fs.FileSystem, name: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """(offset of the content, size, name) of the members whose headers lie in [start, end).

    The sidecar has the offset of each header; without it headers are followed from the archive's start.
    """
    index = files.get_file_info(name + ".idx")
    with files.open_input_file(name) as f:
        total = f.size()
        if index.type == fs.FileType.File:
            with files.open_input_file(name + ".idx") as g:
                at = np.frombuffer(g.read(), "<u8")
            for offset in at[np.searchsorted(at, start) : np.searchsorted(at, end)].tolist():
                info = tarfile.TarInfo.frombuf(f.read_at(512, offset), "utf-8", "surrogateescape")
                yield offset + 512, info.size, info.name.removesuffix(".png")
            return
        offset = 0
        while offset < min(end, total):
            head = f.read_at(512, offset)
            if not head.strip(b"\0"):
                return
            info = tarfile.TarInfo.frombuf(head, "utf-8", "surrogateescape")
            if offset >= start:
                yield offset + 512, info.size, info.name.removesuffix(".png")
            offset += 512 + -(-info.size // 512) * 512


def read_member(files: fs.FileSystem, name: str, offset: int, size: int) -> bytes:
    """The content at an offset; a failed read is tried again by itself, each time from a newly opened file."""
    for attempt in range(ATTEMPTS):
        try:
            with files.open_input_file(name) as f:
                got = f.read_at(size, offset)
            if len(got) == size:
                return got
            raise OSError(f"{name}: {len(got)} of {size} bytes at {offset}")
        except OSError:
            if attempt + 1 == ATTEMPTS:
                raise
            time.sleep(PAUSE * 2**attempt)
    raise AssertionError


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = _opened(self.path)
        files.create_dir(top, recursive=True)
        names: list[str] = []
        out, offsets, at = None, [], 0

        def closed() -> None:
            out.write(bytes(1024))
            out.close()
            with files.open_output_stream(f"{top}/{names[-1]}.idx") as g:
                g.write(np.array(offsets, "<u8").tobytes())

        for batch in iterator:
            for doc, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.tar")
                    out, offsets, at = files.open_output_stream(f"{top}/{names[-1]}"), [], 0
                info = tarfile.TarInfo("none.png" if doc is None else f"{doc}.png")
                info.size = len(image)
                block = info.tobuf(tarfile.USTAR_FORMAT) + image + bytes(-len(image) % 512)
                out.write(block)
                offsets.append(at)
                at += len(block)
                if at >= ARCHIVE:
                    closed()
                    out = None
        if out is not None:
            closed()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, top = _opened(self.path)
        files.create_dir(top, recursive=True)
        with files.open_output_stream(f"{top}/manifest-{uuid.uuid4().hex}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, top = _opened(self.path)
        for n in [n for m in messages if m for n in m.names]:
            for end in ("", ".idx"):
                try:
                    files.delete_file(f"{top}/{n}{end}")
                except OSError:
                    pass


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(directory)`` and ``df.write.format("archive")``; option range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBER_DDL

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"].rstrip("/"), int(self.options.get("range_bytes", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"].rstrip("/"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def write_archives(docs: DataFrame, path: str) -> None:
    """Every text as an image in archives under ``path``."""
    register(docs.sparkSession)
    make = by_text(lambda texts: {"image": [image_of(t) for t in texts]}, pa.schema([("doc_id", pa.int64()), ("image", pa.binary())]))
    docs.select("doc_id", "text").mapInArrow(make, "doc_id long, image binary").write.format("archive").mode("append").option("path", path).save()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Digests and features of every member, from the stored bytes alone."""
    register(spark)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples, size = samples_of(image)
                raw = samples.tobytes()
                rows.append((doc, size, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

    kinds = {"int64": "long", "string": "string"}
    return spark.read.format("archive").load(path).select("doc_id", "image").mapInArrow(run, ", ".join(f"{n} {kinds[str(k)]}" for n, k in fields))
