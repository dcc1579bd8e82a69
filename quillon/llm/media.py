"""Media columns: texts as 8-bit images in archives, and a Spark data source over archive folders.

A payload is stored as a greyscale PNG of 8-bit samples, 64 a row. Each task writes its members to one tar archive with an index of
member offsets beside it. The data source ``media_archive`` lists a folder, plans a partition per byte range of an
archive, and reads the members that start in it one by one by offset: a member that fails is read again by itself, up to ``TRIES``
times, and no other is. Payloads go to Spark in Arrow batches of a bounded size.

Null texts are empty; empty texts are 64 zero samples. Null ids and repeated rows are members like any other.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import lean, scratch, text_bytes
from .files import locate, put

ROW = 64
#: Bytes of an archive that one partition reads, bytes of payload in a batch, and attempts a member.
RANGE_BYTES, BATCH_BYTES, TRIES = 8 << 20, 2 << 20, 3
#: Bytes of payload after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
_SIGN = b"\x89PNG\r\n\x1a\n"


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW or (ROW if not text else 0))


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 5)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """Samples of a greyscale PNG without row filters; checksums are held against the chunks."""
    if data[:8] != _SIGN:
        raise ValueError("no PNG")
    at, pixels, wide = 8, [], ROW
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            wide = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            pixels.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(pixels)), np.uint8).reshape(-1, wide + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, standard deviation, entropy and the share of zero samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n / n.sum()
    mean = float((p * np.arange(256)).sum())
    var = float((p * (np.arange(256) - mean) ** 2).sum())
    q = p[p > 0]
    return f"mean={mean:.4f};std={var**0.5:.4f};entropy={-float((q * np.log2(q)).sum()) + 0.0:.4f};zero={p[0]:.4f}"


class _Archive:
    def __init__(self, uri: str):
        self.uri, self.out, self.size, self.offsets = uri, io.BytesIO(), 0, []

    def add(self, name: str, data: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.offsets.append(self.out.tell())
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % 512))

    def close(self) -> tuple[str, int]:
        self.out.write(bytes(1024))
        put(self.uri + ".idx", np.array(self.offsets, "<u8").tobytes())
        put(self.uri, self.out.getvalue())
        return self.uri, len(self.offsets)


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes archives of all texts to the folder; the number of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, part, archive = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if archive is None:
                    archive = _Archive(f"{folder}/part-{k:06d}-{part:04d}.tar")
                archive.add(f"{'null' if doc is None else doc}/{len(text)}.png", to_png(pad(text)))
                if archive.out.tell() > ARCHIVE_BYTES:
                    yield _count(*archive.close())
                    part, archive = part + 1, None
        if archive is not None:
            yield _count(*archive.close())

    known = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return known.mapInArrow(run, "uri string, n long").agg(F.sum("n")).first()[0] or 0


def _count(uri: str, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n])], names=["uri", "n"])


class ByteRange(InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        self.uri, self.start, self.end = uri, start, end


class MediaArchive(DataSource):
    """format("media_archive").load(folder): archive, offset, name and payload of each member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        store, path = locate(self.folder)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        tars = sorted((f.base_name, f.size) for f in found if f.base_name.endswith(".tar") and not f.base_name.startswith("."))
        return [ByteRange(f"{self.folder}/{n}", a, min(a + self.size, size)) for n, size in tars for a in range(0, size, self.size)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        store, path = locate(partition.uri)
        with store.open_input_file(path + ".idx") as f:
            offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
        offsets = offsets[(offsets >= partition.start) & (offsets < partition.end)]
        out, size = [], 0
        for at in offsets.tolist():
            name, payload = member(store, path, at)
            out.append((partition.uri, at, name, payload))
            size += len(payload)
            if size > BATCH_BYTES:
                yield _members(out)
                out, size = [], 0
        if out:
            yield _members(out)


def member(store, path: str, at: int, tries: int = TRIES) -> tuple[str, bytes]:
    """A member's name and payload by its offset; what fails is tried again from the start."""
    for left in range(tries - 1, -1, -1):
        try:
            with store.open_input_file(path) as f:
                info = tarfile.TarInfo.frombuf(f.read_at(512, at), "utf-8", "strict")
                payload = f.read_at(info.size, at + 512)
            if len(payload) != info.size:
                raise OSError("a member is cut off")
            return info.name, payload
        except (OSError, tarfile.HeaderError):
            if not left:
                raise
    raise ValueError("no attempts")


def _members(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["archive", "offset", "name", "payload"])


def features(members: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, _, n = name.removesuffix(".png").partition("/")
                p = from_png(media)
                out.append((None if doc == "null" else int(doc), int(n), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=COLUMNS)

    return members.select("name", "payload").mapInArrow(run, ", ".join(f"{c} {'string' if c in ('payload_sha256', 'media_sha256', 'feature') else 'long'}" for c in COLUMNS))


COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op9_media(spark, sf_dir: str) -> DataFrame:
    """The features of every text's stored form, read back from its archive."""
    folder = scratch(spark, "media")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    spark.dataSource.register(MediaArchive)
    return features(spark.read.format("media_archive").load(folder))
