"""Media columns: payloads stored as lossless 8-bit images in archives, read by a custom data source.

Writing: every text becomes a byte payload (UTF-8, padded with spaces to a positive multiple of 192),
stored losslessly as an 8-bit greyscale PNG 192 samples wide. Each task writes its images to ZIP
archives (stored, not compressed again) in a directory all executors share, under a name of its own for
each attempt. A manifest of byte ranges is a table beside them, so that what a lost task leaves behind is
named by nothing and read by nobody; no list of archives passes through the driver's program.

Reading: ``MediaArchiveSource`` plans partitions as byte ranges over an archive directory, by its manifest
or, where it has none, by the sizes of its archives. A range owns the members whose local header starts in
it, so each member is read exactly once; by a manifest it reads its own part of the archive's directory
only. Opening an archive and each member, by its offset, have retries of their own. Payloads and media leave
as binary columns in Arrow batches bounded in bytes.

Nulls and odd input: a null text counts as empty (one line of 192 spaces); a null doc_id stays null;
repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored. A member
that can't be read after all retries fails the task, as does an archive with compressed members.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.session import fresh_path

WIDTH = 192
#: An archive is closed beyond so many bytes, and a partition covers about as many.
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
RETRIES = 3
MANIFEST_NAME = "manifest"
#: Fixed size of an entry of an archive's directory, its name aside.
DIRECTORY_ENTRY = 46
T = TypeVar("T")
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"

SCHEMA = "doc_id long, n_bytes long, payload binary, media binary"
MANIFEST = "path string, low long, high long, dir_low long, dir_high long, members long"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_media(data: bytes) -> bytes:
    """An 8-bit greyscale PNG of the padded payload; the unpadded length is kept in a text chunk."""
    rows = max(1, -(-len(data) // WIDTH))
    payload = np.frombuffer(data.ljust(rows * WIDTH, b" "), np.uint8).reshape(rows, WIDTH)
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # filter type 0 leads every line
    lines[:, 1:] = payload
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return (
        PNG_SIGNATURE
        + _chunk(b"IHDR", head)
        + _chunk(b"tEXt", b"length\0%d" % len(data))
        + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1))
        + _chunk(b"IEND", b"")
    )


def from_media(media: bytes) -> tuple[bytes, int]:
    """The payload and its unpadded length; raises ValueError where a checksum does not hold."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("not an image of ours")
    at, body, length, rows = 8, [], -1, 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            rows = struct.unpack(">II", data[:8])[1]
        elif kind == b"tEXt":
            length = int(data.split(b"\0")[1])
        elif kind == b"IDAT":
            body.append(data)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, WIDTH + 1)
    return lines[:, 1:].tobytes(), length


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits, and the share of 8 equal bands of sample values."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    values = np.arange(256)
    mean = float(p @ values)
    deviation = float(np.sqrt(p @ (values - mean) ** 2))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    bands = ",".join(f"{x:.4f}" for x in p.reshape(8, 32).sum(axis=1))
    return f"mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};bands={bands}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Archive:
    """One archive of a task, written straight to the shared directory."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        system, place = _open(self.path)
        if isinstance(system, pafs.LocalFileSystem):
            system.create_dir(place.rpartition("/")[0], recursive=True)
        self.sink = system.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.members = self.bytes = 0

    def add(self, doc_id: int | None, media: bytes) -> None:
        info = zipfile.ZipInfo(f"{self.members}/{'' if doc_id is None else doc_id}.png")
        self.zip.writestr(info, media)
        self.members += 1
        self.bytes += len(media)

    def close(self, step: int) -> list[dict]:
        """The archive's ranges of about ``step`` bytes, each with its part of the archive's directory."""
        infos, start = self.zip.filelist, self.zip.start_dir
        self.zip.close()
        self.sink.close()
        rows, at = [], start
        for info in infos:
            if not rows or info.header_offset - rows[-1]["low"] >= step:
                rows.append({"path": self.path, "low": info.header_offset, "high": 0, "dir_low": at, "dir_high": at, "members": 0})
            at += DIRECTORY_ENTRY + len(info.filename.encode())
            rows[-1]["dir_high"] = at
            rows[-1]["members"] += 1
            rows[-1]["high"] = info.header_offset + 1
        return rows


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, range_bytes: int = RANGE_BYTES) -> str:
    """Writes every text of ``docs`` to archives in ``folder``, and their manifest; returns the folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                archive = archive or _Archive(folder)
                archive.add(doc_id.as_py(), to_media((text.as_py() or "").encode()))
                if archive.bytes >= archive_bytes:
                    yield pa.RecordBatch.from_pylist(archive.close(range_bytes))
                    archive = None
        if archive:
            yield pa.RecordBatch.from_pylist(archive.close(range_bytes))

    docs.select("doc_id", "text").mapInArrow(work, MANIFEST).write.parquet(f"{folder}/{MANIFEST_NAME}")
    return folder


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int, dir_low: int = 0, dir_high: int = 0) -> None:
        self.path, self.low, self.high, self.dir_low, self.dir_high = path, low, high, dir_low, dir_high


Members = list[tuple[str, int, int]]  # name, place of the local header, size


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        self.step = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.wait = float(options.get("retrywait", 0.1))

    def partitions(self) -> list[_Range]:
        system, place = _open(self.folder)
        head = self.folder.removesuffix(place)
        found = []
        manifest = f"{place}/{MANIFEST_NAME}"
        if system.get_file_info(manifest).type == pafs.FileType.Directory:
            for file in system.get_file_info(pafs.FileSelector(manifest)):
                if file.base_name.endswith(".parquet"):
                    rows = pq.read_table(file.path, filesystem=system)
                    found += [_Range(*row[:-1]) for row in zip(*(c.to_pylist() for c in rows.columns), strict=True)]
        else:
            for file in system.get_file_info(pafs.FileSelector(place)):
                if file.base_name.endswith(".zip"):
                    edges = [*range(0, max(1, file.size), self.step), 1 << 62]
                    found += [_Range(head + file.path, a, b) for a, b in zip(edges, edges[1:], strict=False)]
        return found or [_Range("", 0, 0)]

    def _tried(self, attempt: Callable[[], T]) -> T:
        """What the attempt gives; it opens what it needs itself, so that every try is a fresh one."""
        for n in range(self.retries + 1):
            try:
                return attempt()
            except (OSError, ValueError, struct.error, zlib.error, zipfile.BadZipFile):
                if n == self.retries:
                    raise
                time.sleep(self.wait * 2**n)
        raise AssertionError

    def _members(self, part: _Range) -> Members:
        system, place = _open(part.path)
        with system.open_input_file(place) as f:
            if not part.dir_high:
                infos = zipfile.ZipFile(f).infolist()
                if any(x.compress_type != zipfile.ZIP_STORED for x in infos):
                    raise NotImplementedError(f"{part.path} has compressed members")
                return [(x.filename, x.header_offset, x.file_size) for x in infos if part.low <= x.header_offset < part.high]
            data = f.read_at(part.dir_high - part.dir_low, part.dir_low)
        found, at = [], 0
        while at < len(data):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("not an archive's directory")
            size, name = struct.unpack_from("<I", data, at + 24)[0], struct.unpack_from("<H", data, at + 28)[0]
            offset = struct.unpack_from("<I", data, at + 42)[0]
            found.append((data[at + DIRECTORY_ENTRY : at + DIRECTORY_ENTRY + name].decode(), offset, size))
            at += DIRECTORY_ENTRY + name
        return found

    def _read(self, f: pa.NativeFile, offset: int, size: int) -> tuple[bytes, bytes, int]:
        name, extra = struct.unpack_from("<HH", f.read_at(30, offset), 26)
        media = f.read_at(size, offset + 30 + name + extra)
        return media, *from_media(media)

    def _member(self, path: str, offset: int, size: int) -> tuple[bytes, bytes, int]:
        system, place = _open(path)
        with system.open_input_file(place) as f:
            return self._read(f, offset, size)

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        members = self._tried(lambda: self._members(part))

        def opened() -> pa.NativeFile:
            system, place = _open(part.path)
            return system.open_input_file(place)

        rows, held = [], 0
        with self._tried(opened) as f:
            for name, offset, size in members:
                try:
                    media, payload, length = self._read(f, offset, size)
                except (OSError, ValueError, struct.error, zlib.error):
                    # one bad read costs one member's retries
                    media, payload, length = self._tried(lambda o=offset, s=size: self._member(part.path, o, s))
                key = name.split("/")[-1].removesuffix(".png")
                rows.append((int(key) if key else None, length, payload, media))
                held += len(media) + len(payload)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.binary()) for n, t in (x.split() for x in SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class MediaArchiveSource(DataSource):
    """``spark.read.format("textloom_media").load(directory)``"""

    @classmethod
    def name(cls) -> str:
        return "textloom_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaArchiveReader:  # noqa: ANN001
        return MediaArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, payload and media of every member of the directory's archives."""
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("textloom_media").option("rangeBytes", range_bytes).load(folder)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores all texts and returns their payloads and media, read back from storage."""
    spark = docs.sparkSession
    return read_archives(spark, write_archives(docs, folder or fresh_path(spark, "media")))


def media_digests(media: DataFrame) -> DataFrame:
    """Sizes, checksums and features in place of payloads and media."""

    @F.pandas_udf("string")
    def features(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in payloads:
            yield batch.map(feature)

    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        features("payload").alias("feature"),
    )
