"""Media columns: payloads stored as grey images in archives, and a data source that reads them by byte range.

An archive is a ZIP file whose members are PNG images (8-bit grey, 576 samples a row).  Member names have a fixed
length, so every entry of an archive's directory has the same size: partitions are byte ranges of directories,
planned from a line for each archive, and the driver never sees a list of members.  A reader takes its
slice of the directory, reads each member at its own offset, checks it, and retries it alone if that fails.

Defined results: a null text is the empty text; an empty payload is one row of bytes 255; repeated rows get members of their
own with equal values; a null id stays null; an empty table gives an empty result; other columns are ignored; a member
beyond 4 GB can't occur, as a text is below 2 GB.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import fresh_path

ROW, FILL = 576, 255
#: Members and bytes after which a writer begins another archive; directory entries of a partition; tries of a member.
MEMBERS, ARCHIVE_BYTES, SLICE, TRIES = 50_000, 1 << 27, 2_000, 4
_LOCAL, _ENTRY, _END = struct.Struct("<4sHHHHHIIIHH"), struct.Struct("<4sHHHHHHIIIHHHHHII"), struct.Struct("<4sHHHHIIH")
NAME = 21
STORED = "doc_id bigint, media binary"
COLUMNS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def padded(text: bytes) -> bytes:
    """The payload: a positive multiple of ``ROW`` bytes."""
    return text + bytes([FILL]) * ((-len(text)) % ROW if text else ROW)


def png(payload: bytes) -> bytes:
    """A grey image of ``ROW`` samples a line."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The lines of an image made by :func:`png`; its checksums are verified."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not an image")
    at, header, data = 8, b"", []
    while at < len(image):
        (length,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + length)[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            header = body
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    width, height, depth, colour = struct.unpack_from(">IIBB", header)
    if (depth, colour) != (8, 0):
        raise ValueError("an image of another kind")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("an image with filters")
    return lines[:, 1:]


def feature(lines: np.ndarray) -> str:
    """Height, mean, deviation, mean change between neighbours, and an 8-bin histogram, as text."""
    counts = np.bincount(lines.ravel(), minlength=256)
    values, n = np.arange(256), lines.size
    mean = int((counts * values).sum()) / n
    spread = (int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    change = 0
    for a in range(0, len(lines), 4096):
        part = lines[a : a + 4096].astype(np.int16)
        change += int(np.abs(part[:, 1:] - part[:, :-1]).sum())
    bins = counts.reshape(8, 32).sum(axis=1)
    return f"h={len(lines)};mean={mean:.4f};std={spread:.4f};step={change / (len(lines) * (ROW - 1)):.4f};hist=" + ",".join(map(str, bins.tolist()))


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; any that pyarrow reaches will do (file, hdfs, s3, gs)."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)


class ArchiveWriter:
    """Writes members one after the other; the directory is kept for the end."""

    def __init__(self, folder: str):
        self.name = uuid.uuid4().hex + ".zip"
        store, at = located(folder)
        store.create_dir(at, recursive=True)
        self.path = f"{folder}/{self.name}"
        self.file = store.open_output_stream(f"{at}/{self.name}")
        self.entries: list[bytes] = []
        self.at = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        name = (f"{doc_id:+021d}" if doc_id is not None else "null".ljust(NAME, "_")).encode()
        crc, n = zlib.crc32(data), len(data)
        self.entries.append(_ENTRY.pack(b"PK\1\2", 20, 20, 0, 0, 0, 33, crc, n, n, NAME, 0, 0, 0, 0, 0, self.at) + name)
        self.file.write(_LOCAL.pack(b"PK\3\4", 20, 0, 0, 0, 33, crc, n, n, NAME, 0) + name)
        self.file.write(data)
        self.at += _LOCAL.size + NAME + n

    @property
    def full(self) -> bool:
        return len(self.entries) >= MEMBERS or self.at >= ARCHIVE_BYTES

    def close(self) -> str:
        listed = b"".join(self.entries)
        n = len(self.entries)
        self.file.write(listed + _END.pack(b"PK\5\6", 0, 0, n, n, len(listed), self.at, 0))
        self.file.close()
        return self.path

    def line(self) -> str:
        """What the list of archives says of this one: name, offset and entries of its directory."""
        return f"{self.name} {self.at} {len(self.entries)}"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    writer, lines = None, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            writer = writer or ArchiveWriter(folder)
            writer.add(doc_id, png(padded(text.as_py() or b"")))
            if writer.full:
                writer.close()
                lines.append(writer.line())
                writer = None
    if writer:
        writer.close()
        lines.append(writer.line())
    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])


def write_archives(docs: DataFrame, folder: str) -> list[str]:
    """Stores all payloads in archives under a folder that executors share; returns the lines of the attempts that counted, one for 128 MB."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return sorted(r[0] for r in slim.mapInArrow(lambda it: _write(it, folder), "line string").collect())


class DirectorySlice(InputPartition):
    """Some entries, in a row, of the directory of an archive."""

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def retried(read: Callable[[], bytes], tries: int = TRIES, pause: float = 0.05) -> bytes:
    for attempt in range(tries):
        try:
            return read()
        except (OSError, ValueError):
            if attempt == tries - 1:
                raise
            time.sleep(pause * 2**attempt)
    raise AssertionError


def read_range(path: str, begin: int, end: int) -> bytes:
    store, at = located(path)
    with store.open_input_file(at) as file:
        data = file.read_at(end - begin, begin)
    if len(data) != end - begin:
        raise ValueError(f"{path} ends before byte {end}")
    return data


def directory(path: str) -> tuple[int, int]:
    """(offset, entries) of an archive's directory, read from its end."""
    store, at = located(path)
    size = store.get_file_info(at).size
    mark, _, _, _, n, listed, at, _ = _END.unpack(read_range(path, size - _END.size, size))
    if mark != b"PK\5\6" or listed != n * (_ENTRY.size + NAME):
        raise ValueError(f"{path} has no directory of entries of one size")
    return at, n


def members(path: str, begin: int, end: int) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, bytes) of the members whose entries lie between two offsets of the file."""
    listed = retried(lambda: read_range(path, begin, end))
    width = _ENTRY.size + NAME
    for k in range(0, len(listed), width):
        fields = _ENTRY.unpack_from(listed, k)
        name = listed[k + _ENTRY.size : k + width]
        crc, n, at = fields[7], fields[8], fields[16]

        def read(crc=crc, n=n, at=at) -> bytes:
            data = read_range(path, at + _LOCAL.size + NAME, at + _LOCAL.size + NAME + n)
            if zlib.crc32(data) != crc:
                raise ValueError(f"{path}: damaged member at {at}")
            return data

        yield (None if name.startswith(b"null") else int(name)), retried(read)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, lines: list[str]):
        self.folder, self.lines = folder, lines

    def partitions(self) -> list[DirectorySlice]:
        out, width = [], _ENTRY.size + NAME
        for name, at, n in map(str.split, self.lines):
            at, n = int(at), int(n)
            out += [DirectorySlice(f"{self.folder}/{name}", at + k * width, at + min(n, k + SLICE) * width) for k in range(0, n, SLICE)]
        return out or [DirectorySlice("", 0, 0)]

    def read(self, partition: DirectorySlice) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "media"])

        held, size = [], 0
        for row in members(partition.path, partition.begin, partition.end) if partition.path else ():
            held.append(row)
            size += len(row[1])
            if size > 1 << 22 or len(held) >= 512:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``: the members of all archives that the folder's list names, by path or URI."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return STORED

    def reader(self, schema) -> _Reader:
        folder = self.options["path"]
        store, at = located(folder)
        with store.open_input_stream(f"{at}/LIST") as lines:
            return _Reader(folder, [x for x in lines.read().decode().split("\n") if x])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(folder)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1)):
            image = media.as_py()
            lines = samples(image)
            payload = lines.tobytes()
            rows.append((doc_id, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(lines)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def store(docs: DataFrame) -> str:
    """Writes the archives of all documents and their list; returns the folder.  Archives of attempts that failed are deleted."""
    folder = fresh_path(docs.sparkSession, "media")
    lines = write_archives(docs, folder)
    held, at = located(folder)
    held.create_dir(at, recursive=True)
    named = {x.split()[0] for x in lines}
    for info in held.get_file_info(fs.FileSelector(at)):
        if info.base_name not in named:
            held.delete_file(info.path)
    with held.open_output_stream(f"{at}/LIST") as out:
        out.write("\n".join(lines).encode())
    return folder


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores all documents and describes what is read back."""
    return read_archives(docs.sparkSession, store(docs)).mapInArrow(_digest, COLUMNS)
