"""Media columns: payloads stored as 8-bit images in archives, read by byte ranges."""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mapweft.session import ensure_checkpoint_dir

ROW_BYTES = 576  # samples in a row of an image
PAD = 255
ENTRY = np.dtype([("key", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u8"), ("crc", "<u4")])
FOOTER = struct.Struct("<QQ8s")  # where the directory starts, how many entries, a mark
MARK = b"MEDIARC1"
BATCH_BYTES = 4 << 20
PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded to a positive multiple of a row, and their number before it."""
    data = (text or "").encode("utf-8")
    return data + bytes([PAD]) * (max(ROW_BYTES, -(-len(data) // ROW_BYTES) * ROW_BYTES) - len(data)), len(data)


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A greyscale image, 8 bits a sample, a row of 576 samples after another."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    lines = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW_BYTES, len(rows), 8, 0, 0, 0, 0)
    return PNG + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _png_chunk(b"IEND", b"")


def from_png(stored: bytes) -> np.ndarray:
    """The samples of an image made by `to_png`; checks every chunk."""
    if stored[:8] != PNG:
        raise ValueError("not an image")
    at, body = 8, []
    while at < len(stored):
        (size,) = struct.unpack_from(">I", stored, at)
        kind, data = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", stored, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            body.append(data)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, ROW_BYTES + 1)[:, 1:]


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store each text as a member of an archive in `folder` (a URI that all executors share).

    An archive is members in a row, then a directory of (id, offset, length, checksum),
    then a footer that says where the directory is. A task writes one archive under a
    name of its own try; the list of archives, written last, names those of the tries
    that succeeded, so a lost executor leaves at most a file that nobody reads.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        name, entries, at = f"{uuid.uuid4().hex}.arc", [], 0
        with store.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                for key, text in zip(batch["key"], batch["text"], strict=True):
                    member = to_png(payload_of(text)[0])
                    entries.append((0 if key is None else int(key), key is None, at, len(member), zlib.crc32(member)))
                    out.write(member)
                    at += len(member)
            tail = directory_of(entries, at)
            out.write(tail)
        yield pd.DataFrame({"name": [name], "bytes": [at + len(tail)]})

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    narrow = docs.select(F.col(id_col).cast("long").cast("string").alias("key"), F.col(text_col).alias("text"))
    written = narrow.mapInPandas(run, "name string, bytes long").collect()  # one row per archive
    with store.open_output_stream(f"{base}/archives.json") as out:
        out.write(json.dumps([[r["name"], r["bytes"]] for r in written]).encode())


class Range(InputPartition):
    """Members of one archive that start in a range of its bytes."""

    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class MediaArchives(DataSource):
    """`media_archives`: rows of (doc_id, media) from a folder of archives.

    Options: path (a URI), range_bytes (bytes a partition plans for), tries (reads of one
    member before the task gives up).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", 8 << 20))
        self.tries = int(options.get("tries", 4))

    def partitions(self) -> list[Range]:
        """Byte ranges over the listed archives; their directories are read by the tasks."""
        store, base = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{base}/archives.json") as listed:
            archives = json.loads(listed.read())
        return [Range(n, a, min(a + self.range_bytes, size)) for n, size in archives for a in range(0, size, self.range_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(self.folder)
        path = f"{base}/{partition.name}"
        with store.open_input_file(path) as source:
            entries = read_directory(source)
        mine = entries[(entries["offset"] >= partition.start) & (entries["offset"] < partition.end)]
        at = 0
        while at < len(mine):
            ends = mine["offset"][at:] + mine["length"][at:] - mine["offset"][at]
            upto = at + max(1, int(np.searchsorted(ends, BATCH_BYTES, "right")))
            part = mine[at:upto]
            media = self._members(store, path, part)
            ids = pa.array(part["key"], pa.int64(), mask=part["null"].astype(bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary())], names=["doc_id", "media"])
            at = upto

    def _members(self, store: fs.FileSystem, path: str, part: np.ndarray) -> list[bytes]:
        """A stretch of members in one read; those that come damaged are read again alone."""
        first, size = int(part["offset"][0]), int(part["offset"][-1] + part["length"][-1] - part["offset"][0])
        try:
            stretch = read_at(store, path, first, size)
        except OSError:
            stretch = b""
        out = []
        for entry in part:
            offset, length = int(entry["offset"]), int(entry["length"])
            member = stretch[offset - first : offset - first + length]
            for n in range(self.tries):
                if len(member) == length and zlib.crc32(member) == int(entry["crc"]):
                    break
                time.sleep(0.05 * n)
                try:
                    member = read_at(store, path, offset, length)
                except OSError:
                    member = b""
            else:
                raise OSError(f"{path}: the member at byte {offset} could not be read in {self.tries} tries")
            out.append(member)
        return out


def read_at(store: fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as source:
        return source.read_at(length, offset)


def directory_of(entries: list[tuple], start: int) -> bytes:
    """Directory and footer of an archive whose members end at `start`."""
    return np.array(entries, ENTRY).tobytes() + FOOTER.pack(start, len(entries), MARK)


def read_directory(source) -> np.ndarray:
    """The member entries of an open archive."""
    size = source.size()
    start, count, mark = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
    if mark != MARK:
        raise ValueError("not an archive")
    return np.frombuffer(source.read_at(count * ENTRY.itemsize, start), ENTRY)


def scan_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(doc_id, media) of all members in the folder's archives."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(path=folder, **options).load()


def media_features(media: DataFrame) -> DataFrame:
    """Features of stored images, computed from the samples read back.

    Returns doc_id, n_bytes (without padding; text in UTF-8 never has the byte 255),
    payload_bytes, payload_sha256, tail_crc32 (of the last 32 payload bytes), media_bytes,
    media_sha256 and feature: rows, mean, deviation and entropy of the samples.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, stored in zip(batch["doc_id"], batch["media"], strict=True):
                samples = from_png(stored)
                payload = samples.tobytes()
                counts = np.bincount(samples.ravel(), minlength=256)
                share = counts[counts > 0] / len(payload)
                mean = float(counts @ np.arange(256)) / len(payload)
                spread = float(counts @ (np.arange(256) - mean) ** 2) / len(payload)
                feature = f"rows={len(samples)};mean={mean:.4f};sd={spread ** 0.5:.4f};bits={-(share * np.log2(share)).sum() + 0.0:.4f}"
                rows.append((doc_id, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=names)

    out = media.select(F.col("doc_id").cast("string"), "media").mapInPandas(
        run, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the cluster's checkpoint folder, as a URI."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base if "://" in base else "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store_and_scan(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the texts as archives and read them back as a media column (doc_id, media).

    Null text: an empty payload, one row of padding. Null ids stay null. Repeated rows are
    members of their own. Empty input: no rows. Other columns are not carried.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "media")
    write_archives(docs, folder, id_col, text_col)
    return scan_media(spark, folder, **options)
