"""Media columns: payloads stored as images in archives, read back by a Spark data source.

A payload is stored losslessly as 8-bit grey samples: a PNG image of 64 samples a row. Images are
the members of archives, files that tasks write into one folder. The data source ``tessera_archive``
plans byte ranges over the archives of a folder, streams the members whose offset lies in a range
as Arrow batches of bounded size, and retries each member by itself, by its offset.

Archive: MAGIC | members | index | index length (u64) | MAGIC. The index is zlib-packed JSON:
[offset, length, crc32, id, unpadded bytes] for each member.
"""

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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch_path, table
from .files import list_files, open_file, store, write_file

MAGIC = b"TSARCH01"
MANIFEST = "members.manifest"
WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
#: An archive ends with its task, or at this size; ranges are longer where there would be too many.
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
MOST_RANGES = 1 << 16
BATCH_BYTES = 4 << 20
RETRIES = 4
SCHEMA = "id long, n_bytes long, media binary, archive string, offset long"


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the row width."""
    return data + bytes((-len(data)) % WIDTH if data else WIDTH)


def _piece(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes) -> bytes:
    """A grey PNG whose rows are the payload's runs of 64 bytes, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # the first byte of a row is its filter: none
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _piece(b"IHDR", head) + _piece(b"IDAT", zlib.compress(raw.tobytes(), 3)) + _piece(b"IEND", b"")


def from_image(media: bytes) -> bytes:
    """The payload of such an image; raises if a checksum or the form is not as written."""
    if media[:8] != PNG:
        raise ValueError("not an image of ours")
    at, pieces = 8, {}
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("an image piece does not match its checksum")
        pieces[kind] = pieces.get(kind, b"") + body
        at += 12 + n
    width, height, depth, colour = struct.unpack(">IIBB", pieces[b"IHDR"][:10])
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("not an image of ours")
    raw = np.frombuffer(zlib.decompress(pieces[b"IDAT"]), np.uint8).reshape(height, WIDTH + 1)
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, entropy and the shares of 8 equal ranges of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    shares = counts.reshape(8, 32).sum(1) / len(payload)
    mean = float(np.dot(counts, np.arange(256))) / len(payload)
    return f"rows={len(payload) // WIDTH};mean={mean:.4f};bits={float(-(p * np.log2(p)).sum()) + 0.0:.4f};shares=" + ",".join(f"{x:.4f}" for x in shares)


def _write_archives(folder: str):
    def run(batches):
        rows = (r for pdf in batches for r in pdf[["id", "data"]].itertuples(index=False, name=None))
        row = next(rows, None)
        while row is not None:
            index: list = []

            def parts() -> Iterator[bytes]:
                nonlocal row
                yield MAGIC
                offset = len(MAGIC)
                while row is not None and offset < ARCHIVE_BYTES:
                    key, data = row
                    data = bytes(data or b"")
                    media = to_image(pad(data))
                    index.append([offset, len(media), zlib.crc32(media), None if pd.isna(key) else int(key), len(data)])
                    yield media
                    offset += len(media)
                    row = next(rows, None)
                packed = zlib.compress(json.dumps(index).encode(), 1)
                yield packed
                yield len(packed).to_bytes(8, "little") + MAGIC

            name = f"{uuid.uuid4().hex}.arc"  # another attempt of this task writes another file
            size = write_file(f"{folder}/{name}", parts())
            yield pd.DataFrame({"name": [name], "size": [size], "members": [len(index)]})

    return run


def write_archives(payloads: DataFrame, folder: str) -> None:
    """Store ``payloads(id, data)`` in archives of the folder, by the tasks that hold the rows.

    The manifest names the archives of tasks that ended well; what lost or doubled attempts wrote
    is not read. One row for each archive reaches the driver: about one for each task.
    """
    rows = payloads.select("id", "data").mapInPandas(_write_archives(folder), "name string, size long, members long").collect()
    write_file(f"{folder}/{MANIFEST}", [json.dumps([[r["name"], r["size"]] for r in rows]).encode()])


class ByteRange(InputPartition):
    def __init__(self, path: str, lo: int, hi: int) -> None:
        self.path, self.lo, self.hi = path, lo, hi


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        self.step = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of all archives; no member is looked at here."""
        found = list_files(self.folder, ".arc")
        if any(name == MANIFEST for name, _ in list_files(self.folder, MANIFEST)):
            with open_file(f"{self.folder}/{MANIFEST}") as f:
                found = [(n, s) for n, s in json.loads(f.read())]
        step = max(self.step, sum(s for _, s in found) // MOST_RANGES)
        return [ByteRange(f"{self.folder}/{n}", lo, min(lo + step, s)) for n, s in found for lo in range(0, s, step)] or [ByteRange("", 0, 0)]

    def member(self, path: str, offset: int, length: int, crc: int, reading=None) -> bytes:
        """One member by its offset; a failed or damaged read is tried again on a new handle."""
        last: Exception | None = None
        for attempt in range(self.retries):
            try:
                if reading is None or attempt:
                    reading = (self.opener or open_file)(path)
                reading.seek(offset)
                data = reading.read(length)
                if len(data) == length and zlib.crc32(data) == crc:
                    return data
                last = ValueError(f"{path}: member at {offset} does not match its checksum")
            except OSError as e:
                last = e
            time.sleep(0.05 * attempt)
        raise last

    opener = None

    def index(self, path: str) -> list:
        with open_file(path) as f:
            size = f.size()
            f.seek(size - 16)
            tail = f.read(16)
            if tail[8:] != MAGIC:
                raise ValueError(f"{path} is not a whole archive")
            n = int.from_bytes(tail[:8], "little")
            f.seek(size - 16 - n)
            return json.loads(zlib.decompress(f.read(n)))

    def read(self, partition: ByteRange):
        import pyarrow as pa

        if not partition.path:
            return
        kinds = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("archive", pa.string()), ("offset", pa.int64())])
        rows, size = [], 0
        with open_file(partition.path) as f:
            for offset, length, crc, key, n in self.index(partition.path):
                if not partition.lo <= offset < partition.hi:
                    continue
                rows.append((key, n, self.member(partition.path, offset, length, crc, f), partition.path.rsplit("/", 1)[-1], offset))
                size += length
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)


class ArchiveSource(DataSource):
    """``spark.read.format("tessera_archive").load(folder)``: the members of all archives there."""

    @classmethod
    def name(cls) -> str:
        return "tessera_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tessera_archive").options(**options).load(folder)


def _features(batches):
    for pdf in batches:
        out = []
        for key, n, media in pdf[["id", "n_bytes", "media"]].itertuples(index=False, name=None):
            payload = from_image(media)
            out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        yield pd.DataFrame(out, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"id": "Int64"})


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored members, decoded from their media."""
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("id", "n_bytes", "media").mapInPandas(_features, schema)


def stored_texts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store the texts of ``docs`` and give the features of what is read back, a row for each.

    * null text: as an empty one (64 zero bytes); a null doc_id stays null; equal rows are stored
      each; empty table: no rows. Other columns are ignored. A very long text is one member, whole
      in memory while it is written or read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "media")
    where, path = store(folder)
    where.create_dir(path, recursive=True)
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    write_archives(docs.select(F.col("doc_id").cast("long").alias("id"), data.alias("data")), folder)
    return media_features(read_archives(spark, folder)).withColumnRenamed("id", "doc_id")


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    return stored_texts(table(spark, sf_dir, "documents"))
