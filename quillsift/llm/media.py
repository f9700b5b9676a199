"""Media columns: content-addressed payloads in tar shards, metadata by header-only range reads.

A payload is stored as an 8-bit grey PNG, 64 samples a row, which is lossless.  Each write task appends its
images to tar shards of its own in the shared folder, an image once a shard; members are named by the digest
of the payload.  Rows carry digest, shard, offset and length; one place for each digest, the first by shard and
offset, is the one that all rows refer to.  ``headers`` reads the first bytes of each image only and fills the
metadata columns; ``payloads`` reads whole images back.  Both go through a shard in the order of its offsets.

A shard's name holds the attempt that wrote it, so a task that runs again after its executor was lost writes new shards
and its rows refer to those; what the lost attempt left is garbage that no row names.  The index is written to
the shared folder before anything reads it.

Edge cases: null text is empty; an empty payload is 64 zero bytes; repeated rows and equal texts share
one image; an empty table gives no rows; extra columns are not carried.
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
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_root

ROW = 64
#: Bytes of a shard, about.
SHARD = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, length and type, and the IHDR chunk with its checksum.
HEADER = 33


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW or (ROW if not data else 0))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Rows of 64 grey samples, unfiltered."""
    rows = len(payload) // ROW
    samples = np.zeros((rows, ROW + 1), dtype=np.uint8)
    samples[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, ROW)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(samples.tobytes(), 9)) + chunk(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from an image's first bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def from_png(data: bytes) -> bytes:
    width, height, _ = read_header(data)
    at, parts = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    samples = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(height, width + 1)
    if samples[:, 0].any():
        raise ValueError("filtered rows")
    return samples[:, 1:].tobytes()


def feature(payload: bytes, width: int, height: int) -> str:
    """Size, mean and deviation of the samples, and a histogram of 16 bins in thousandths."""
    x = np.frombuffer(payload, dtype=np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{width}x{height};{x.mean():.4f};{x.std():.4f};" + ",".join(map(str, bins))


class Shards:
    """Tar files of a task, one after another."""

    def __init__(self, folder: str):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        self.task = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        self.number, self.out, self.places = 0, None, {}

    def add(self, digest: str, image: bytes) -> tuple[str, int]:
        """Shard and offset of the image; each digest is written once a shard."""
        if digest not in self.places:
            if self.out is None:
                self.name, self.at = f"{self.task}-{self.number}.tar", 0
                self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.places[digest] = self.name, self.at + len(head)
            data = head + image + bytes(-len(image) % tarfile.BLOCKSIZE)
            self.out.write(data)
            self.at += len(data)
        place = self.places[digest]
        if self.at > SHARD:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out, self.places, self.number = None, {}, self.number + 1


INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, lengths = Shards(folder), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = (text or "").encode("utf-8", "replace")
                    payload = padded(data)
                    digest = hashlib.sha256(payload + struct.pack("<Q", len(data))).hexdigest()
                    if digest not in shards.places:
                        image = to_png(payload)
                        lengths = lengths if shards.places else {}
                        lengths[digest] = len(image)
                        rows.append((doc_id, len(data), digest, *shards.add(digest, image), len(image)))
                    else:
                        rows.append((doc_id, len(data), digest, *shards.places[digest], lengths[digest]))
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n_bytes", "digest", "shard", "offset", "length"), r)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        shards.close()

    return write


def write_shards(docs: DataFrame) -> tuple[DataFrame, str]:
    """The index (a row per row of ``docs``: doc_id, n_bytes, digest, shard, offset, length) and the shards' folder."""
    spark = docs.sparkSession
    root = shared_root(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(f"{path}/shards", recursive=True)
    docs.mapInArrow(writer(f"{root}/shards"), INDEX).write.parquet(f"{root}/index")
    index = spark.read.parquet(f"{root}/index")
    one = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")
    # the digest's places are read several times: written once, the joins go over narrow rows
    index.select("doc_id", "n_bytes", "digest").join(one, "digest").write.parquet(f"{root}/places")
    return spark.read.parquet(f"{root}/places"), f"{root}/shards"


def places(index: DataFrame) -> DataFrame:
    """Each image once, a shard's images together and in order; a shard's stretches may go to several tasks."""
    images = index.groupBy("digest").agg(F.first("shard").alias("shard"), F.first("offset").alias("offset"), F.first("length").alias("length")).select("digest", "shard", "offset", "length")
    return images.withColumn("stretch", F.floor(F.col("offset") / (8 << 20))).repartition("shard", "stretch").sortWithinPartitions("shard", "offset").drop("stretch")


def reader(folder: str, size: int | None, columns: dict, make):
    """mapInArrow function: digest, shard, offset, length and more columns -> all of them and ``make(bytes, *more)``;
    ``size``: of the range, None for the whole image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for _, shard, offset, length, *more in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != name:
                    name, file = shard, fs.open_input_file(f"{path}/{shard}")
                rows.append(make(file.read_at(min(size or length, length), offset), *more))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *columns])

    return run


PLACE = "digest string, shard string, offset long, length long"
HEADERS = f"{PLACE}, width int, height int, bits int"


def headers(index: DataFrame, folder: str) -> DataFrame:
    """digest and place, width, height, bits of each image, from its first HEADER bytes."""
    columns = {"width": pa.int32(), "height": pa.int32(), "bits": pa.int32()}
    return places(index).mapInArrow(reader(folder, HEADER, columns, read_header), HEADERS)


def measure(data: bytes, width: int, height: int, bits: int) -> tuple:
    payload = from_png(data)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, width, height)


def payloads(index: DataFrame, folder: str) -> DataFrame:
    """What each image holds, read back from its shard by the tasks that have read its header."""
    columns = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    schema = f"{HEADERS}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return headers(index, folder).mapInArrow(reader(folder, None, columns, measure), schema).drop("shard", "offset", "length")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index, folder = write_shards(docs)
    out = index.select("doc_id", "n_bytes", "digest", "shard", "offset", "length").join(payloads(index, folder), "digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits", "shard", "offset", "length")
