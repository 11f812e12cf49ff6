"""Media columns: content-addressed payloads in tar shards, metadata by header-only range reads.

A text's UTF-8 bytes, filled up with bytes 255 to a multiple of 576, become an 8-bit grey PNG of width 576.
A task appends the images to tar shards, once for each digest within its shard, and its rows carry digest,
shard, offset and length. Metadata columns come from range reads of the first 33 bytes of a member; a full
read decodes the image and computes features of the samples.

Defined cases: null and empty texts give one row of 576 bytes 255; equal texts have equal values whatever
their shard; rows that repeat an id are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, staged
from .storage import Shard, open_fs

WIDTH = 576
SHARD_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A grey 8-bit PNG, one sample a byte; rows without filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from a PNG's first 33 bytes; checks signature and CRC."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or struct.unpack(">I", data[29:33])[0] != zlib.crc32(data[12:29]):
        raise ValueError("no PNG header")
    return struct.unpack(">IIBB", data[16:26])


def decode(data: bytes) -> bytes:
    """The samples of a PNG written by :func:`encode`."""
    width, height, _, _ = header(data[:HEADER])
    at, body = HEADER, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        if kind == b"IDAT":
            body += data[at + 8:at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that the writer does not use")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation, sixteen-bin histogram and a difference hash of the image scaled to 8 by 9."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    image = x.reshape(-1, WIDTH)
    rows = np.array_split(np.arange(max(8, len(image))) % len(image), 8)
    small = np.array([[int(image[r][:, c * 64:(c + 1) * 64].sum()) for c in range(9)] for r in rows])
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    mark = int("".join("1" if b else "0" for b in bits), 2)
    return f"mean={x.mean():.4f};std={x.std():.4f};hist={'.'.join(map(str, bins))};dhash={mark:016x}"


INDEX = "n_bytes long, payload_bytes long, digest string, shard string, offset long, length long"


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """A stored table of doc_id and where its image lies: digest, shard, offset, length."""
    kind = dict(docs.dtypes)["doc_id"]

    def write(batches):
        shard, known = None, {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                payload = padded(data)
                name = hashlib.sha256(payload).hexdigest()
                if shard is None or shard.at >= SHARD_BYTES:
                    if shard is not None:
                        shard.write(b"\0" * 1024)
                        shard.close()
                    shard, known = Shard(folder, ".tar"), {}
                if name not in known:
                    image = encode(payload)
                    info = tarfile.TarInfo(f"{name}.png")
                    info.size = len(image)
                    shard.write(info.tobuf(tarfile.USTAR_FORMAT))
                    known[name] = shard.write(image), len(image)
                    shard.write(b"\0" * (-len(image) % 512))
                rows.append((doc_id, len(data), len(payload), name, shard.uri, *known[name]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), [batch.schema.field(0).type, *[pa.int64()] * 2, pa.string(), pa.string(), *[pa.int64()] * 2])],
                                                 names=["doc_id", *[c.split()[0] for c in INDEX.split(", ")]])
        if shard is not None:
            shard.write(b"\0" * 1024)
            shard.close()
    return staged(docs.select("doc_id", "text").mapInArrow(write, f"doc_id {kind}, {INDEX}"), "media-index")


def _per_member(index: DataFrame, read, columns: str) -> DataFrame:
    """``index`` with columns that ``read(file, offset, length)`` gives, one call a member and batch."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema) + ", " + columns
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[k] for k in kinds]

    def run(batches):
        uri, file, seen = None, None, {}
        for batch in batches:
            place = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")]
            values = []
            for shard, offset, length in zip(*place):
                if shard != uri:
                    if file is not None:
                        file.close()
                    system, path = open_fs(shard)
                    uri, file, seen = shard, system.open_input_file(path), {}
                if offset not in seen:
                    if len(seen) > 50_000:
                        seen = {}
                    seen[offset] = read(file, offset, length)
                values.append(seen[offset])
            more = [pa.array([v[i] for v in values], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])
        if file is not None:
            file.close()
    return index.mapInArrow(run, schema)


def with_metadata(index: DataFrame) -> DataFrame:
    """Width, height, bit depth and colour type, by range reads of 33 bytes a member."""
    return _per_member(index, lambda file, offset, length: header(file.read_at(HEADER, offset)), "width int, height int, depth int, colour int")


def with_payload(index: DataFrame) -> DataFrame:
    """Hashes and features of the members, read back whole."""
    def read(file, offset, length):
        image = file.read_at(length, offset)
        samples = decode(image)
        return hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)
    return _per_member(index, read, "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """All columns of every row: place, header metadata, hashes and features."""
    folder = folder or scratch_path(docs.sparkSession, "tar")
    index = write_shards(docs, folder)
    n = index.select("shard").distinct().count()
    # A shard's rows are read by one task, in the shard's order; ranges deal shards out evenly.
    placed = index.repartitionByRange(max(1, n), "shard").sortWithinPartitions("shard", "offset")
    return with_payload(with_metadata(placed))


def digest(media: DataFrame) -> DataFrame:
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
