"""Media columns: payloads in tar shards, addressed by content, with metadata from range reads of headers.

A text's payload is its UTF-8 bytes and zero bytes up to a positive multiple of 64. It is stored losslessly as an
8-bit grey PNG, 64 samples wide, one payload row per image row; equal payloads are stored once. A member of a shard
is named by its payload's SHA-256 (bytes in flight, hexadecimal in names and in the result); rows carry digest, shard,
offset and length of the stored form. Metadata columns (width, height, depth) come from a range read of the header
alone; payloads come back by a range read of the member.

The shards stay where they are written, for whoever reads the columns.

Shards are written by the tasks through the file system of the folder's URI. Each attempt of a task writes shards of
its own, and the rows that name them are checkpointed, so a lost or repeated attempt leaves at most an unreferenced
file. Members never cross shards; a shard is closed at `shard_bytes`, and a payload is held in memory one at a time.

Defined results: a null or empty text has a payload of 64 zero bytes; repeated rows and null ids are kept; an empty
table gives an empty result and no shards; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridx.llm import textvec as tv
from gridx.llm.common import broadcast_within, checkpoint_folder, cut, looked_up, texts

WIDTH = 64
SHARD_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and IHDR chunk
LEVEL = 1


def payload_of(text: bytes) -> bytes:
    """The text's bytes, padded with zero bytes to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image whose samples are the payload, each row without a filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    scan = np.zeros((len(rows), WIDTH + 1), np.uint8)
    scan[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes of a stored form."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a stored form")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode_png(stored: bytes) -> bytes:
    """The payload; every chunk's checksum is verified."""
    width, height, _ = read_header(stored[:HEADER_BYTES])
    at, packed = 8, b""
    while at < len(stored):
        size = struct.unpack(">I", stored[at : at + 4])[0]
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged stored form")
        if kind == b"IDAT":
            packed += body
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes, width: int, height: int, bits: int) -> str:
    """Shape, and the samples' mean and share of letters of the alphabet's lower case, as text."""
    samples = np.frombuffer(payload, np.uint8)
    lower = int(((samples >= 97) & (samples <= 122)).sum())
    return f"png {width}x{height}x{bits} sum={int(samples.sum(dtype=np.int64))} lower={lower} distinct={int((np.bincount(samples, minlength=256) > 0).sum())}"


class Shards:
    """Appends members to tar shards under a folder, a new shard after shard_bytes."""

    def __init__(self, folder: str, shard_bytes: int) -> None:
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.shard_bytes, self.stream, self.at, self.name = shard_bytes, None, 0, ""

    def add(self, digest: bytes, stored: bytes) -> tuple[str, int]:
        """(shard, offset of the member's bytes)."""
        if self.stream is None:
            self.name, self.at = f"{uuid.uuid4().hex[:20]}.tar", 0
            self.stream = self.fs.open_output_stream(f"{self.path}/{self.name}")
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(stored)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        offset = self.at + len(head)
        tail = bytes(-len(stored) % tarfile.BLOCKSIZE)
        self.stream.write(head + stored + tail)
        self.at = offset + len(stored) + len(tail)
        place = self.name, offset
        if self.at >= self.shard_bytes:
            self.close()
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(bytes(2 * tarfile.BLOCKSIZE))
            self.stream.close()
            self.stream = None


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary())])
_PLACES = pa.schema([("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_META = "digest binary, shard string, offset long, length long, width int, height int, bits int"
_SHAPED = ["shard", "offset", "length", "width", "height", "bits"]
_READ = "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def _payloads(column: pa.Array) -> Iterator[bytes]:
    data, off = tv.buffers(column)
    for i in range(len(off) - 1):
        yield data[off[i] : off[i + 1]].tobytes()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, names = [], []
        for text in _payloads(batch.column("text")):
            size.append(len(text))
            names.append(hashlib.sha256(payload_of(text)).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(names, pa.binary())], schema=_DIGESTS)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [hashlib.sha256(payload_of(text)).digest() for text in _payloads(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.binary()), batch.column("text")], names=["doc_id", "digest", "text"])


def _write(folder: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, shard_bytes)
        for batch in batches:
            rows, seen = [], set()
            for text in _payloads(batch.column("text")):
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    seen.add(digest)
                    stored = encode_png(payload)
                    rows.append((digest, *shards.add(digest, stored), len(stored)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PLACES.types, strict=True)], schema=_PLACES)
        shards.close()

    return run


class Ranges:
    """Range reads from shards under a folder; keeps the last shard open."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.path}/{shard}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _places(batch: pa.RecordBatch) -> Iterator[tuple[bytes, str, int, int]]:
    return zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True)


def _heads(folder: str):
    """Places with the metadata that a range read of each header gives."""
    kinds = [*_PLACES.types, pa.int32(), pa.int32(), pa.int32()]
    names = [*_PLACES.names, "width", "height", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)
        for batch in batches:
            rows = [read_header(ranges.read(s, o, HEADER_BYTES)) for _, s, o, _ in _places(batch)]
            found = [pa.array([r[k] for r in rows], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in _PLACES.names], *found], schema=pa.schema(list(zip(names, kinds, strict=True))))
        ranges.close()

    return run


def _read_back(folder: str):
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)
        for batch in batches:
            rows = []
            shapes = zip(*(batch.column(c).to_pylist() for c in ("width", "height", "bits")), strict=True)
            for (digest, shard, offset, length), (width, height, bits) in zip(_places(batch), shapes, strict=True):
                stored = ranges.read(shard, offset, length)
                payload = decode_png(stored)
                rows.append((digest, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).digest(), feature_of(payload, width, height, bits)))
            found = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            kept = [batch.column(n) for n in _SHAPED]
            yield pa.RecordBatch.from_arrays([*found, *kept], names=[*names, *_SHAPED])
        ranges.close()

    return run


def default_folder(spark: SparkSession) -> str:
    """A new folder beside the cluster's checkpoints, as a URI that driver and executors share."""
    return f"{checkpoint_folder(spark)}/media-{uuid.uuid4().hex}"


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n_bytes, digest; places: digest, shard, offset, length), with the payloads in tar shards.

    Which row writes a payload is settled before any payload moves: rows whose digest a smaller doc_id has are
    left out of the writing pass, so texts are never shuffled to find copies. An id may repeat with several texts:
    its texts that no smaller doc_id has are written.
    """
    table = texts(docs)
    rows = cut(table.mapInArrow(_digest, "doc_id long, n_bytes long, digest binary"))
    owners = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1"))
    copies = cut(looked_up(rows, owners, "digest").where("doc_id > owner").select("doc_id", "digest").distinct())
    ids = cut(copies.select("doc_id").distinct())
    n = ids.count()
    first = table.join(broadcast_within(ids, n), "doc_id", "left_anti") if n else table
    # rows of an id that is left out, but with a text of its own
    own = cut(rows.join(broadcast_within(ids, n), "doc_id", "left_semi").join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", "digest").distinct())
    m = own.count()
    if m:
        named = table.join(broadcast_within(own.select("doc_id").distinct(), m), "doc_id", "left_semi").mapInArrow(_named, "doc_id long, digest binary, text string")
        first = first.unionByName(named.join(broadcast_within(own, m), ["doc_id", "digest"], "left_semi").select("doc_id", "text"))
    written = cut(first.mapInArrow(_write(folder, shard_bytes), "digest binary, shard string, offset long, length long"))
    return rows, written.dropDuplicates(["digest"])


def _in_shard_order(places: DataFrame) -> DataFrame:
    return places.repartition("shard", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("shard", "offset")


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """The places with width, height and bits, from header-only range reads."""
    return _in_shard_order(places).mapInArrow(_heads(folder), _META)


def read_back(found: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes of places with metadata give: payload size and digest, tail checksum, stored size and
    digest, feature; places and metadata come along."""
    more = _META.split(", ", 1)[1]
    return found.mapInArrow(_read_back(folder), f"{_READ}, {more}")


def media_columns(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, digest; shard, offset and length of its stored form under the folder;
    width, height and bits from its header; and what its payload, read back, gives."""
    folder = folder or default_folder(docs.sparkSession)
    rows, places = store(docs, folder, shard_bytes)
    found = looked_up(rows, cut(read_back(metadata(places, folder), folder)), "digest", most=0)  # wide rows
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256")})
