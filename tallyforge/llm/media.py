"""Media columns (operator 4): content-addressed PNG payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG named by its SHA-256, in a tar shard; rows carry digest, shard, offset
and length, equal payloads the same ones. Metadata columns are filled from range reads of the header alone.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import arrow_map, scratch, written

#: Samples in a row of the image; payloads are padded to whole rows with PAD, a byte that UTF-8 never has.
ROW, PAD = 576, b"\xff"
#: A shard is closed beyond this size; a stretch of it that one task reads back. Bytes of a PNG up to the end of its header.
SHARD_BYTES, STRETCH_BYTES, HEAD = 256 << 20, 16 << 20, 33
_MAGIC, _LEVEL = b"\x89PNG\r\n\x1a\n", 6


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + PAD * (ROW * max(1, -(-len(raw) // ROW)) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG, ROW samples wide, every row unfiltered. Equal payloads give equal bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    packed = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), _LEVEL)
    parts = [_chunk(b"IDAT", packed[at : at + (1 << 30)]) for at in range(0, len(packed), 1 << 30)]
    return b"".join([_MAGIC, _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from the first HEAD bytes."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header here")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode(media: bytes) -> bytes:
    """The samples of a PNG that encode() made; every chunk's checksum is verified."""
    width, height, _ = header(media[:HEAD])
    at, packed = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and shares of eight value bands of the samples; fixed digits, so equal for equal payloads."""
    x = np.frombuffer(payload, np.uint8)
    bands = np.bincount(x >> 5, minlength=8) / len(x)
    return f"rows={len(x) // ROW};mean={x.mean():.4f};dev={x.std():.4f};bands=" + "/".join(f"{b:.4f}" for b in bands)


def store(docs: DataFrame, text_col: str = "text", where: str | None = None) -> DataFrame:
    """Write the payloads; returns the written index text_key (SHA-256 of the text), digest (SHA-256 of the stored form),
    shard, offset, length, with one row and one place for each distinct payload. NULL texts count as empty.

    Payloads never cross a shuffle: a task stores each payload that it meets once, and among the places of several
    tasks the index keeps the smallest. (Copies in other tasks' shards are space that no row points to: at most one
    for each task.) A shard gets a name of its own for each attempt and the index is committed by
    Spark's writer, so a repeated task leaves at most a file that no row points to.
    """
    base = where or scratch(docs.sparkSession, "media")
    root = fs.FileSystem.from_uri(base)
    root[0].create_dir(root[1])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(base)
        out, name, seen, end = None, "", set(), bytes(1024)
        for batch in batches:
            rows = []
            for text in batch.column(0):
                text = text.as_py() or ""
                key = hashlib.sha256(text.encode("utf-8")).digest()
                if key in seen:
                    continue
                seen.add(key)
                if out is None or out.tell() >= SHARD_BYTES:
                    if out is not None:
                        out.write(end)
                        out.close()
                    name = f"shard-{uuid.uuid4().hex}.tar"
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                media = encode(payload_of(text))
                digest = hashlib.sha256(media).hexdigest()
                member = tarfile.TarInfo(f"{digest}.png")
                member.size = len(media)
                out.write(member.tobuf(tarfile.USTAR_FORMAT if len(media) < 8 << 30 else tarfile.GNU_FORMAT))
                rows.append((key, digest, name, out.tell(), len(media)))
                out.write(media + bytes(-len(media) % 512))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["text_key", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(end)
            out.close()

    found = docs.select(F.col(text_col)).mapInArrow(shards, "text_key binary, digest string, shard string, offset long, length long")
    place = F.min(F.struct("shard", "offset", "length", "digest")).alias("place")
    index = written(written(found, "media-places").groupBy("text_key").agg(place).select("text_key", "place.*"), "media-index")
    return index.withColumn("folder", F.lit(base))


def dealt(index: DataFrame) -> DataFrame:
    """The index' rows, a stretch of a shard in one task and in order of offset. Their number of partitions is that of the
    stretches, since Spark would go by the size of the index, not by that of the payloads."""
    stretch = F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch")
    n = index.select("folder", "shard", stretch).distinct().count()
    return index.repartition(max(1, n), "folder", "shard", stretch).sortWithinPartitions("folder", "shard", "offset")


def _ranges(index: DataFrame, names: list[str], kinds: str, of) -> DataFrame:
    """The index with further columns: of(reader, offset, length) for each row, in the order in which the rows come."""
    kept = index.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, got = batch.slice(at, 256), []
                for folder, shard, offset, length in zip(*(part.column(c).to_pylist() for c in ("folder", "shard", "offset", "length"))):
                    if name != (folder, shard):
                        if reader is not None:
                            reader.close()
                        system, path = fs.FileSystem.from_uri(folder)
                        name, reader = (folder, shard), system.open_input_file(f"{path}/{shard}")
                    got.append(of(reader, offset, length))
                cols = [pa.array(c) for c in zip(*got)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*kept, *names])

    return index.mapInArrow(read, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in index.schema), kinds]))


def metadata(index: DataFrame) -> DataFrame:
    """The index with width, height and bits of each stored payload, from a read of its first HEAD bytes only."""
    return _ranges(dealt(index), ["width", "height", "bits"], "width int, height int, bits int", lambda f, offset, _: _header_at(f, offset))


def _header_at(reader, offset: int) -> tuple:
    reader.seek(offset)
    return tuple(np.int32(x) for x in header(reader.read(HEAD)))


def _features_at(reader, offset: int, length: int) -> tuple:
    reader.seek(offset)
    media = reader.read(length)
    payload = decode(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(media).hexdigest(), feature(payload)


def features(index: DataFrame) -> DataFrame:
    """The index with payload_bytes, payload_sha256, tail_crc32, media_sha256 and feature of each stored payload as read back."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"]
    return _ranges(index, names, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string", _features_at)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_bytes, and of the stored payload payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, width, height, feature, shard and offset. Width and height come from header reads, the others from reads of
    the whole stored form, in one pass over the shards.

    Equal texts share one stored payload. NULL texts count as empty, whose payload is one row of PAD bytes.
    Repeated rows and NULL ids stay; other columns are ignored. The join back is on the text's digest; a digest
    with very many rows is split by adaptive execution, as the stored side has each digest once.
    """
    got = features(metadata(store(docs, text_col)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("text_key"))
    return rows.join(got, "text_key").select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "width", "height", "feature", "shard", "offset")


def members(shard: bytes) -> dict[str, bytes]:
    """Names and contents of a shard, by the standard library's reader; for tests."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
