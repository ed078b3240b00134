"""WARC archives (operator 6) as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with a few records, and ends with a seek table (the public
seekable format: a skippable frame with the sizes of all frames and a footer). An index maps record identifiers to
a frame and the offset inside it, so that one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import scratch, written

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: A frame is closed beyond this many bytes of records, a bundle beyond this many compressed ones.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 6
URN, NO_PAGE, DATE = "urn:page:", "urn:no-page", "1970-01-01T00:00:00Z"
#: Plain bytes of frames that one task reads back, about.
STRETCH_BYTES = 32 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn_of(page: str | None) -> str:
    """The record identifier of a page id; what a header line cannot hold is percent-encoded."""
    return NO_PAGE if page is None else URN + quote(page, safe="/:", errors="replace")


def page_of(urn: str | None) -> str | None:
    return None if urn is None or urn == NO_PAGE else unquote(urn.removeprefix(URN))


def record(page: str | None, url: str | None, payload: bytes, refers: str | None) -> bytes:
    """A response, or a revisit with the response's HTTP headers only. Line breaks in a URL are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{urn_of(page)}>", f"WARC-Date: {DATE}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
        *([] if refers is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{urn_of(refers)}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Of one record: page, type, payload_bytes, payload_digest, refers_to; a response's digest is computed from its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + digest_of(block) != fields["WARC-Block-Digest"]:
        raise ValueError("a damaged record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, urn = fields["WARC-Payload-Digest"].removeprefix("sha1:"), lambda x: page_of(x and x[1:-1])
    if fields["WARC-Type"] == "response" and (digest_of(payload) != digest or len(payload) != size):
        raise ValueError("a damaged payload")
    return {"page": urn(fields["WARC-Record-ID"]), "type": fields["WARC-Type"], "bytes": size, "digest": digest, "refers": urn(fields.get("WARC-Refers-To"))}


class Bundle:
    """Writes frames and, at the end, their seek table."""

    def __init__(self, stream):
        import zstandard

        self.out, self.codec = stream, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.open, self.written = bytearray(), 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """The frame and the offset in it that the record gets."""
        if self.open and len(self.open) + len(raw) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), len(self.open)
        self.open += raw
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.codec.compress(bytes(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.open)))
            self.written += len(packed)
            self.open = bytearray()

    def close(self) -> None:
        self.flush()
        seek = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)
        self.out.close()


def seek_table(reader) -> list[tuple[int, int, int]]:
    """Start, compressed and plain size of each frame, from the footer."""
    size = reader.size()
    reader.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", reader.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table here")
    reader.seek(size - 9 - 8 * n)
    sizes, at, out = struct.iter_unpack("<II", reader.read(8 * n)), 0, []
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


class Reader:
    """Reads records of one bundle; the frame read last stays decompressed."""

    def __init__(self, uri: str):
        import zstandard

        system, path = fs.FileSystem.from_uri(uri)
        self.file, self.codec = system.open_input_file(path), zstandard.ZstdDecompressor()
        self.frames, self.have, self.data = seek_table(self.file), -1, b""

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.have:
            start, packed, plain = self.frames[frame]
            self.file.seek(start)
            self.data, self.have = self.codec.decompress(self.file.read(packed), max_output_size=plain), frame
        return self.data[offset : offset + length]


def with_responses(pages: DataFrame, id_col: str, html_col: str, least: int) -> DataFrame:
    """page, url, payload and refers: the largest id among the rows with an equal payload of at least `least` bytes, where that is
    another row's. Only digests that several rows share are joined back; one with very many rows is pre-aggregated
    and then split by adaptive execution."""
    rows = pages.select(F.col(id_col).alias("page"), "url" if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "utf-8").alias("payload")).withColumn("d", F.unhex(F.sha1("payload")))
    shared = rows.where(F.octet_length("payload") >= least).groupBy("d").agg(F.max("page").alias("top"), F.count("page").alias("n")).where("n > 1").select("d", "top")
    return rows.join(shared, "d", "left").select("page", "url", "payload", F.when(F.col("page") < F.col("top"), F.col("top")).alias("refers"))


def write(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0, where: str | None = None) -> DataFrame:
    """Archive the pages; returns the written index page, bundle, frame, offset (in the frame), length, uri.

    A bundle gets a name of its own for each attempt and the index is committed by Spark's writer, so a repeated
    task leaves at most a file that no row points to.
    """
    base = where or scratch(pages.sparkSession, "warc")
    root = fs.FileSystem.from_uri(base)
    root[0].create_dir(root[1])

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(base)
        bundle, name = None, ""
        for batch in batches:
            rows = []
            for page, url, payload, refers in zip(*(batch.column(i) for i in range(4))):
                if bundle is None or bundle.written >= BUNDLE_BYTES:
                    if bundle is not None:
                        bundle.close()
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(system.open_output_stream(f"{folder}/{name}", compression=None))
                other = refers.as_py()
                raw = record(None if page.as_py() is None else str(page.as_py()), url.as_py(), payload.as_py(), None if other is None else str(other))
                rows.append((page.as_py(), name, *bundle.add(raw), len(raw)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1]), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["page", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    rows = with_responses(pages, id_col, html_col, least)
    kind = rows.schema["page"].dataType.simpleString()
    index = written(rows.mapInArrow(bundles, f"page {kind}, bundle string, frame long, offset long, length long"), "warc-index")
    return index.withColumn("uri", F.concat_ws("/", F.lit(base), F.col("bundle")))


@lru_cache(maxsize=4)
def _reader(uri: str) -> Reader:
    return Reader(uri)


def read(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the index' records as the archives have them."""
    kind = index.schema["page"].dataType.simpleString()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [parsed(_reader(u).record(f, o, n)) for u, f, o, n in zip(*(part.column(c).to_pylist() for c in ("uri", "frame", "offset", "length")))]
                ids = lambda k: pa.array([x[k] for x in got], pa.string()).cast(part.column("page").type)
                yield pa.RecordBatch.from_arrays([ids("page"), pa.array([x["bytes"] for x in got], pa.int64()), pa.array([x["digest"] for x in got]), pa.array([x["type"] for x in got]), ids("refers")], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # As many partitions as stretches of frames: Spark would go by the size of the index, not by that of the records.
    stretch = F.floor(F.col("frame") / (STRETCH_BYTES // FRAME_BYTES)).alias("stretch")
    n = index.select("uri", stretch).distinct().count()
    dealt = index.repartition(max(1, n), "uri", stretch).sortWithinPartitions("uri", "frame", "offset")
    return dealt.mapInArrow(records, f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")


def archive(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write all pages and read them back; one row per page.

    NULL html is the empty payload, which counts like any other when `least` is 0. Rows that repeat an id and a
    payload are of the same type. A page with a NULL id is always a response and never referred to; its record
    is named NO_PAGE. Ids may be any text, the empty one and line breaks included. Other columns than id, url and html are ignored; a missing or NULL url leaves the field out.
    """
    return read(write(pages, id_col, html_col, least))
