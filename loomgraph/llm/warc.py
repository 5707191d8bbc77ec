"""WARC archives as seekable Zstandard bundles.

A bundle holds WARC records in independent Zstandard frames of about ``FRAME`` bytes each, followed by a
skippable frame with the seek table (compressed and plain size of every frame, then the magic number), so
that any frame can be read by seeking from the end of the file. An index maps each record to its bundle,
its frame and its offset within the plain frame; ``fetch`` reads only the frames it needs.

Records of equal payloads of at least ``LEAST_REVISIT`` bytes are written once, as the response of the
smallest id; the others are revisit records that name it and carry digest and length, without payload.

A bundle's rows are those whose hashed id and digest name it, in the order of id and digest, so a task
that runs again writes the same bytes; it writes under a name of its own attempt and renames at the end. Each bundle
is written, and read, by a task of its own.

Defined results: a null html has an empty payload; ids may repeat (each row is a record; equal rows with
the smallest id are all responses); a null id sorts last and is ``null:`` in headers, where all other ids stand in
percent encoding; a null url is left out of the header.
"""

from __future__ import annotations

import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

FRAME = 262_144
#: Payload bytes that a bundle is meant to have.
BUNDLE = 32_000_000
LEAST_REVISIT = 100
LEVEL = 3
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
#: A null id; encoded ids have no colon.
NULL = "null:"
FIXED_DATE = "1970-01-01T00:00:00Z"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def urn(page) -> str:
    """An id as it stands in a header."""
    return NULL if page is None else urllib.parse.quote(str(page), safe="")


def record(number: str, kind: str, url: str | None, digest: str, length: int, payload: bytes, refers: str | None) -> bytes:
    """One WARC/1.1 record."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{number}>", f"WARC-Date: {FIXED_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(frame: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at an offset, and the offset after it."""
    end = frame.index(b"\r\n\r\n", at)
    lines = frame[at:end].decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(head["Content-Length"])
    return head, frame[start : start + size], start + size + 4


class BundleWriter:
    def __init__(self, out):
        self.out, self.frames, self.buffer, self.held = out, [], [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset of the record."""
        if self.held and self.held + len(data) > FRAME:
            self.flush()
        at = (len(self.frames), self.held)
        self.buffer.append(data)
        self.held += len(data)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.held))
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


class BundleReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 128 else 8
        source.seek(size - 9 - count * entry)
        table = source.read(count * entry)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * entry)
            self.frames.append((at, packed, plain))
            at += packed
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.source.seek(at)
        return self.decompressor.decompress(self.source.read(packed), max_output_size=max(plain, 1))


def planned(pages: DataFrame, id_col: str, payload_col: str, url_col: str) -> DataFrame:
    """Rows to write (side 1): page_id, url, html, digest, n_bytes; and for each id and digest to be written as a
    revisit, a row (side 0) with the id it refers to, which comes before them in order. Payloads move once."""
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).select(
        "page_id", "url", "html", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes")
    )
    large = rows.where(F.col("n_bytes") >= LEAST_REVISIT).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    revisits = large.join(first, "digest").where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))).distinct()
    none = F.lit(None).cast("string")
    return rows.withColumn("first", F.lit(None).cast(rows.schema["page_id"].dataType)).withColumn("side", F.lit(1)).unionByName(
        revisits.select("page_id", none.alias("url"), none.alias("html"), "digest", F.lit(0).cast("long").alias("n_bytes"), "first", F.lit(0).alias("side"))
    )


def write(pages: DataFrame, folder: str | None = None, bundles: int | None = None, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write all rows to bundles in ``folder``; returns the index: page_id, bundle, frame, offset, and the bundle's path."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    if bundles is None:
        size = pages.agg(F.sum(F.octet_length(payload_col)).alias("b")).first()["b"] or 0
        bundles = max(8, -(-int(size) // BUNDLE))
    rows = planned(pages, id_col, payload_col, url_col)
    kind = rows.schema["page_id"].dataType.simpleString()
    placed = rows.withColumn("bundle", F.pmod(F.xxhash64("page_id", "digest"), F.lit(bundles)).cast("int")).repartitionById(bundles, "bundle").sortWithinPartitions("bundle", "page_id", "digest", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = file_system(folder)
        writer = out = number = None
        name = ""
        index: dict[str, list] = {"page_id": [], "bundle": [], "frame": [], "offset": []}

        def finish() -> pa.RecordBatch:
            writer.close()
            out.close()
            own.move(name, f"{base}/bundle-{number:06d}.warc.zst")
            batch = pa.RecordBatch.from_arrays([pa.array(index["page_id"], ids), pa.array(index["bundle"], pa.int32()), pa.array(index["frame"], pa.int32()), pa.array(index["offset"], pa.int64())], names=list(index))
            for v in index.values():
                v.clear()
            return batch

        ids, told = None, (None, None, None)
        for b in batches:
            ids = b.column("page_id").type
            for page, url, html, digest, n, first, side, k in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "n_bytes", "first", "side", "bundle"))):
                if side == 0:
                    told = (page, digest, first)
                    continue
                refers = told[2] if told[:2] == (page, digest) else None
                if k != number:
                    if writer is not None:
                        yield finish()
                    number, name = k, f"{base}/.attempt-{uuid.uuid4().hex}"
                    out = own.open_output_stream(name)
                    writer = BundleWriter(out)
                payload = b"" if refers is not None else html.encode("utf-8")
                frame, offset = writer.add(record(urn(page), "response" if refers is None else "revisit", url, digest, n, payload, None if refers is None else urn(refers)))
                for key, value in (("page_id", page), ("bundle", k), ("frame", frame), ("offset", offset)):
                    index[key].append(value)
        if writer is not None:
            yield finish()

    index = materialise(placed.mapInArrow(run, f"page_id {kind}, bundle int, frame int, offset long"), "warc-index")
    return index.withColumn("path", F.concat(F.lit(folder + "/bundle-"), F.lpad(F.col("bundle").cast("string"), 6, "0"), F.lit(".warc.zst")))


def paged(head: dict[str, str], payload: bytes) -> tuple:
    kind = head["WARC-Type"]
    refers = head["WARC-Refers-To"][10:-1] if "WARC-Refers-To" in head else None
    if kind == "response":
        return head["WARC-Record-ID"][10:-1], len(payload), hashlib.sha256(payload).hexdigest(), kind, refers, payload
    return head["WARC-Record-ID"][10:-1], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), kind, refers, payload


FIELDS = "number string, payload_bytes long, payload_digest string, record_type string, refers string"
ARROW = [("number", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string())]


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the bundles that an index names, decoded frame by frame."""
    last = index.agg(F.max("bundle").alias("n")).first()["n"]
    paths = index.select("path", "bundle").distinct().repartitionById((last or 0) + 1, "bundle").select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("path").to_pylist():
                fs, path = file_system(uri)
                with fs.open_input_file(path) as source:
                    bundle = BundleReader(source)
                    for k in range(len(bundle.frames)):
                        frame, at, rows = bundle.frame(k), 0, []
                        while at < len(frame):
                            head, payload, at = parse(frame, at)
                            rows.append(paged(head, payload))
                        cols = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(ARROW)]
                        names = [n for n, _ in ARROW]
                        if payloads:
                            cols, names = [*cols, pa.array([r[5] for r in rows], pa.binary())], [*names, "payload"]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return paths.mapInArrow(run, FIELDS + ", payload binary" * payloads)


def fetch(index: DataFrame) -> DataFrame:
    """The records of the index rows given, read by seeking to their frames: page_id, number, ..., payload."""
    kind = index.schema["page_id"].dataType.simpleString()
    rows = index.select("page_id", "path", "frame", "offset").repartition("path").sortWithinPartitions("path", "frame", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bundle, frame, source = (None, None), None, b"", None
        for b in batches:
            out = []
            for uri, k, at in zip(*(b.column(c).to_pylist() for c in ("path", "frame", "offset"))):
                if uri != held[0]:
                    if source is not None:
                        source.close()
                    fs, path = file_system(uri)
                    source = fs.open_input_file(path)
                    bundle = BundleReader(source)
                if (uri, k) != held:
                    frame, held = bundle.frame(k), (uri, k)
                head, payload, _ = parse(frame, at)
                out.append(paged(head, payload))
            cols = [b.column("page_id"), *(pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(ARROW)), pa.array([r[5] for r in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", *(n for n, _ in ARROW), "payload"])
        if source is not None:
            source.close()

    return rows.mapInArrow(run, f"page_id {kind}, {FIELDS}, payload binary")


def digest_of(records: DataFrame, kind: str) -> DataFrame:
    """The columns that describe each page's record."""

    def number(c: str):
        return F.when(F.col(c) != NULL, F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))).cast(kind)

    return records.select(number("number").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers").alias("refers_to"))
