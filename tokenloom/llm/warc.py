"""Dictionary-compressed WARC archives (.warc.zst).

An archive starts with a skippable frame that holds a Zstandard dictionary built
from records of that archive; every record that follows is one frame of its own,
compressed with that dictionary, so any record can be read given the dictionary
and its offset. Payloads that occur more than once are archived in full for the
page with the largest id only; the others become revisit records that refer to
it. Which pages those are is settled by joining (digest, id) pairs, without the
payloads; each payload then travels once, to the task that writes its archive.

Archives are written under another name and renamed when complete, and their
final names hold the number of the attempt, so attempts of one task never touch
each other's archives, whatever they cut differently. Which archives count is the
list that write_archives() returns, from the attempts that Spark accepted; others
in the folder are left over from lost attempts.

Defined cases: a null payload is empty and archived as such; a null url is written
as urn:page:<id>; rows that repeat the largest id of a payload are all responses;
a row with a null id revisits the largest id of its payload if there is one and
is a response otherwise; payloads of any length
are archived whole; an empty table gives no archive. Columns besides id, url and
payload are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_size

DICTIONARY_MAGIC = 0x184D2A5D
_SAMPLE_BYTES, _DICTIONARY_BYTES = 1 << 20, 64 << 10
_NAMESPACE = uuid.UUID("5b0e7c4e-58a4-4d68-9d62-2f6a1f5f6c10")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def _header_value(x: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or with refers_to a revisit record, as uncompressed bytes."""
    revisit = refers_to is not None
    http = _HTTP % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Target-URI: {_header_value(url) if url is not None else f'urn:page:{page_id}'}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is longer or shorter than its header says")
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    if warc["WARC-Type"] == "response" and f"sha1:{digest32(payload)}" != warc["WARC-Payload-Digest"]:
        raise ValueError("a payload does not match its digest")
    return warc, http, payload


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from records: trained if they are enough for that, else their raw end."""
    try:
        return zstandard.train_dictionary(min(_DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-_DICTIONARY_BYTES:] or b"WARC/1.1\r\n"


class Archive:
    """Writer of one archive; the first records wait until there are enough for the dictionary."""

    def __init__(self, files: fs.FileSystem, path: str, level: int):
        self.files, self.path, self.level = files, path, level
        self.temporary = f"{path}.{uuid.uuid4().hex}.part"
        self.out = files.open_output_stream(self.temporary, compression=None)
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.size = self.records = 0
        self.compressor = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor:
            return self._write(self.compressor.compress(record))
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= _SAMPLE_BYTES:
            self._start()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _start(self) -> None:
        data = build_dictionary(self.waiting)
        self._write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        # One level for the tables of the dictionary, and sizes in every frame for a reader that allocates once.
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True)
        for record in self.waiting:
            self._write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> None:
        if not self.compressor:
            self._start()
        self.out.close()
        self.files.move(self.temporary, self.path)


def read_archive(stream) -> Iterator[bytes]:
    """Records of an archive. stream: an open binary file."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    pending = b""
    while True:
        frame = reader.decompressobj()
        parts = []
        while not frame.eof:
            if not pending and not (pending := stream.read(1 << 20)):
                if parts or frame.unused_data:
                    raise ValueError("an archive ends within a record")
                return
            parts.append(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def settle_revisits(pages: DataFrame, *, page_id: str, payload: str, least_bytes: int, many_pages: int = 100_000) -> DataFrame:
    """(page_, digest_, refers_): distinct ids and digests that revisit, and the id they refer to."""
    own = pages.select(F.col(page_id).cast("long").alias("page_"), F.sha1(F.coalesce(payload, F.lit(""))).alias("digest_"), F.octet_length(F.coalesce(payload, F.lit(""))).alias("bytes_"))
    own = own.where(F.col("bytes_") >= least_bytes).groupBy("digest_", "page_").agg(F.count("*").alias("rows_"))
    own = materialise(own, "warc-digests")
    largest = materialise(own.groupBy("digest_").agg(F.max("page_").alias("refers_"), F.count("*").alias("pages_")).where("refers_ is not null and pages_ > 1"), "warc-largest")
    # Payloads of very many pages (the empty one) are few, so their pages stay where they are; the others are joined by digest.
    many = largest.where(F.col("pages_") > many_pages).select("digest_", F.col("refers_").alias("many_"))
    marked = own.join(with_size(many), "digest_", "left")
    rest = marked.where("many_ is null").drop("many_").join(largest.where(F.col("pages_") <= many_pages).drop("pages_"), "digest_")
    found = rest.select("page_", "digest_", "refers_").union(marked.where("many_ is not null").select("page_", "digest_", "many_"))
    return materialise(found.where("page_ is null or page_ != refers_"), "warc-revisits")


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, archive_bytes: int = 1 << 30, level: int = 3, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page below path; the archives written: file, records, bytes.

    Of equal payloads of at least least_bytes the page with the largest id is the
    response and the others revisit it.
    """
    revisits = settle_revisits(pages, page_id=page_id, payload=payload, least_bytes=least_bytes)
    own = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(payload, F.lit("")).alias("payload"), F.sha1(F.coalesce(payload, F.lit(""))).alias("digest"))
    on = own["page"].eqNullSafe(revisits["page_"]) & (own["digest"] == revisits["digest_"])
    rows = own.join(revisits, on, "left").select("page", "url", "payload", "digest", "refers_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        files.create_dir(base, recursive=True)
        task, archive, done = TaskContext.get(), None, []
        for batch in batches:
            payloads = batch.column(2).cast(pa.binary())
            for page, address, body, digest, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if archive is None:
                    archive = Archive(files, f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst", level)
                archive.add(make_record(page, address, body.as_py(), base64.b32encode(bytes.fromhex(digest)).decode(), refers, date))
                if archive.size >= archive_bytes:
                    archive.close()
                    done.append(archive)
                    archive = None
        if archive:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_arrays([pa.array([a.path for a in done], pa.string()), pa.array([a.records for a in done], pa.int64()), pa.array([a.size for a in done], pa.int64())], ["file", "records", "bytes"])

    return materialise(rows.mapInArrow(run, "file string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, path: str, *, with_payload: bool = False) -> DataFrame:
    """Records of the archives that a frame lists by file, an archive per task at least."""
    schema = "file string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    n = max(1, archives.count())
    listed = archives.select("file").repartitionByRange(min(n, 10_000), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with files.open_input_stream(name, compression=None) as stream:
                    for data in read_archive(stream):
                        warc, http, payload = parse_record(data)
                        row = [name, number(warc.get("X-Page-Id")), warc["WARC-Target-URI"], warc["WARC-Type"], number(warc.get("X-Refers-To-Page-Id")), int(http["Content-Length"]) if warc["WARC-Type"] == "revisit" else len(payload), warc["WARC-Payload-Digest"].removeprefix("sha1:")]
                        rows.append([*row, payload] if with_payload else row)
                        size += len(payload) if with_payload else 0
                        if len(rows) == 10_000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return listed.mapInArrow(run, schema)


__all__ = ["Archive", "build_dictionary", "digest32", "make_record", "parse_record", "read_archive", "read_archives", "settle_revisits", "write_archives"]
