"""WARC archives compressed record by record with a Zstandard dictionary.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds the dictionary built from
the archive's own records; every record follows as one Zstandard frame of its own, so a record can be
read alone. Records with the payload of another one (at least ``revisit_from`` bytes) are revisits: they
keep headers and digest, not the payload.

An archive is written by the task that holds its records, once they reach ARCHIVE_BYTES; a task holds the
records of one archive at a time. Archives are rows (archive, content) of a table in the shared folder,
so every file system that Spark reads will do; :func:`write_files` stores the same archives as files, one
each, and :func:`read_files` reads them back.

Defined results: a null html is an empty payload; a null url leaves out the target header; line ends in a
url are percent-encoded; equal page_ids give equal record ids, and each row its own record; rows with a
null page_id get a record without a number and come back as null; of equal payloads the largest page_id
is the response; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, rows

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:weftgraph:page:"
DATE = "2024-01-01T00:00:00Z"

#: Bytes of records in one archive; bytes of its dictionary; records (evenly spread) and bytes of each that it is built from.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 8 << 20, 32 << 10, 200, 16 << 10
LEVEL = 6


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on a spread of the records; where they are too few or too short for that, their first bytes as they are."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except zstandard.ZstdError:
        raw = b"".join(samples)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(raw.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes]) -> bytes:
    """A whole archive."""
    shared = dictionary(records)
    body = shared.as_bytes()
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(body)), body, *map(packer.compress, records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, length = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + length]))
    view, at = memoryview(archive), 8 + length
    while at < len(view):
        one, parts, step = reader.decompressobj(), [], 1 << 16
        while not one.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("a record is cut off")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """page_id, record_type, refers_to, payload (None for a revisit), its length and SHA-1 in hex, of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(x) if (x := s.strip("<>").removeprefix(RECORD_ID)) else None
    revisit = fields["WARC-Type"] == "revisit"
    declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != declared):
        raise ValueError("payload and digest differ")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload, "payload_bytes": length, "payload_digest": declared}


def _write(batches):
    def archive() -> pa.RecordBatch:
        content = pack(held)
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest()], pa.string()), pa.array([len(held)], pa.int64()), pa.array([content], pa.binary())], names=["archive", "records", "content"])

    held: list[bytes] = []
    size = 0
    for ids, urls, html, refers in rows(batches, "page_id", "url", "html", "refers_to"):
        for i, u, h, r in zip(ids, urls, html, refers, strict=True):
            held.append(record(i, u, (h or "").encode("utf-8", "replace"), r))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                held, size = [], 0
    if held:
        yield archive()


def plan_records(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """page_id, url, html and refers_to (null: a response) of every page."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("digest", F.when(F.octet_length(html) >= revisit_from, F.sha2(html, 256)))
    first = keyed.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select("digest", "response"), "payloads")
    own = F.col("page_id").eqNullSafe(F.col("response")) | F.col("response").isNull()
    return keyed.join(first, "digest", "left").select("page_id", "url", "html", F.when(~own, F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """The archives of all pages, as written and read again: archive, records, content."""
    bounded_batches(pages.sparkSession)
    return materialize(plan_records(pages, revisit_from).mapInArrow(_write, "archive string, records long, content binary"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives (column ``content``), payloads checked against their digests."""
    archives.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                found = []
                for raw in unpack(content.as_py()):
                    found.append(parse(raw))
                    if len(found) == 256:
                        yield made(found)
                        found = []
                if found:
                    yield made(found)

    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def made(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return archives.select("content").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def write_files(pages: DataFrame, path: str, revisit_from: int = 1000) -> DataFrame:
    """Store the archives of all pages in ``path`` as ``*.warc.zst`` files: archive, records, file and n_bytes of each.

    ``path`` is an absolute path or URI that all executors can write to (file systems that pyarrow knows) and should be
    new: files of earlier calls stay. The files are made from the written table of archives, named after the task, the place
    in it and the content, and appear under their names only when whole, so a task that runs again replaces its own files.
    """

    def run(batches):
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        made = 0
        for batch in batches:
            names, sizes = [], []
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                name = f"{task.partitionId():06d}-{made:06d}-{archive[:12]}.warc.zst"
                part = f"{folder}/{name}.{task.taskAttemptId()}.part"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, f"{folder}/{name}")
                names.append(name)
                sizes.append(len(content.as_buffer()))
                made += 1
            yield pa.RecordBatch.from_arrays([batch.column("archive"), batch.column("records"), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["archive", "records", "file", "n_bytes"])

    archives = write_archives(pages, revisit_from).select("archive", "records", "content")
    return materialize(archives.mapInArrow(run, "archive string, records long, file string, n_bytes long"), "files")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``*.warc.zst`` files."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path))


def warc_round_trip(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    return read_archives(write_archives(pages, revisit_from)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same result in DuckDB's SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS last, octet_length(encode(h)) AS n FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM m
"""
