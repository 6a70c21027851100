"""Dictionary-compressed WARC archives of pages (operator 9).

An archive starts with a skippable Zstandard frame that holds the dictionary; behind it each
WARC record is a frame of its own, so any record can be read given its offset and the dictionary.
Of the records with equal payloads the one with the largest page id is the response, the others
revisit it.

Tasks write straight to the shared folder under names of their own, and only the names that
finished tasks returned are read: a lost executor leaves an unlisted file, never a wrong result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import new_folder, stage

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_ID = b"\x37\xa4\x30\xec"
#: Records sampled for the dictionary, bytes taken of each, size of the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 4_096, 65_536
#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 128 << 20


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    if uri.startswith("file:"):
        uri = "file://" + re.sub("^file:/*", "/", uri)
    return pyarrow.fs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; too few samples to train on serve as raw content, none as no dictionary."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(raw: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == DICTIONARY_ID else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind) if raw else None


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps digest and length of the payload that it does not repeat."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.insert(2, "WARC-Target-URI: " + re.sub(r"[\r\n]+", "%0A", url))
    if revisit:
        lines.insert(2, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.insert(3, f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def mark_revisits(pages: DataFrame, least: int, id_col: str, payload_col: str) -> DataFrame:
    """Adds ``refers_to``: the response's id for a page that revisits it, else null.

    Only digests travel to find equal payloads (a groupBy with map-side combine); the groups of
    more than one page are staged, so Spark knows their size when it joins them to the pages."""
    base = pages.withColumn("_digest", F.when(F.octet_length(payload_col) >= least, F.sha2(F.col(payload_col).cast("binary"), 256)))
    groups = stage(base.filter("_digest is not null").groupBy("_digest")
                   .agg(F.max(id_col).alias("_keep"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "warc-groups")
    return (base.join(groups, "_digest", "left")
            .withColumn("refers_to", F.when(~F.col("_keep").eqNullSafe(F.col(id_col)), F.col("_keep"))).drop("_digest", "_keep"))


def write_archives(pages: DataFrame, folder: str, least_revisit_bytes: int = 0, date: str | None = None, level: int = 6,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives below ``folder``; returns their list
    ``(path, n_records, n_bytes)``, itself staged.

    Null html is an empty payload; a null url writes no target; repeated page rows are repeated
    records (equal ids with equal payloads: each is a response when it holds the largest id); a
    null id never is a response to others; an empty table writes no archive; other columns are ignored.
    """
    import zstandard

    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    marked = mark_revisits(pages, least_revisit_bytes, "page_id", "html")
    # about SAMPLE_RECORDS by a hash of the id, whatever the number of tasks; only the heads of these travel
    part = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30))
    sample = pages.filter(part < int((1 << 30) * min(1, SAMPLE_RECORDS / max(1, pages.count()))))
    samples = [record(r.page_id, r.url, r.head, "", None, False, date)
               for r in sample.select("page_id", "url", F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES).alias("head")).limit(2 * SAMPLE_RECORDS).collect()]
    shared = spark.sparkContext.broadcast(train_dictionary([bytes(s) for s in samples]))
    open_folder(folder)[0].create_dir(open_folder(folder)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        words = _dictionary(shared.value)
        pack = zstandard.ZstdCompressor(level=level, dict_data=words) if words else zstandard.ZstdCompressor(level=level)
        out, done = None, []
        for batch in batches:
            for p, u, h, r in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                payload, to = h.as_py().encode(), r.as_py()
                frame = pack.compress(record(p.as_py(), u.as_py(), payload, sha1_base32(payload), to, to is not None, date))
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out, n, size = files.open_output_stream(path, compression=None), 0, 0
                    if words:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(shared.value)) + shared.value)
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "n_records", "n_bytes"])

    return stage(marked.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-list")


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)`` of each record;
    the digest of a response is taken anew from its payload."""
    number = lambda s: None if s == "None" else int(s)
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {version[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(": ")
            fields[key] = value
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        page = number(fields["WARC-Record-ID"][len("<urn:page:"):-1])
        length, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "revisit":
            yield page, fields.get("WARC-Target-URI"), "revisit", number(fields["WARC-Refers-To"][len("<urn:page:"):-1]), length, digest, None
            continue
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if len(payload) != length or sha1_base32(payload) != digest:
            raise ValueError(f"page {page}: its payload isn't what was written")
        yield page, fields.get("WARC-Target-URI"), "response", None, length, digest, payload


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the listed archives: each archive is streamed once, in tasks of a few archives."""
    import zstandard

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = open_folder(path)
                with files.open_input_file(at) as f:
                    head = f.read(8)
                    magic, n = struct.unpack("<II", head)
                    words = _dictionary(f.read(n)) if magic == DICTIONARY_MAGIC else None
                    if words is None:
                        f.seek(0)
                    d = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
                    rows, size = [], 0
                    for r in parse_records(io.BufferedReader(d.stream_reader(f, read_across_frames=True, closefd=False), 1 << 20)):
                        rows.append(r if payload else (*r[:6], None))
                        size += len(rows[-1][6] or b"") + 200
                        if size > 8 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                    if rows:
                        yield pack(rows)

    n = max(1, archives.count())
    return archives.repartition(n, "path").mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive the pages, read the archives back and return the digest columns of each record."""
    folder = new_folder(spark, "warc")
    listed = write_archives(pages, folder)
    files, base = open_folder(folder)
    scheme = folder[: folder.rindex(base)] if base in folder else ""
    paths = listed.withColumn("path", F.concat(F.lit(scheme), "path"))
    return read_archives(paths, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
