"""WARC archives: a writer of gzip members and a salvage reader.

Writing: records of equal payloads are folded by digest (SHA-1, base32) and length; the one
with the smallest page_id is a response, the others revisit it. Each task packs its records, one
gzip member each, into archives of about ARCHIVE bytes and puts them into a folder that all
machines share, under a name that only this attempt uses, so a lost executor's half-written
file is never read: the table of archives that the attempts return names the valid ones.

Reading: archives are loaded by Spark's binaryFile source, and each is parsed from its start.
Where a member or record fails a check (gzip checksum, version line, header, block length,
payload digest), the reader searches for the next gzip magic or WARC version line from which
a whole valid record can be read, goes on there, and reports the bytes between as a gap.
Plain and gzip records may alternate, and a member may hold several records: those before and
after a bad one in it are read, and of a damaged member those whose payload digest holds and that
other unpacked bytes follow, so the one at the damage stays quarantined. Records have the offset and bytes of their member (no bytes in a damaged
one), which is logged as a gap too. The payload of an HTTP message is its body; a chunked one
is not held against its digest. A gap is logged as (archive, offset, n_bytes, reason). An archive
and its largest unpacked member are held by one task.

Nulls: a null html is an empty payload. A null page_id is written as none and comes back as
null; it yields to any row with an id as response, and where a group has no id all its rows
are responses. Rows that share the smallest page_id of a group are all responses. A null url
is an empty target. Extra columns are ignored. An empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, scratch_path, written

#: Compressed bytes after which a task begins another archive.
ARCHIVE = 8 << 20
VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORDS = "archive string, offset long, n_bytes long, record_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, reason string"
_FIRST_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One WARC record, uncompressed; a revisit has no block."""
    block = payload if kind == "response" else b""
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {re.sub(r'[\x00-\x20]+', '%20', uri)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Found(NamedTuple):
    """A record, or a gap if kind is None."""

    offset: int
    n_bytes: int
    kind: str | None
    headers: dict[str, str]
    block: bytes
    reason: str | None


class Record(NamedTuple):
    """A plain record: where it ends, and whether its payload was held against a digest."""

    end: int
    kind: str
    headers: dict[str, str]
    block: bytes
    checked: bool


def _parsed(data, at: int) -> Record:
    """The plain record at a place; ValueError if it fails a check."""
    first = _FIRST_LINE.match(data, at)
    if not first:
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", first.end() - 2)
    if stop < 0:
        raise ValueError("header without end")
    headers = {}
    for line in bytes(data[first.end() : stop]).decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit() or not headers.get("warc-type"):
        raise ValueError("no length or type")
    begin, end = stop + 4, stop + 4 + int(size)
    if end > len(data):
        raise ValueError("block cut short")
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block of another length")
    block, kind = bytes(data[begin:end]), headers["warc-type"]
    if kind != "response":
        return Record(end + 4, kind, headers, block, False)
    payload, digest = payload_of(headers, block), headers.get("warc-payload-digest", "")
    length = headers.get("x-payload-length", "")
    if length.isascii() and length.isdigit() and int(length) != len(payload):
        raise ValueError("payload length")
    checked = len(digest) == 37 and digest.startswith("sha1:") and not _chunked(headers, block)
    if checked and base32_sha1(payload) != digest[5:].upper():
        raise ValueError("payload digest")
    return Record(end + 4, kind, headers, block, checked)


def _chunked(headers: dict[str, str], block: bytes) -> bool:
    head = block.partition(b"\r\n\r\n")[0]
    return headers.get("content-type", "").startswith("application/http") and re.search(rb"(?im)^transfer-encoding:.*chunked", head) is not None


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The body of an HTTP message, any other block as it is."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def _unpacked(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """What the gzip member at a place holds, its end, and why it is damaged ("" if it is not)."""
    unpacker = zlib.decompressobj(31)
    parts, given = [], at
    try:
        while not unpacker.eof and given < len(data):  # in steps, so that what follows the member is not copied
            parts.append(unpacker.decompress(data[given : given + step]))
            given += step
    except zlib.error:
        # small steps give all that lies before the damage
        return _unpacked(data, at, 256) if step > 256 else (b"".join(parts), at, "gzip member")
    return b"".join(parts), min(given, len(data)) - len(unpacker.unused_data), "" if unpacker.eof else "gzip member cut short"


def _at(data: bytes, at: int) -> tuple[int, list[Record], str]:
    """The end of the record or member at a place, its valid records, and why others fail; the end of
    a damaged one is the place itself."""
    if data[at : at + 3] != b"\x1f\x8b\x08":
        try:
            one = _parsed(data, at)
        except ValueError as error:
            return at, [], str(error)
        return one.end, [one], ""
    raw, end, damage = _unpacked(data, at)
    found, place, why = [], 0, damage or ("" if raw else "no version line")
    while place < len(raw):
        try:
            one = _parsed(raw, place)
        except ValueError as error:
            why = why or str(error)
            mark = _FIRST_LINE.search(raw, place + 1)
            place = mark.start() if mark else len(raw)
            continue
        if not damage or (one.checked and one.end < len(raw)):
            found.append(one)
        place = one.end
    return at if damage else end, found, why


def salvage(data: bytes) -> Iterator[Found]:
    """All valid records of an archive in order, and the gaps between them."""
    at, lost, reason = 0, -1, ""
    while at < len(data):
        end, found, why = _at(data, at)
        if lost >= 0 and (found or end > at):
            yield Found(lost, at - lost, None, {}, b"", reason)
            lost = -1
        for x in found:
            yield Found(at, end - at, x.kind, x.headers, x.block, None)
        if end > at:
            if why:
                yield Found(at, end - at, None, {}, b"", why)
            at = end
            continue
        if lost < 0:
            lost, reason = at, why
        mark = _MARK.search(data, at + 1)
        at = mark.start() if mark else len(data)
    if lost >= 0:
        yield Found(lost, len(data) - lost, None, {}, b"", reason)


def _urn(value: str) -> str | None:
    inner = value.removeprefix("<urn:page:").removesuffix(">")
    return None if inner in ("", "none") else inner


def read(spark: SparkSession, paths: list[str] | str, keep_payload: bool = True) -> DataFrame:
    """All records and gaps (record_type null, reason set) of the archives in these files or folders."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for x in salvage(data.as_py()):
                    h, payload = x.headers, payload_of(x.headers, x.block)
                    length = h.get("x-payload-length", "")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or (base32_sha1(payload) if x.kind else None)
                    rows.append((
                        path.as_py(), x.offset, x.n_bytes, x.kind, _urn(h.get("warc-record-id", "")), h.get("warc-target-uri"), _urn(h.get("warc-refers-to", "")),
                        int(length) if length.isdigit() else len(payload), digest, payload if keep_payload and x.kind else None, x.reason,
                    ))
                    size += len(x.block)
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return mapped(files.select("path", "content"), run, RECORDS)


_KINDS = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return records.filter("record_type IS NULL").select("archive", "offset", "n_bytes", "reason")


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: null for a response, else the page that it repeats.
    Payloads under least bytes are never folded."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    digest: Column = F.unhex(F.sha1("payload"))
    narrow = rows.select("page_id", digest.alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least)
    heads = narrow.groupBy("digest", "n").agg(F.min("page_id").alias("head"), F.count("*").alias("size")).filter("size > 1 AND head IS NOT NULL").select("digest", "n", "head")
    again = written(narrow.join(heads, ["digest", "n"]).filter(F.coalesce(F.col("page_id") > F.col("head"), F.lit(True))).select("page_id", "digest", "head").distinct(), "revisits")
    if again.isEmpty():
        return rows.withColumn("refers_to", F.lit(None).cast("long"))
    rows = rows.withColumn("_digest", digest)
    at = rows["page_id"].eqNullSafe(again["page_id"]) & (rows["_digest"] == again["digest"])
    return rows.join(again, at, "left").select(rows["page_id"], "url", "payload", F.col("head").alias("refers_to"))


def write(plan: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Writes the planned records into archives; returns the table of the valid ones: path, n_records, n_bytes."""

    def run(batches):
        store, base = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        sink, name, n, size = None, "", 0, 0

        def done():
            sink.close()
            return pa.record_batch([pa.array([name]), pa.array([n]), pa.array([size])], names=["name", "n_records", "n_bytes"])

        for batch in batches:
            for page, url, payload, head in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                raw, page, head = payload.as_py(), page.as_py(), head.as_py()
                text = record("response" if head is None else "revisit", "none" if page is None else str(page), url.as_py(), raw, base32_sha1(raw), None if head is None else str(head))
                if sink is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(posixpath.join(base, name), compression=None)
                packed = member(text)
                sink.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= archive:
                    yield done()
                    sink = None
        if sink is not None:
            yield done()

    names = written(mapped(plan, run, "name string, n_records long, n_bytes long"), "archives")
    return names.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"), "n_records", "n_bytes")


def written_and_read(pages: DataFrame, folder: str | None = None, least: int = 0, keep_payload: bool = True) -> DataFrame:
    """The records of all pages as the archives give them back."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    table = write(planned(pages, least), folder)
    if table.isEmpty():
        return spark.createDataFrame([], RECORDS)
    got = read(spark, folder, keep_payload)
    valid = table.select(F.element_at(F.split("path", "/"), -1).alias("_name"))
    return got.join(valid, F.element_at(F.split("archive", "/"), -1) == F.col("_name"), "left_semi")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = written_and_read(pages, keep_payload=False).filter("record_type IS NOT NULL")
    return rows.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
