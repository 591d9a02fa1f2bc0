"""WARC archives: records written per row, and a salvage reader that goes on after damage."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.operators.skew import join_groups
from sensorlake.scratch import stored

#: Payloads from this size on are written once.
MIN_REVISIT = 1000
#: Bytes of a file that the writer aims at, by the mean size of a record.
FILE_BYTES = 64 << 20
#: Files up to this size come through Spark, larger ones are streamed by the tasks.
WHOLE_FILE = 128 << 20
#: Bytes that are read at once in search of a record and in streams.
STEP = 1 << 20
#: A record's header ends within so many bytes.
MAX_HEADER = 1 << 20

#: Format (fixed values).
VERSION, MEMBER = b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FOUND = ("file string, offset long, length long, gap string, record_id string, record_type string, target_uri string, refers_to string, "
         "payload_digest string, payload_bytes long, payload binary")


# Writing


def with_originals(rows: DataFrame, id_col: str, payload: Column, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """rows with p_payload, p_digest, p_bytes and p_original: for payloads of at least min_bytes that several rows hold, the
    largest id of those rows, else null.

    Only digests are grouped and joined; the few groups with more than one row are matched by join_groups, so one payload
    may be that of most rows.
    """
    told = rows.withColumn("p_payload", F.coalesce(payload, F.lit("").cast("binary")))
    told = told.withColumns({"p_digest": F.sha1("p_payload"), "p_bytes": F.octet_length("p_payload").cast("long"), "p_hash": F.xxhash64("p_payload")})
    key = ["p_digest", "p_bytes", "p_hash"]
    groups = told.where(F.col("p_bytes") >= min_bytes).groupBy(key).agg(F.max(id_col).alias("p_original"), F.count("*").alias("p_rows"))
    groups = stored(groups.where("p_rows > 1 AND p_original IS NOT NULL"), "payload-groups")
    if groups.isEmpty():
        return told.withColumn("p_original", F.lit(None).cast(rows.schema[id_col].dataType))
    return join_groups(told, groups, key, "p_rows", "left")


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def record_id(id_column: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), id_column.cast("string"), F.lit(">"))


def _uri(url: Column) -> Column:
    """url without what would end a header line or word."""
    safe = url
    for code in [*range(0x21), 0x7F]:
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), safe).otherwise(url)


def write_archives(rows: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, date: str = "1970-01-01T00:00:00Z",
                   min_bytes: int = MIN_REVISIT) -> None:
    """Writes a WARC/1.1 record per row to files in the folder path.

    The payload (a string in UTF-8, or bytes; null: empty) is the body of an HTTP response.  Of rows with equal payloads of
    at least min_bytes, those of the largest id are `response`, the others `revisit`: the header of that response alone,
    with its id.  Digests are SHA-1 in lower-case hex.  Rows of one id and payload are alike, so repeated rows repeat
    records.  Null ids and urls leave their header line out.  Control characters and blanks of urls are percent-encoded.
    Spark's text writer puts the bytes down (every record ends with a line feed), so its commit protocol holds.  A column
    named like p_payload, p_digest, p_bytes, p_hash or p_original does not matter: only the three named ones are read.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("body"))
    told = with_originals(named, "id", F.col("body"), min_bytes)
    revisit = F.col("p_original").isNotNull() & ~F.col("id").eqNullSafe(F.col("p_original"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("p_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("p_payload")))
    told = told.select("*", block.alias("block"), revisit.alias("revisit"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), F.lit("\r\n"),
        _line("WARC-Record-ID", record_id(F.col("id"))), F.lit(f"WARC-Date: {date}\r\n"), _line("WARC-Target-URI", _uri(F.col("url"))),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("p_original")), F.lit("\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("p_digest"), F.lit("\r\nWARC-Block-Digest: sha1:"), F.sha1("block"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(head.cast("binary"), F.col("block"), F.lit("\r\n\r").cast("binary"))
    size = told.agg(F.avg("p_bytes")).first()[0] or 0
    told.select(record.cast("string").alias("value")).write.option("lineSep", "\n").option(
        "maxRecordsPerFile", max(1, int(FILE_BYTES // (size + 600)))).text(path)


# Reading


class _Refused(Exception):
    """A record that fails a check; end: where the next one begins if the frame of this one holds, else None."""

    def __init__(self, why: str, end: int | None = None):
        super().__init__(why)
        self.end = end


class _Source:
    """Bytes of a seekable file by their offset."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))

    def header(self, at: int) -> bytes:
        """What stands before the first empty line."""
        got, n = b"", 4096
        while b"\r\n\r\n" not in got and n <= MAX_HEADER:
            got, n = self.read(at, n), 4 * n
        return got.partition(b"\r\n\r\n")[0] if b"\r\n\r\n" in got else b""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d", lines[0]):
        raise _Refused("no version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise _Refused("a header line without a name")
        name = name.strip().lower()
        if name in fields and name != "warc-concurrent-to":  # also what a header that was cut off inside looks like
            raise _Refused("a header field twice")
        fields[name] = value.strip()
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise _Refused("no length")
    return fields


def _checked(fields: dict[str, str], block: bytes, end: int, payload: bool) -> dict:
    """The row of a record whose frame holds, if its digests do."""

    def proven(name: str, data: bytes) -> str | None:
        if not fields.get(name, "").lower().startswith("sha1:"):
            return None
        digest, own = fields[name][5:], hashlib.sha1(data)
        if digest.lower() != own.hexdigest() and digest.upper() != base64.b32encode(own.digest()).decode():
            raise _Refused(f"{name} differs", end)
        return own.hexdigest()

    proven("warc-block-digest", block)
    body, told, size = block, None, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", head)
    if fields.get("warc-type") == "revisit":
        digest, size = fields.get("warc-payload-digest", "").partition(":")[2].lower() or None, int(told[1]) if told else None
    else:
        digest, size = proven("warc-payload-digest", body) or hashlib.sha1(body).hexdigest(), len(body)
    return {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": body if payload else None}


def _plain(source: _Source, at: int, payload: bool) -> tuple[dict, int]:
    head = source.header(at)
    if not head:
        raise _Refused("no end of the header")
    fields = _fields(head)
    start = at + len(head) + 4
    end = start + int(fields["content-length"])
    if end + 4 > source.size or source.read(end, 4) != b"\r\n\r\n":
        raise _Refused("the length does not lead to the end of a record")
    end += 4
    following = source.read(end, len(VERSION))
    framed = end if end == source.size or following == VERSION or following.startswith(MEMBER) else None
    try:
        return _checked(fields, source.read(start, end - 4 - start), end, payload), end
    except _Refused as refused:
        raise _Refused(str(refused), framed) from None


def _member(source: _Source, at: int, payload: bool) -> tuple[dict, int]:
    unpack, parts, end = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            data = source.read(end, STEP)
            if not data:
                raise _Refused("the member is cut short")
            parts.append(unpack.decompress(data))
            end += len(data)
    except zlib.error as error:
        raise _Refused(f"the member is damaged: {error}") from None
    end -= len(unpack.unused_data)
    data = b"".join(parts)
    inner = _Source(io.BytesIO(data), len(data))
    try:
        row, used = _plain(inner, 0, payload)
    except _Refused as refused:  # the checksum of the member holds, so its frame does
        raise _Refused(str(refused), end) from None
    if used != len(data):
        raise _Refused("more than a record in a member", end)
    return row, end


def _record(source: _Source, at: int, payload: bool) -> tuple[dict, int]:
    return (_member if source.read(at, 3) == MEMBER else _plain)(source, at, payload)


def _next_start(source: _Source, at: int) -> int:
    """The first place from at on where a member or a version line may begin, else the size."""
    while at < source.size:
        data = source.read(at, STEP + 8)
        found = [i for i in (data.find(VERSION), data.find(MEMBER)) if 0 <= i < STEP]
        if found:
            return at + min(found)
        at += STEP
    return source.size


def salvage(file, size: int, payload: bool = True) -> Iterator[dict]:
    """Records and gaps of an archive in order, each with offset and length; together they cover it without overlap.

    A record is a plain one or a gzip member with one.  It counts if its header can be read, its length leads to the end of
    a record and the checksums and SHA-1 digests that it carries hold.  After a failed check the reader goes on at the end
    of that record if its frame holds and a record or the end follows; else it searches for the next member or version
    line that begins a record which passes.  What lies between is a gap, with the first reason.
    """
    source, at = _Source(file, size), 0
    while at < size:
        start, why = at, None
        while at < size:
            try:
                row, end = _record(source, at, payload)
                break
            except _Refused as refused:
                why = why or str(refused)
                at = refused.end or _next_start(source, at + 1)
        if at > start:
            yield {"offset": start, "length": at - start, "gap": why}
        if at < size:
            yield {"offset": at, "length": end - at, "gap": None, **row}
            at = end


def read_archives(spark: SparkSession, path: str, pattern: str = "*", payload: bool = True) -> DataFrame:
    """Rows FOUND of all files of a folder whose names match pattern: a row per record, and a row with `gap` (why) per
    quarantined range of bytes, whose other columns are null.

    Files of up to WHOLE_FILE bytes come as rows of Spark's binary source, so they may lie in any store that Spark reads;
    larger ones are opened by the tasks through pyarrow's file systems and streamed, so a task holds one record.  Each file
    is read by one task, as records have no index.  An empty file gives no rows.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in FOUND.split(", "))])
        for batch in batches:
            for i in range(batch.num_rows):
                name, size, content = (batch.column(c)[i] for c in range(3))
                name, size = name.as_py(), size.as_py()
                file = pa.BufferReader(content.as_buffer()) if content.is_valid else _opened(name)
                out, held = [], 0
                for row in salvage(file, size, payload):
                    out.append({"file": name, **row})
                    held += len(row.get("payload") or b"") + 500
                    if held > STEP * 8:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    small = listed.where(F.col("length") <= WHOLE_FILE).select("path", "length", "content").mapInArrow(run, FOUND)
    if listed.where(F.col("length") > WHOLE_FILE).select("path").isEmpty():
        return small
    large = listed.where(F.col("length") > WHOLE_FILE).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large.repartition(F.col("path")).mapInArrow(run, FOUND))


def _opened(uri: str):
    system, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return system.open_input_file(name)
