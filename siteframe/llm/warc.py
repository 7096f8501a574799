"""WARC archives: a writer and a salvage reader.

The writer makes a gzip member for each record. Archives are runs of members of about `archive_bytes`; each
is one row of a text table in the shared folder, with one row for a file and, for the line separator, an empty gzip
member, which marks the end of the file. Spark's own committer writes them, on any file system and across lost executors.

Of records with equal payloads one is a response and the others are revisits that refer to it and carry its HTTP
header without the payload.

The reader takes an archive member by member. Where a check fails (header, version line, lengths, checksum of
the member, digests) it looks for the next place where a whole valid member, or in plain archives a version
line, begins, goes on there, and reports the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from siteframe.core import shared_folder
from siteframe.llm.common import CHUNK_BYTES, prepare, small_side

ARCHIVE_BYTES = 8 << 20
LEVEL = 1
#: Fixed values of the formats: an empty gzip member, the start of any member, the version line, the date of all records.
EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1\r\n"
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields that a record may hold more than once.
REPEATED = frozenset(("warc-concurrent-to",))
#: Longest header of a record or an HTTP message, longest name or comment of a member, input handed to inflate at once.
HEADER_BYTES, NAME_BYTES, PIECE_BYTES = 1 << 20, 1024, 1 << 16
_VERSION = re.compile(rb"WARC/[0-9]\.[0-9]{1,2}\r\n")
_START = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/[0-9]\.[0-9]{1,2}\r\n")
_CHUNK = re.compile(rb"[0-9A-Fa-f]{1,15}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value keeps to its line."""
    return " ".join(value.split())


def record_uri(record_id: int | None) -> str:
    return f"<urn:page:{'' if record_id is None else record_id}>"


def pack(record_id: int | None, uri: str, payload: bytes, refers_to: int | None, compress: bool = True) -> bytes:
    """One record, as a gzip member or plain."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_uri(record_id)), ("WARC-Date", DATE),
            ("WARC-Target-URI", _clean(uri)), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if refers_to is not None:
        head[2:2] = [("WARC-Refers-To", record_uri(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    raw = VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Damaged(ValueError):
    """A record that fails a check."""


def _header(data: bytes, start: int, once: bool) -> tuple[dict[str, str], int]:
    """Fields of the header lines at `start`, and where the block after the empty line begins.

    Lines are read one by one, so that a false start ends at its first bad line. Repeated fields keep their first value;
    with `once` only fields that may repeat in a record do.
    """
    out: dict[str, str] = {}
    key, at = "", start
    while True:
        end = data.find(b"\r\n", at, start + HEADER_BYTES)
        if end < 0:
            raise Damaged("header does not end")
        if end == at:
            return out, end + 2
        line = data[at:end]
        at = end + 2
        if line[:1] in b" \t" and key:  # a folded line
            out[key] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        key = name.strip().lower().decode("utf-8", "replace")
        if key in out:
            if once and key not in REPEATED:
                raise Damaged("header repeats a field, as where another record begins inside it")
            key = ""
        else:
            out[key] = value.strip().decode("utf-8", "replace")


def _number(value: str | None) -> int:
    if value is None or not (value.isascii() and value.isdigit()):
        raise Damaged("length is no number")
    return int(value)


def _same(label: str | None, data: bytes) -> bool | None:
    """Whether data has a labelled digest; nothing if there is no digest of a known kind."""
    kind, _, value = (label or "").partition(":")
    if kind.strip().lower() not in ("sha1", "sha-1"):
        return None
    return value.strip().upper() == digest(data) or value.strip().lower() == hashlib.sha1(data).hexdigest()


def _dechunked(body: bytes) -> bytes | None:
    """The body without the lengths of its chunks; nothing if it is not made of chunks."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + HEADER_BYTES)
        size = body[at:end].partition(b";")[0].strip() if end > at else b""
        if not _CHUNK.fullmatch(size):
            return None
        length = int(size, 16)
        if not length:
            return b"".join(parts)
        at = end + 2 + length
        if body[at:at + 2] != b"\r\n":
            return None
        parts.append(body[at - length:at])
        at += 2


def parse(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at `start` of plain bytes and where it ends; raises Damaged if a check fails.

    Records of any version and type count. HTTP fields may repeat; the HTTP length, the digests and for chunked bodies
    a digest over either form of the body may be missing. What is there has to be right, but for the HTTP length of a record whose
    digests tell that it is whole (a body that was cut or unpacked).
    """
    version = _VERSION.match(data, start)
    if not version:
        raise Damaged("no version line")
    head, begin = _header(data, version.end(), True)
    end = begin + _number(head.get("content-length"))
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block, kind, label = data[begin:end], head.get("warc-type"), head.get("warc-payload-digest")
    whole = _same(head.get("warc-block-digest"), block)
    if whole is False:
        raise Damaged("block digest differs")
    payload: bytes | None = None if kind == "revisit" else block
    size: int | None = None if kind == "revisit" else len(block)
    if kind in ("response", "request", "revisit") and (block.startswith(b"HTTP/") or head.get("content-type", "").lower().startswith("application/http")):
        line = block.find(b"\r\n")
        if line < 0 and block:
            raise Damaged("HTTP header does not end")
        fields, body = _header(block, line + 2, False) if block else ({}, 0)
        told = fields.get("content-length")
        if kind == "revisit":
            size = _number(told) if told is not None else None
        else:
            payload = block[body:]
            plain = _dechunked(payload) if "chunked" in fields.get("transfer-encoding", "").lower() else None
            same = _same(label, payload)
            if same is False and plain is not None:
                same = _same(label, plain)
            if same is False or (plain is None and told is not None and not (whole or same) and _number(told) != len(payload)):
                raise Damaged("payload differs from its digest or length")
            payload = payload if plain is None else plain
            size = len(payload)
    elif payload is not None and _same(label, payload) is False:
        raise Damaged("payload differs from its digest or length")
    sha = (label or "").partition(":")[2] if payload is None else digest(payload)
    return {"record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"), "record_type": kind, "payload_digest": sha or None,
            "payload_bytes": size, "refers_to": head.get("warc-refers-to"), "payload": payload}, end + 4


def _member(data: bytes, start: int) -> tuple[bytes, int]:
    """The content of the gzip member at `start` and where it ends. Input goes in by growing pieces, so that little of what follows is copied."""
    flags, at = data[start + 3:start + 4], start + 10
    if not flags or flags[0] & 0xE0:
        raise Damaged("gzip: header")
    if flags[0] & 4:
        at += 2 + int.from_bytes(data[at:at + 2], "little")
    for bit in (8, 16):  # name and comment end with a zero
        if flags[0] & bit:
            at = data.find(b"\0", at, at + NAME_BYTES) + 1
            if not at:
                raise Damaged("gzip: header does not end")
    z, parts, at, piece = zlib.decompressobj(31), [], start, 256
    try:
        while not z.eof and at < len(data):
            parts.append(z.decompress(data[at:at + piece]))
            at, piece = at + piece, min(4 * piece, PIECE_BYTES)
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from e
    if not z.eof:
        raise Damaged("gzip member does not end")
    return b"".join(parts), min(at, len(data)) - len(z.unused_data)


def _records(data: bytes, start: int) -> tuple[list[dict], int]:
    """Records of the member (none if it is empty), or the plain record, at `start`, and where it ends."""
    if not data.startswith(MAGIC, start):
        found, end = parse(data, start)
        return [found], end
    raw, end = _member(data, start)
    out, used = [], 0
    while used < len(raw):
        found, used = parse(raw, used)
        out.append(found)
    return out, end


def salvage(data: bytes) -> Iterator[dict]:
    """Records in order, and between them the gaps: {"gap_at", "gap_bytes", "reason"}.

    Candidates for the end of a gap are found in one pass, and a false one fails after a bounded header, so that damage costs
    time in proportion to its length.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            found, end = _records(data, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            mark = _START.search(data, at + 1)
            at = mark.start() if mark else len(data)
            continue
        if gap is not None:
            yield {"gap_at": gap, "gap_bytes": at - gap, "reason": reason}
            gap = None
        for r in found:
            yield r | {"at": at}
        at = end
    if gap is not None:
        yield {"gap_at": gap, "gap_bytes": at - gap, "reason": reason}


def roles(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """(digest binary, page_id, refers_to) of the rows that revisit another: equal payloads refer to the largest id that has them."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), _sha(F.col(payload)).alias("sha"))
    most = rows.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = most.filter("n > 1 and least < refers_to").select("sha", "refers_to")
    return rows.join(groups, "sha").filter("page_id < refers_to").distinct()


def _sha(payload: Column) -> Column:
    return F.unhex(F.sha1(F.coalesce(payload.cast("binary"), F.lit(b""))))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", uri: str = "url", payload: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES, compress: bool = True) -> None:
    """Write a record for each row to archives below `path`.

    Null payloads are empty, null addresses as well. Rows with equal payloads: those with the largest id are
    responses (each of them, if rows repeat that id), the others revisit it; rows without id are responses.
    An empty table writes no archive. Payloads are not shuffled unless there are more revisits than fit a broadcast.
    """
    prepare(pages.sparkSession)
    revisits = small_side(roles(pages, page_id, payload)).select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), "refers_to")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("uri"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"), _sha(F.col(payload)).alias("sha"))
    placed = rows.join(revisits, (F.col("id") == F.col("__id")) & (F.col("sha") == F.col("__sha")), "left").select("id", "uri", "payload", "refers_to")

    # A string of raw bytes is written as it is. The separator is an empty member, in plain archives the last byte of the last record.
    separator, end = (EMPTY_MEMBER.decode("latin-1"), b"") if compress else ("\n", b"\n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def archive() -> pa.RecordBatch:
            raw = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([raw[:len(raw) - len(end)]], pa.binary())], names=["archive"])

        for batch in batches:
            for i in range(batch.num_rows):
                rid, address, body, refers = (batch.column(k)[i].as_py() for k in range(4))
                parts.append(pack(rid, address, body, refers, compress))
                held += len(parts[-1])
                if held >= archive_bytes:
                    yield archive()
                    parts, held = [], 0
        if parts:
            yield archive()

    (placed.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value")).write
     .option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", separator).text(path))


READ = StructType([StructField(n, StringType()) for n in ("archive", "record_id", "uri", "record_type", "payload_digest", "refers_to")]
                  + [StructField("payload_bytes", LongType()), StructField("payload", BinaryType()), StructField("at", LongType()),
                     StructField("gap_at", LongType()), StructField("gap_bytes", LongType()), StructField("reason", StringType())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below `path`; a row is a gap if gap_bytes is not null.

    Archives of others may hold records of any version and type, several to a member; the payload of a chunked response is that without
    the chunk lengths, and payload_digest is computed where the payload is there. A record without a payload (a revisit) has the
    digest that its header tells. An empty file has no rows.

    A file is read whole by one task, which the size of archives bounds; give `payloads=False` where payloads are only to be checked.
    """
    arrow = to_arrow_schema(READ)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                for r in salvage(batch.column(1)[i].as_py()):
                    held += len(r.get("payload") or b"") + 500
                    rows.append(r | {"archive": name} | ({} if payloads else {"payload": None}))
                    if held > CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, READ)


def page_number(uri: Column) -> Column:
    return F.regexp_extract(uri, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, folder: str | None = None, **names) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of `pages`, with the rows of gaps left out."""
    spark = pages.sparkSession
    path = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **names)
    records = read_archives(spark, path, payloads=False).filter("gap_bytes is null")
    return records.select(page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          page_number(F.col("refers_to")).alias("refers_to"))
