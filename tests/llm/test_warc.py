import base64
import gzip
import hashlib
import time

import odd
import pytest
from pyspark.sql import functions as F

from siteframe.llm import catalog, warc

PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "x\r\ny: z", ""), (5, "u", "WARC/1.1\r\n\r\n\x1f\u008b\x08 WARC/1.1\r\n"),
         (6, "v", "<p>one</p>"), (7, "w", "é" * 1000), (None, "n", "<p>one</p>"), (6, "v", "<p>one</p>")]


def pages(spark, rows=None):
    table = spark.createDataFrame(PAGES if rows is None else rows, "page_id long, url string, html string")
    return table.select("*", *[F.lit(1).alias(c) for c in ("payload", "archive", "sha", "refers_to", "uri", "id", "value", "at")])


def want(rows):
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = i is not None and i < last[html or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response",
                    last[html or ""] if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("archive_bytes", [1, 700, 1 << 20])
def test_round_trip(spark, tmp_path, compress, archive_bytes):
    path = str(tmp_path / "warc")
    table = pages(spark)
    got = warc.round_trip(table, path, compress=compress, archive_bytes=archive_bytes).collect()
    assert sorted(str(tuple(r)) for r in got) == want(PAGES)
    read = warc.read_archives(spark, path)
    assert read.filter("gap_bytes is not null").isEmpty()
    bodies = {r["record_id"]: bytes(r["payload"]).decode() for r in read.filter("payload is not null").collect()}
    assert bodies["<urn:page:5>"] == PAGES[4][2] and bodies["<urn:page:7>"] == "é" * 1000


def test_archives_are_plain_gzip(spark, tmp_path):
    path = tmp_path / "warc"
    warc.write_archives(pages(spark), str(path))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(path.iterdir()) if p.name.startswith("part"))
    assert raw.count(b"WARC-Type: response\r\n") == 6 and raw.count(b"WARC-Type: revisit\r\n") == 3


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    assert sorted(str(tuple(r)) for r in catalog.op4_warc(spark, folder).collect()) == want(rows)


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    packed = [warc.pack(i, f"http://{i}/", f"<p>{i}</p>".encode() * 50, None, compress) for i in range(6)]
    starts = [sum(map(len, packed[:i])) for i in range(7)]
    whole = b"".join(packed)
    assert [r["record_id"] for r in warc.salvage(whole)] == [f"<urn:page:{i}>" for i in range(6)]

    def ids_and_gaps(data):
        found = list(warc.salvage(data))
        return [r["record_id"] for r in found if "record_id" in r], [(r["gap_at"], r["gap_bytes"]) for r in found if "gap_at" in r]

    broken = bytearray(whole)
    broken[starts[2] + len(packed[2]) - 10] ^= 255  # checksum of a member, or payload
    assert ids_and_gaps(bytes(broken)) == ([f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)], [(starts[2], len(packed[2]))])
    lost = whole[:starts[1] + 30] + whole[starts[4]:]  # a piece is missing
    assert ids_and_gaps(lost) == ([f"<urn:page:{i}>" for i in (0, 4, 5)], [(starts[1], 30)])
    cut = whole[:starts[5] + 40]
    assert ids_and_gaps(cut) == ([f"<urn:page:{i}>" for i in range(5)], [(starts[5], 40)])
    noise = b"noise\r\n" + whole[:starts[2]] + b"\x00" * 9 + whole[starts[2]:] + b"tail"
    ids, gaps = ids_and_gaps(noise)
    assert ids == [f"<urn:page:{i}>" for i in range(6)] and [n for _, n in gaps] == [7, 9, 4]
    assert list(warc.salvage(b"")) == [] and ids_and_gaps(b"nothing at all") == ([], [(0, 14)])


def test_false_starts_inside_payloads():
    body = warc.pack(9, "inner", b"inner", None, False) + b"WARC/1.1\r\n" * 5
    packed = [warc.pack(1, "a", body, None, False), warc.pack(2, "b", b"two", None, False)]
    assert [r["record_id"] for r in warc.salvage(b"".join(packed))] == ["<urn:page:1>", "<urn:page:2>"]


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(pages(spark).filter("false"), str(tmp_path / "none")).isEmpty()


def foreign(fields, block, version="1.0"):
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"WARC/{version}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def response(i, http, body, *more):
    return foreign([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{i}>"), ("Content-Type", "application/http; msgtype=response"), *more],
                   ("HTTP/1.1 200 OK\r\n" + "".join(f"{x}\r\n" for x in http) + "\r\n").encode() + body)


def test_foreign_records():
    chunked = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    info = foreign([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x:0>"), ("WARC-Concurrent-To", "a"), ("WARC-Concurrent-To", "b")], b"software: a\r\n")
    records = [info, response(1, ["Set-Cookie: a", "Set-Cookie: b", "Content-Length: 3"], b"one"), response(2, ["Transfer-Encoding: chunked"], chunked),
               response(3, [], b"no length"), response(4, ["X: a,", " b"], b"", ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(b"").hexdigest())),
               response(5, [], b"changed", ("WARC-Payload-Digest", "sha1:" + warc.digest(b"before"))),
               response(6, ["Content-Length: 9"], b"cut"), response(7, ["Content-Length: 9"], b"cut", ("WARC-Payload-Digest", "sha1:" + warc.digest(b"cut"))),
               foreign([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:x:8>"), ("WARC-Refers-To", "<urn:x:1>")], b"", "1.1"),
               foreign([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x:9>")], b"", "1.1")]
    want = [("<urn:x:0>", b"software: a\r\n"), ("<urn:x:1>", b"one"), ("<urn:x:2>", b"hello world"), ("<urn:x:3>", b"no length"), ("<urn:x:4>", b""),
            ("<urn:x:7>", b"cut"), ("<urn:x:8>", None), ("<urn:x:9>", b"")]
    gap = sum(len(records[i]) for i in (5, 6))
    plain = b"".join(records)
    packed = b"".join(gzip.compress(r) for r in records)
    for data, gaps in ((plain, [gap]), (packed, [len(gzip.compress(records[5])) + len(gzip.compress(records[6]))])):
        found = list(warc.salvage(data))
        assert [(r["record_id"], r["payload"]) for r in found if "gap_at" not in r] == want
        assert [r["gap_bytes"] for r in found if "gap_at" in r] == gaps
    whole = gzip.compress(b"".join(r for i, r in enumerate(records) if i not in (5, 6)))  # one member for all records
    assert [(r["record_id"], r["payload"]) for r in warc.salvage(whole)] == want
    revisit = next(r for r in warc.salvage(plain) if r.get("record_type") == "revisit")
    assert revisit["refers_to"] == "<urn:x:1>" and revisit["payload_bytes"] is None


@pytest.mark.parametrize("start", [b"\x1f\x8b\x08", b"\x1f\x8b\x08\x08name", b"WARC/1.1\r\n", b"WARC/1.1\r\na: b\r\n"])
def test_false_starts_take_linear_time(start):
    began = time.time()
    good = warc.pack(1, "a", b"one", None)
    found = list(warc.salvage(start * ((1 << 20) // len(start)) + b"\0\0" + good))
    assert [r["record_id"] for r in found if "record_id" in r] == ["<urn:page:1>"] and len(found) == 2
    assert time.time() - began < 10


def test_clashing_columns(spark, tmp_path):
    table = odd.docs(spark).withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))
    assert set(odd.CLASHING) <= set(table.columns)
    got = warc.round_trip(table, str(tmp_path / "odd"))
    assert got.count() == len(odd.DOCS) and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
