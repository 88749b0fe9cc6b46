"""Archives of other writers, broken records, dictionaries and revisits."""
import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from meshloom.llm import warc

CRLF = "\r\n"


def made(kind, name, block: bytes, *more: str) -> bytes:
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
    return CRLF.join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def foreign() -> list[bytes]:
    body = b"<p>hello</p>"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return [
        made("warcinfo", "a", b"software: x\r\n", "Content-Type: application/warc-fields"),
        made("response", "b", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body, "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://x/", f"warc-payload-digest: sha1:{sha1}"),
        made("request", "c", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        made("metadata", "d", b"", "X-Folded: one\r\n two"),
        made("revisit", "e", b"", "WARC-Profile: p", f"WARC-Payload-Digest: sha1:{sha1}"),
    ]


def test_records_of_other_writers_are_read():
    got = [warc.parse(r) for r in foreign()]
    assert [(g["record_type"], g["record_id"], g["id"], g["payload_bytes"]) for g in got] == [
        ("warcinfo", "<urn:uuid:a>", None, 13), ("response", "<urn:uuid:b>", None, 12), ("request", "<urn:uuid:c>", None, 0), ("metadata", "<urn:uuid:d>", None, 0), ("revisit", "<urn:uuid:e>", None, None)]
    assert got[1]["payload_digest"] == hashlib.sha256(b"<p>hello</p>").hexdigest()
    for bad in (foreign()[1].replace(b"hello", b"hallo"), foreign()[4].replace(b"WARC-Profile: p\r\n", b""), foreign()[0].replace(b"WARC-Date: ", b"Date: "), foreign()[0].replace(b"Content-Length: ", b"Content-Length: -")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad)


def test_broken_records_are_rows_and_the_rest_is_read(spark, tmp_path):
    records = [warc.record(i, "u", b"page %d " % i * 90, hashlib.sha256(b"page %d " % i * 90).hexdigest(), None) for i in range(40)]
    records[7] = records[7].replace(b"page 7", b"pagX 7", 1)
    good = bytearray(warc.pack([*records, *foreign()]))
    frames = [k for k in range(len(good)) if good[k : k + 4] == warc.FRAME]
    good[frames[20] + 12] ^= 0xFF
    (tmp_path / "a.warc.zst").write_bytes(good)
    (tmp_path / "b.warc.zst").write_bytes(b"no archive")
    got = warc.read_archives(spark, f"file://{tmp_path}", keep_errors=True).collect()
    errors = [r.error for r in got if r.error]
    assert len(errors) == 3 and any("digest" in e for e in errors)
    assert len({r.record_id for r in got if r.record_id}) == 43
    with pytest.raises(Exception, match="ArchiveError"):
        warc.read_archives(spark, f"file://{tmp_path}").count()


def test_one_dictionary_for_all_partitions_and_clashing_columns(spark, tmp_path):
    rows = [(i, "u", f"<html>page {i} of the same kind of pages, with words like {i * i}</html>".encode() * 3, "d", 1, i) for i in range(60)]
    rows += [(100, "u", b"x" * 20_000_000, "d", 1, 1), (101, "u", b"x" * 20_000_000, "d", 1, 1)]
    pages = spark.createDataFrame(rows, "id long, uri string, payload binary, digest string, first long, refers_to long").repartition(6)
    folder = warc.make_folder(f"file://{tmp_path}/w")
    marked = warc.mark_revisits(pages)
    warc.write_archives(marked, folder, 1 << 20).count()
    held = [p.read_bytes() for p in (tmp_path / "w").glob("*.warc.zst")]
    assert len(held) > 1 and {h[:4] for h in held} == {b"\x5d\x2a\x4d\x18"}
    assert len({h[: 8 + int.from_bytes(h[4:8], "little")] for h in held}) == 1  # the dictionary's frame
    got = {r.id: r for r in warc.resolve_revisits(warc.read_archives(spark, folder)).collect()}
    assert len(got) == 62 and got[101].refers_to == 100 and got[101].payload_bytes == 20_000_000 and got[101].error is None


def test_revisits_get_what_they_refer_to(spark):
    d = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"
    rows = [(1, 5, "a", "response", None, None), (2, 5, "a", "revisit", 1, None), (3, 9, "a", "revisit", 1, None), (4, 5, "b", "revisit", 1, None), (5, 5, "a", "revisit", 9, None), (6, None, None, "revisit", 1, None), (7, 1, "c", "response", None, "odd")]
    got = {r.id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, d)).collect()}
    assert [got[k].error is None for k in range(1, 8)] == [True, True, False, False, False, True, False]
    assert got[6].payload_digest == "a" and got[6].payload_bytes == 5 and got[7].payload_digest == "c"


def test_repeated_payloads_joined_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW", 0)
    pages = spark.range(30).select("id", F.lit("u").alias("uri"), F.repeat(F.lit("z"), 200 + (F.col("id") % 3).cast("int")).cast("binary").alias("payload"))
    assert {r.id: r.refers_to for r in warc.mark_revisits(pages).collect()} == {k: None if k < 3 else k % 3 for k in range(30)}
