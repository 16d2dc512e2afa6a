import gzip
import hashlib
import zlib

import pytest

from breezeline.llm import warc
from breezeline.session import scratch_path

KINDS = "page_id long, url string, html string, payload string, digest string, rank int, record string"


def pages(spark, data):
    return spark.createDataFrame([(*r, "p", "d", 1, "r") for r in data], KINDS).repartition(2)


def test_round_trip_with_revisits_and_odd_pages(spark):
    big, small = "é" * 600, "tiny"
    data = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "http://c", big), (4, "u", small), (5, "u", small)]
    data += [(6, "u", None), (7, "u", ""), (8, "u", "x\r\n\r\ny\0" * 300), (8, "u", "x\r\n\r\ny\0" * 300), (None, "u", big)]
    data += [(None, "u", "q" * 2000), (9, "u", "z" * (17 << 20))]
    path = scratch_path(spark, "warc-test")
    warc.write_archives(warc.with_revisits(pages(spark, data)), path, file_records=3)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(data) and all(r.problem is None for r in got)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == [
        (-1, "response", 0), (-1, "revisit", 3), (1, "revisit", 3), (2, "revisit", 3), (3, "response", 0),
        (4, "response", 0), (5, "response", 0), (6, "response", 0), (7, "response", 0), (8, "response", 0),
        (8, "response", 0), (9, "response", 0),
    ]
    texts = {}
    for i, _, html in data:
        texts.setdefault(i, set()).add((html or "").encode())
    for r in got:
        own = [t for t in texts[r.page_id] if hashlib.sha1(t).hexdigest() == r.payload_digest]
        assert len(own) == 1 and r.payload_bytes == len(own[0])
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == own[0]
    assert not [r for r in got if r.target_uri and "\n" in r.target_uri]


def test_one_member_per_record_that_gzip_reads(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(warc.with_revisits(pages(spark, [(i, "u", f"text {i}") for i in range(5)])), path)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    records = [m for f in files for m in warc.members(bytes(f.content))]
    assert len(records) == 5 and all(m.startswith(warc.VERSION) for m in records)
    assert b"".join(gzip.decompress(bytes(f.content)) for f in files) == b"".join(records)


def test_damage_is_told():
    good = warc.make_record(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    plain = zlib.decompress(good, 31)
    assert warc.parse(plain)["payload"] == b"payload"
    for bad in (plain.replace(b"payload", b"paXload"), plain[:-1], plain.replace(b"Content-Length: ", b"Content-Length: 1"), b"x"):
        with pytest.raises(warc.Damaged):
            warc.parse(bad)
    for bad in (good[:-9], good + good[:20], good[:15] + b"\xff\xff" + good[17:]):
        with pytest.raises(warc.Damaged):
            list(warc.members(bad))


def test_no_pages(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(warc.with_revisits(spark.createDataFrame([], KINDS)), path)
    assert warc.read_archives(spark, path).count() == 0


def block(kind, body, *fields, name="<urn:uuid:1>"):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *fields, f"Content-Length: {len(body)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


HTTP = "Content-Type: application/http; msgtype=response"
ANSWER = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"<p>hello</p>" * 20_000
PAYLOAD = ANSWER.partition(b"\r\n\r\n")[2]
HEX = hashlib.sha1(PAYLOAD).hexdigest()


def foreign():
    return [
        block("warcinfo", b"software: x\r\n\r\nformat: y", "Content-Type: application/warc-fields"),
        block("response", ANSWER, HTTP, f"WARC-Payload-Digest: SHA-1:{HEX.upper()}", name="<urn:uuid:2>"),
        block("response", ANSWER, HTTP, "WARC-Payload-Digest: sha256:" + hashlib.sha256(PAYLOAD).hexdigest()),
        block("response", ANSWER, HTTP),
        block("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", HTTP, "WARC-Refers-To: <urn:uuid:2>", f"WARC-Payload-Digest: sha1:{HEX}"),
        block("revisit", b"", "WARC-Refers-To: <urn:uuid:9>", f"WARC-Payload-Digest: sha1:{HEX}", "WARC-Profile: a\r\n b"),
        block("revisit", b"", f"WARC-Payload-Digest: sha1:{HEX}"),
        block("resource", b"", name="<urn:page:12x>"),
    ]


def damaged():
    return [
        (block("response", ANSWER, HTTP, "WARC-Payload-Digest: sha1:!!"), "a digest that cannot be read"),
        (block("response", ANSWER, HTTP, "WARC-Payload-Digest: crc:1"), "a digest of an unknown kind"),
        (block("response", ANSWER, HTTP, f"WARC-Block-Digest: sha1:{HEX}"), "wrong block digest"),
        (block("resource", b"x", f"WARC-Payload-Digest: sha1:{HEX}"), "wrong payload digest"),
    ]


def put(spark, files):
    path = scratch_path(spark, "warc-test")
    text = spark.createDataFrame([(bytearray(f),) for f in files], "value binary").selectExpr("CAST(value AS string) AS value")
    text.repartition(len(files)).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def test_foreign_archives(spark):
    good = foreign()
    packed = b"".join(gzip.compress(r) for r in good)  # a member per record
    one = gzip.compress(b"".join(good))  # all records in one member
    plain = b"".join(good)
    for with_payload in (True, False):
        got = warc.read_archives(spark, put(spark, [packed, one, plain]), with_payload).collect()
        assert len(got) == 3 * len(good) and not [r.problem for r in got if r.problem]
        for name in {r.path for r in got}:
            rows = [r for r in got if r.path == name]
            assert [r.record_type for r in rows] == ["warcinfo", *["response"] * 3, *["revisit"] * 3, "resource"]
            assert [r.payload_bytes for r in rows] == [24, *[len(PAYLOAD)] * 3, None, None, None, 0]
            assert [r.payload_digest for r in rows[1:7]] == [HEX] * 6
            assert all(r.page_id is None and r.refers_to is None for r in rows)
            assert [r.payload for r in rows[1:2]] == [PAYLOAD if with_payload else None]


def test_each_fault_is_one_row_and_reading_goes_on():
    good = foreign()[1]
    for bad, told in damaged():
        for file in (gzip.compress(bad) + gzip.compress(good), gzip.compress(bad + good), bad + good):
            first, second = warc.records(file)
            assert str(first) == told and second["payload"] == PAYLOAD
    short = good.replace(b"Content-Length: ", b"Content-Length: 9")
    for bad, told in [(short, "Content-Length does not fit"), (b"junk", "no WARC header"), (b"WARC/1.0\r\n\r\n", "no Content-Length")]:
        first, second = warc.records(gzip.compress(bad) + b"\0\0" + gzip.compress(good))
        assert str(first) == told and second["payload"] == PAYLOAD
    packed = gzip.compress(good)
    for cut in (11, 60, len(packed) - 20, len(packed) - 3):  # in the header, in the block, in the member's end
        found = list(warc.records(packed + packed[:cut]))
        assert found[0]["payload"] == PAYLOAD and isinstance(found[-1], warc.Damaged)
        assert len([x for x in found if isinstance(x, warc.Damaged)]) == 1
    broken = bytearray(packed)
    broken[40:60] = b"\xff" * 20
    assert [type(x).__name__ for x in warc.records(bytes(broken) + packed)] == ["_Unpackable"]
    assert [str(x) for x in warc.records(b"no archive at all")][0].startswith("a member cannot be inflated")
    assert not list(warc.records(b"")) and not list(warc.records(b"\0\0"))


def test_revisits_without_their_record(spark):
    read = warc.read_archives(spark, put(spark, [b"".join(foreign())]))
    assert [tuple(r) for r in warc.unresolved_revisits(read).collect()] == [("<urn:uuid:9>", HEX, 1)]
    only = warc.read_archives(spark, put(spark, [b"".join(foreign()[4:7])]))
    assert warc.unresolved_revisits(only).count() == 3


def test_files_are_cut_by_bytes(spark):
    path = scratch_path(spark, "warc-test")
    data = [(i, "u", "".join(chr(33 + (i * j * j + j) % 90) for j in range(3000))) for i in range(40)]
    made = warc.with_revisits(pages(spark, data)).coalesce(1)
    warc.write_archives(made, path, file_bytes=3000)
    sizes = [f.length for f in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) > 3 and max(sizes) < 3000 + 1000
    read = warc.read_archives(spark, path)
    assert read.filter("problem IS NULL").count() == 40 and warc.unresolved_revisits(read).count() == 0
