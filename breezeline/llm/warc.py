"""WARC archives: one gzip member per record, written by Spark's own file writer, and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeline.llm.common import NULL_ID, id_in, id_out, ship

ship(__name__)

# Fixed values of the format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_FIRST, _PIECE = 1 << 12, 1 << 16
_DIGESTS = ("md5", "sha1", "sha256", "sha384", "sha512")
_ID = "urn:page:"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int) -> str:
    return f"<{_ID}{'null' if page_id == NULL_ID else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    if record_id is None:
        return None
    own = record_id.strip("<>")
    if own == _ID + "null":
        return NULL_ID
    digits = own.removeprefix(_ID).removeprefix("-")
    if not own.startswith(_ID) or not (digits.isascii() and digits.isdigit()) or len(digits) > 19:
        return None
    value = int(own.removeprefix(_ID))
    return value if -(2**63) <= value < NULL_ID else None


def make_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the response's HTTP header, with the payload's length, without
    the payload itself."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else _record_id(page_id)[1:-1]),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", _sha1(block)),
        ("WARC-Payload-Digest", _sha1(payload)),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", SAME_PAYLOAD)]
    fields.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + _END) + packer.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, refers_to: of pages with equal payloads of at least ``least_bytes`` bytes the one with
    the largest page_id is the response (null if it refers to none), the others refer to it.

    Equality is found on digests, so payloads are shuffled once, by page, and never by a payload that very many pages
    share. Rows that share page_id and payload are all treated alike; a null page_id is smaller than any other."""
    named = pages.select(
        id_in("page_id").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rank = F.when(F.col("page_id") == NULL_ID, F.lit(None)).otherwise(F.col("page_id"))
    keyed = named.select("*", F.sha2("payload", 256).alias("digest"))
    large = keyed.filter(F.octet_length("payload") >= least_bytes).select("page_id", "digest", rank.alias("rank"))
    first = large.groupBy("digest").agg(F.max("rank").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    again = large.join(first, "digest").filter("rank IS NULL OR rank < refers_to").filter("refers_to IS NOT NULL")
    marks = again.groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"))
    return keyed.join(marks, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")


def write_archives(
    pages: DataFrame,
    path: str,
    date: str = "1970-01-01T00:00:00Z",
    file_records: int = 20_000,
    file_bytes: int = 64 << 20,
) -> None:
    """Write (page_id, url, payload, refers_to) rows as archives below ``path``, one gzip member per record.

    A task begins a new part (a folder ``part=N``) when a file has ``file_bytes`` bytes, so a file is larger by one
    record at most, and a new file after ``file_records`` records.

    The text writer commits whole tasks, so a lost executor leaves no half-written archive and any file system of
    Spark's will do. It ends every row with one zero byte. A gzip member ends with its size, whose last byte is zero
    below 16 MiB: there the writer's byte takes its place. After larger members it is padding, which readers skip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers = (batch.column(k)[i].as_py() for k in range(4))
                record = make_record(page_id, url, payload, refers, date)
                record = record[:-1] if record[-1] == 0 else record
                if size >= file_bytes:
                    part, size = part + 1, 0
                size += len(record) + 1
                arrays = [pa.array([part], pa.int32()), pa.array([record], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "record"])

    rows = pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "part int, record binary")
    text = rows.select("part", F.col("record").cast("string").alias("value"))
    text.write.partitionBy("part").option("lineSep", "\0").option("maxRecordsPerFile", file_records).text(path)


class Damaged(ValueError):
    """A record whose bytes do not keep to the format or to its digests."""


class _Unframed(Damaged):
    """The end of a record is unknown."""


class _Unpackable(Damaged):
    """A member cannot be inflated, so the rest of its file cannot be found."""


class _Members:
    """The bytes of an archive, inflated in bounded steps, one gzip member at a time. Zero bytes between members and at
    the end are skipped; bytes that are not packed are one plain member up to the end of the file."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.at = memoryview(data), 0
        self.unpack, self.plain, self.step = None, False, _FIRST
        self.ready = bytearray()

    def next_member(self) -> bool:
        while self.at < len(self.data) and self.data[self.at] == 0:
            self.at += 1
        self.ready.clear()
        self.plain = self.data[self.at : self.at + 5] == b"WARC/"
        while self.plain and self.data[-1] == 0:
            self.data = self.data[:-1]
        self.unpack, self.step = None if self.plain else zlib.decompressobj(31), _FIRST
        return self.at < len(self.data)

    def piece(self) -> bytes:
        """The next bytes of the member, none at its end."""
        while True:
            taken = self.data[self.at : self.at + self.step]
            self.step = min(2 * self.step, _PIECE)
            if self.plain:
                self.at += len(taken)
                return bytes(taken)
            if self.unpack.eof:
                return b""
            try:
                out = self.unpack.decompress(taken, _PIECE)
            except zlib.error as problem:
                raise _Unpackable(f"a member cannot be inflated: {problem}") from None
            rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            self.at += len(taken) - len(rest)
            if out:
                return out
            if not taken and not self.unpack.eof:
                raise _Unpackable("a member ends too early")

    def more(self) -> bool:
        """Whether the member has bytes left."""
        if not self.ready:
            self.ready += self.piece()
        return bool(self.ready)

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the mark, which is passed; none if the member has no such mark."""
        seen = 0
        while (cut := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            piece = self.piece()
            if not piece:
                return None
            self.ready += piece
        found = bytes(self.ready[:cut])
        del self.ready[: cut + len(mark)]
        return found

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, piece by piece."""
        while size:
            if not self.more():
                raise _Unframed("Content-Length does not fit")
            out = bytes(self.ready[:size])
            del self.ready[: len(out)]
            size -= len(out)
            yield out


def members(data: bytes) -> Iterator[bytes]:
    """The contents of the members one after another."""
    source = _Members(data)
    while source.next_member():
        yield b"".join(iter(source.piece, b""))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise _Unframed("no WARC header")
    fields, name = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:  # a long value goes on
            fields[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


class _Digest:
    """A digest field (``algorithm:value`` in hex or base 32, without padding or with it) and the bytes it is of."""

    def __init__(self, field: str | None):
        self.wanted, kind = None, "sha1"
        if field is not None:
            kind, _, value = field.partition(":")
            kind = kind.strip().lower().replace("-", "")
            if kind not in _DIGESTS:
                raise Damaged("a digest of an unknown kind")
            self.wanted = self._bytes(value.strip().rstrip("="), hashlib.new(kind).digest_size)
        self.kind, self.sum = kind, hashlib.new(kind)

    @staticmethod
    def _bytes(value: str, size: int) -> bytes:
        try:
            found = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
        except ValueError:
            found = b""
        if len(found) != size:
            raise Damaged("a digest that cannot be read")
        return found


def _record(source: _Members, with_payload: bool) -> dict:
    """The next record of the member, read in steps: header fields, ``size`` and ``sha1`` (of the full payload, null
    where a revisit does not say), ``payload`` (null unless asked for, empty for a revisit).

    The payload is what follows the HTTP header where Content-Type is application/http, else the block. Content-Length
    frames the block; digests are held against the bytes, the payload's not in a revisit, which has none."""
    head = source.until(_END)
    if head is None:
        raise _Unframed("no WARC header")
    fields = _fields(head)
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise _Unframed("no Content-Length")
    http = bytearray() if fields.get("content-type", "").lower().startswith("application/http") else None
    again = fields.get("warc-type") == "revisit"
    faults, block, payload = [], None, None
    try:
        block, payload = _Digest(fields.get("warc-block-digest")), _Digest(fields.get("warc-payload-digest"))
    except Damaged as problem:
        faults.append(problem)
    sha1, size, kept, header = hashlib.sha1(), 0, [], None
    for piece in source.take(int(length)):
        if not faults:
            block.sum.update(piece)
        if http is not None and header is None:
            seen = max(0, len(http) - len(_END) + 1)
            http += piece
            cut = http.find(_END, seen)
            if cut < 0:
                continue
            header, piece = bytes(http[:cut]), bytes(http[cut + len(_END) :])
        if again:
            continue
        sha1.update(piece)
        size += len(piece)
        if not faults and payload.kind != "sha1":
            payload.sum.update(piece)
        if with_payload:
            kept.append(piece)
    if b"".join(source.take(len(_END))) != _END:
        raise _Unframed("Content-Length does not fit")
    if faults:
        raise faults[0]
    if block.wanted not in (None, block.sum.digest()):
        raise Damaged("wrong block digest")
    digest = sha1.hexdigest()
    if again:
        lines = bytes(http or b"").split(_END)[0].split(b"\r\n")
        sizes = [x.partition(b":")[2].strip() for x in lines if x.lower().startswith(b"content-length:")]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() and len(sizes[0]) < 19 else None
        digest = payload.wanted.hex() if payload.wanted and payload.kind == "sha1" else None
    elif payload.wanted not in (None, sha1.digest() if payload.kind == "sha1" else payload.sum.digest()):
        raise Damaged("wrong payload digest")
    return fields | {"size": size, "sha1": digest, "payload": b"".join(kept) if with_payload else None}


def parse(record: bytes) -> dict:
    """Header fields, size and payload of the one record that the bytes hold."""
    source = _Members(record)
    if not source.next_member() or not source.plain:
        raise _Unframed("no WARC header")
    found = _record(source, True)
    if source.more():
        raise _Unframed("Content-Length does not fit")
    return found


def records(data: bytes | memoryview, with_payload: bool = True) -> Iterator[dict | Damaged]:
    """Every record of an archive, or what is wrong with it. A member may hold several records. After a fault that
    leaves the end of a record unknown the rest of its member is passed over."""
    source = _Members(data)
    while source.next_member():
        try:
            while source.more():
                try:
                    yield _record(source, with_payload)
                except _Unpackable:
                    raise
                except _Unframed as problem:
                    yield problem
                    break
                except Damaged as problem:
                    yield problem
            while source.piece():
                pass
        except Damaged as problem:
            yield problem
            return


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, each file read from its start to its end by one task.

    Columns: path, page_id, record_type, target_uri, refers_to (a page_id), payload_digest (bare lower-case hex SHA-1),
    payload_bytes (of the full payload, also for revisits), payload (null for revisits), problem, record_id,
    refers_to_id. Any archive can be read, packed or plain, with records of any type: page ids are null where a record
    id is not one of ``write_archives``; the payload digest is computed where a record has none or one of another kind
    (a revisit: null), the size of a revisit without a length is null.

    A damaged record gives one row with its path and problem and nothing else; reading goes on with the next record, or
    with the next member where the record's end is unknown. After a member that cannot be inflated the rest of its file
    cannot be found and is not read. Records are inflated in steps, and without payloads none is held; the packed file
    is one value, so it must be below Spark's 2 GB, which ``write_archives`` sees to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([
            ("path", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()),
            ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
            ("payload", pa.binary()), ("problem", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()),
        ])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for row in _rows(name.as_py(), memoryview(content.as_buffer())):
                    size += len(row.get("payload") or b"") if with_payload else 0
                    rows.append(row)
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    def _rows(name: str, content: memoryview) -> Iterator[dict]:
        for f in records(content, with_payload):
            if isinstance(f, Damaged):
                yield {"path": name, "problem": str(f)}
                continue
            kind = f.get("warc-type")
            yield {
                "path": name,
                "page_id": _page_id(f.get("warc-record-id")),
                "record_type": kind,
                "target_uri": f.get("warc-target-uri"),
                "refers_to": _page_id(f.get("warc-refers-to")),
                "payload_digest": f["sha1"],
                "payload_bytes": f["size"],
                "payload": f["payload"] if kind != "revisit" else None,
                "record_id": f.get("warc-record-id"),
                "refers_to_id": f.get("warc-refers-to"),
            }

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = (
        "path string, page_id long, record_type string, target_uri string, refers_to long, payload_digest string, "
        "payload_bytes long, payload binary, problem string, record_id string, refers_to_id string"
    )
    rows = files.mapInArrow(run, kinds)
    return rows.withColumns({"page_id": id_out("page_id"), "refers_to": id_out("refers_to")})


def unresolved_revisits(read: DataFrame) -> DataFrame:
    """What revisits of ``read_archives`` refer to in vain: refers_to_id, payload_digest, n (revisits).

    The record with the named id must be there, be no revisit itself and have the same payload digest (where the
    revisit tells one); a revisit that names no id needs any such record with its digest. Revisits are counted per
    target before they meet the records, so a payload that very many of them share is one row. No revisits, no rows."""
    sound = read.filter("problem IS NULL")
    wanted = sound.filter("record_type = 'revisit'").groupBy("refers_to_id", "payload_digest").agg(F.count("*").alias("n"))
    held = sound.filter("record_type <> 'revisit'")
    by_id = held.select(F.col("record_id").alias("refers_to_id"), F.col("payload_digest").alias("own")).distinct()
    by_digest = held.select("payload_digest").distinct()
    same = F.col("payload_digest").isNull() | (F.col("payload_digest") == F.col("own"))
    named = wanted.filter("refers_to_id IS NOT NULL").alias("w")
    lost = named.join(by_id.alias("h"), (F.col("w.refers_to_id") == F.col("h.refers_to_id")) & same, "left_anti")
    return lost.unionAll(wanted.filter("refers_to_id IS NULL").join(by_digest, "payload_digest", "left_anti").select(*wanted.columns))
