"""Legacy ARC archives to WARC.

An ARC file begins with a version block that names the fields of its header lines: five for version 1, ten for
version 2. A record is one header line, as many bytes as its last field declares, and a line end. The converter
reads header lines by version and bodies by declared length, and synthesises what WARC asks for: an identifier, an ISO
timestamp, the record type, and SHA-1 digests of block and payload. A record whose payload is already kept
elsewhere becomes a `revisit` that names the record that holds it.

Equal payloads of at least REVISIT_BYTES bytes refer to the record of largest page_id. Which payloads repeat is
found by a pre-aggregated maximum for each digest; payloads themselves don't meet in one task.

Defined results: null html is an empty payload; a null url is an empty one; page_id null stays null and is smaller
than all; repeated rows that are the one to refer to are all responses; an empty table gives no rows; other
columns are ignored. Archives are cut at ARCHIVE_BYTES, so a worker's memory is bounded by that and one record. A head may
end its lines with LF alone; a foreign X-Page-Id that is no number of 64 bits counts as none, and the record's key is then
a hash of its header line and payload; a head without a blank line is all head.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import map_batches, stored, table

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 4 << 20
#: What a record takes besides its body, about.
HEADER_BYTES = 200
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The fields of header lines by version of the ARC format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


#: The blank line after a head; archives of that age often end lines with a bare LF.
BLANK = re.compile(rb"\r?\n\r?\n")
PAGE = re.compile(r"-?[0-9]{1,19}")


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    body: bytes


def arc_header(version: int, values: dict[str, str]) -> bytes:
    clean = ("".join("%20" if c == " " else f"%{ord(c):02X}" if ord(c) < 32 else c for c in values.get(f, "-")) or "-" for f in FIELDS[version])
    return " ".join(clean).encode("utf-8", "surrogatepass") + b"\n"


def write_arc(version: int, name: str, records: Iterable[ArcRecord]) -> bytes:
    """An uncompressed ARC file."""
    out = io.BytesIO()
    about = f"{version} 0 causeway\n{' '.join(FIELDS[version])}\n".encode() + b"\n"
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20240101000000", "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Filename": name, "Archive-length": str(len(about))}
    out.write(arc_header(version, values) + about + b"\n")
    for r in records:
        values = r.fields | {"Offset": str(out.tell()), "Filename": name, "Archive-length": str(len(r.body))}
        out.write(arc_header(version, values) + r.body + b"\n")
    return out.getvalue()


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, without its version block."""
    at, fields = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] == b"\n":  # blank lines between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a header line without an end")
        line = data[at:end].decode("utf-8", "surrogatepass")
        described = line.startswith("filedesc://")
        values = line.split(" ")
        if described:
            fields = FIELDS[1] if len(values) == len(FIELDS[1]) else FIELDS[2]
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields in a header line, not {len(fields)}")
        length = int(values[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError("a body shorter than its declared length")
        at = end + 1 + length
        if described:
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = FIELDS[version]
        else:
            yield ArcRecord(dict(zip(fields, values, strict=True)), body)


def record_id(key: int | None, digest: bytes) -> str:
    """A version 8 UUID that holds a 64-bit key (and whether there is one) and 57 bits of the digest."""
    k, rest = (key or 0) & (2**64 - 1), int.from_bytes(digest[:8], "big") >> 7
    bits = (k >> 16) << 80 | 8 << 76 | ((k >> 4) & 0xFFF) << 64 | 2 << 62 | (k & 0xF) << 58 | (key is None) << 57 | rest
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def key_of(identifier: str) -> int | None:
    bits = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    k = (bits >> 80) << 16 | ((bits >> 64) & 0xFFF) << 4 | (bits >> 58) & 0xF
    return None if bits >> 57 & 1 else k - 2**64 if k >> 63 else k


def digest_name(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def iso_date(arc_date: str) -> str:
    d = (arc_date if arc_date.isdigit() else "").ljust(4, "0")[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload; a body that isn't HTTP is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    cut = BLANK.search(body)
    return (body[: cut.end()], body[cut.end() :]) if cut else (body, b"")


def head_value(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\n"):
        k, _, v = line.partition(b":")
        if k.strip().lower() == name:
            return v.strip().decode("utf-8", "replace")
    return None


def own_key(head: bytes) -> tuple[bool, int | None]:
    """Whether a head names a page of ours, and which; a foreign header of that name doesn't."""
    own = head_value(head, b"x-page-id")
    if own == "null":
        return True, None
    if own is not None and PAGE.fullmatch(own) and -(2**63) <= int(own) < 2**63:
        return True, int(own)
    return False, None


def to_warc(record: ArcRecord, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record. `refers_to`: the key of the record that holds the payload, if this is a revisit."""
    head, payload = split_http(record.body)
    digest = hashlib.sha1(payload).digest()
    ours, key = own_key(head)
    if not ours:
        key = int.from_bytes(hashlib.sha1(repr(sorted(record.fields.items())).encode() + digest).digest()[:8], "big", signed=True)
    block = head if revisit else record.body
    fields = {
        "WARC-Type": "revisit" if revisit else "response" if head else "resource",
        "WARC-Record-ID": record_id(key, digest),
        "WARC-Date": iso_date(record.fields["Archive-date"]),
        "WARC-Target-URI": record.fields["URL"],
        "WARC-IP-Address": record.fields["IP-address"],
        "WARC-Payload-Digest": digest_name(digest),
        "WARC-Block-Digest": digest_name(hashlib.sha1(block).digest()),
        "Content-Type": "application/http; msgtype=response" if head else record.fields["Content-type"],
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "WARC-Payload-Length": str(len(payload))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def convert(arc: bytes, refers: Iterable[tuple[bool, int | None]] | None = None) -> bytes:
    """A WARC file, one gzip member for each record of the ARC file."""
    out, kinds = [], iter(refers) if refers is not None else None
    for record in read_arc(arc):
        revisit, to = next(kinds) if kinds is not None else (False, None)
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        out.append(z.compress(to_warc(record, to, revisit)) + z.flush())
    return b"".join(out)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file with one gzip member per record."""
    view, at = memoryview(data), 0
    while at < len(view):
        # A record is fed bit by bit, so that the rest of the archive isn't copied for each.
        z = zlib.decompressobj(31)
        parts = []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a record without an end")
            fed = view[at : at + 4096]
            parts.append(z.decompress(fed))
            at += len(fed)
        at -= len(z.unused_data)
        raw = b"".join(parts)
        top, _, rest = raw.partition(b"\r\n\r\n")
        lines = top.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if digest_name(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
            raise ValueError("a block that doesn't fit its digest")
        yield fields, block


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[ArcRecord] = []
    refers: list[tuple[bool, int | None]] = []
    size = serial = 0
    part = TaskContext.get().partitionId()

    def done() -> pa.RecordBatch:
        version = 1 + (part + serial) % 2
        arc = write_arc(version, f"part-{serial:05d}.arc", waiting)
        return pa.RecordBatch.from_arrays([pa.array([len(waiting)], pa.int64()), pa.array([convert(arc, refers)], pa.binary())], ["records", "warc"])

    for b in batches:
        for page, url, html, revisit, to in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to")), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'null' if page is None else page}\r\n\r\n"
            fields = {"URL": url or "", "IP-address": "0.0.0.0", "Archive-date": "20240101000000", "Content-type": "text/html", "Result-code": "200"}
            waiting.append(ArcRecord(fields, head.encode() + payload))
            refers.append((revisit, to))
            size += len(payload) + len(head) + HEADER_BYTES
            if size >= ARCHIVE_BYTES:
                yield done()
                waiting, refers, size = [], [], 0
                serial += 1
    if waiting:
        yield done()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for warc in b["warc"].to_pylist():
            for fields, block in read_warc(warc):
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                revisit = fields["WARC-Type"] == "revisit"
                if revisit:
                    length, to = int(fields["WARC-Payload-Length"]), key_of(fields["WARC-Refers-To"])
                else:
                    payload = split_http(block)[1]
                    length, to = len(payload), None
                    if hashlib.sha1(payload).digest() != digest:
                        raise ValueError("a payload that doesn't fit its digest")
                rows.append((key_of(fields["WARC-Record-ID"]), length, digest.hex(), fields["WARC-Type"], to))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html with `revisit` and `refers_to`."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size"))
    repeated = rows.select("page_id", "digest", "size").where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("holder")).where("n > 1")
    # Joined on the reversed digest: both sides are then dealt anew, so that a hot digest can be split between tasks.
    repeated = repeated.select(F.reverse("digest").alias("match"), "holder")
    keyed = rows.withColumn("match", F.when(F.col("size") >= REVISIT_BYTES, F.reverse("digest")).otherwise(F.concat(F.reverse("digest"), F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    out = keyed.join(repeated, "match", "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return out.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("holder")).alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """One row per archive: `warc` holds the file. Written to the shared folder and read from there."""
    return stored(map_batches(with_revisits(pages), _archives, "records long, warc binary"), "archives")


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive as a `.warc.gz` file of its own in a folder that executors share (any file system that Arrow knows): path, records, bytes.

    A file is named by its content and put in place whole, so a task that runs again changes nothing.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        fs, root = files.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            rows = []
            for records, warc in zip(b["records"].to_pylist(), b["warc"].to_pylist(), strict=True):
                name = f"{hashlib.sha1(warc).hexdigest()}.warc.gz"
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write(warc)
                fs.move(part, f"{root}/{name}")
                rows.append((f"{folder}/{name}", records, len(warc)))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return stored(map_batches(archives.select("records", "warc"), f, "path string, records long, bytes long"), "exported")


def read_archives(archives: DataFrame) -> DataFrame:
    return map_batches(archives.select("warc"), _records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


SQL_OP8 = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha1(body) as payload_digest from p),
h as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as holder from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {REVISIT_BYTES} and page_id <> holder then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {REVISIT_BYTES} and page_id <> holder then holder end as refers_to
from h
"""
