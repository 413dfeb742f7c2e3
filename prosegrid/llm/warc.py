"""Legacy archives: ARC files are read by their version's header line and converted to WARC.

An ARC file starts with a version block whose second line names the version: records of version
1 have the header line ``URL IP-address Archive-date Content-type Archive-length``, those of version
2 also result code, checksum, location, offset and file name before the length. The declared length
delimits a record. The converter synthesises for each record a WARC-Record-ID, a WARC-Date, the
record type, block and payload digests (SHA-1) and lengths; a record whose payload is held by
another record becomes a revisit of it, with the HTTP headers but without the payload.

Archives are written by Spark's text writer (gzip files of about ``FILE_BYTES`` of records each, or one
longer record, the record separator being the line separator) and read back as whole files, so both
go through the file system that Spark uses. The reader recomputes the digest of every block, and of
every payload that a record holds, and refuses a record that does not match its header.

Payloads are compared by digests; rows that need no comparison are dealt out by their keys, and
equal payloads over ``SALTS`` parts, as one of them may be that of a third of all pages.

Defined cases: a null payload is empty; a null URL is ``about:blank``; white space in URLs is
percent-encoded, as header lines are cut at blanks; of rows with equal payloads and the same
largest id each is a response; rows with a null id revisit the largest id if there is one;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrid.llm.base import arrow_map, releasing, scratch_path, slices, utf8

REVISIT_BYTES = 1000
FILE_BYTES = 32 << 20  # of records, before compression
SALTS = 16
# The header lines of ARC versions 1 and 2, and the WARC revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes


def clean_uri(uri: str | None) -> str:
    """A URI that fits into a header line: blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "") or "about:blank"


def write_arc(records: list[tuple[str, str, str, str, bytes]], version: int, name: str, date: str) -> bytes:
    """An ARC file of records (uri, ip, date, type, block)."""
    origin = f"{version} 0 prosegrid\n{ARC_FIELDS[version]}\n\n".encode()
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(origin)}\n".encode() + origin]
    offset = len(out[0])
    for uri, ip, when, kind, block in records:
        middle = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}"
        out.append(f"{uri} {ip} {when} {kind}{middle} {len(block)}\n".encode() + block + b"\n")
        offset += len(out[-1])
    return b"".join(out)


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file (its version block first), by header lines and declared lengths."""
    at = 0
    version = 1
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without end at byte {at}")
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:  # the line end after a block
            at = end + 1
            continue
        values = line.split(" ")
        length = int(values[-1])
        block = content[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"{values[0]} declares {length} bytes but {len(block)} are left")
        if at == 0 and values[0].startswith("filedesc:"):
            version = int(block.split(b" ", 1)[0])
        names = ARC_FIELDS[version].split(" ")
        if at == 0 and len(values) != len(names):  # version blocks with the short line
            names = ARC_FIELDS[1].split(" ")
        if len(values) != len(names):
            raise ValueError(f"a version {version} header line has {len(names)} fields, this one {len(values)}: {line[:200]!r}")
        yield ArcRecord(version, dict(zip(names, values)), block)
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the empty line, payload) of an HTTP response; no headers: all is payload."""
    if block.startswith(b"HTTP/"):
        for mark in (b"\r\n\r\n", b"\n\n"):
            if (n := block.find(mark)) >= 0:
                return block[: n + len(mark)], block[n + len(mark) :]
    return b"", block


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    """``YYYYMMDDhhmmss`` (or a prefix) as a WARC date."""
    d = arc_date + "00000101000000"[len(arc_date) :] if len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def header_of(http: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", http)
    return found[1].decode("utf-8", "replace").strip() if found else None


def convert(record: ArcRecord, origin: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; ``origin`` (record id, uri, key) makes it a revisit."""
    uri, when = record.fields["URL"], warc_date(record.fields["Archive-date"])
    if uri.startswith("filedesc:"):
        kind, block = "warcinfo", f"software: prosegrid\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/{record.version}\r\n".encode()
        more = {"Content-Type": "application/warc-fields"}
    else:
        http, payload = split_http(record.block)
        kind, block = ("revisit", http) if origin else ("response" if http else "resource", record.block)
        more = {"WARC-Target-URI": uri, "WARC-IP-Address": record.fields["IP-address"], "WARC-Payload-Digest": digest(payload)}
        if origin:
            more |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": origin[0], "WARC-Refers-To-Target-URI": origin[1], "X-Refers-To-Key": origin[2]}
        more["Content-Type"] = "application/http;msgtype=response" if http else record.fields["Content-type"]
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(uri, when, header_of(record.block, "X-Key") or digest(record.block)), "WARC-Date": when, **more, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a WARC file, plain or gzip."""
    stream = io.BytesIO(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {stream.tell() - len(line)}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{headers['WARC-Record-ID']} declares {length} bytes but {len(block)} are left")
        own = {"WARC-Block-Digest": block}
        if headers["WARC-Type"] in ("response", "resource"):
            own["WARC-Payload-Digest"] = split_http(block)[1]
        for name, data in own.items():
            if name in headers and headers[name] != digest(data):
                raise ValueError(f"{headers['WARC-Record-ID']}: {name} does not fit")
        yield headers, block


def originals(pages: DataFrame, *, key: str, url: str, html: str, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(key, url, payload, origin, origin_url): origin is the largest key with the same payload, where that is another's."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(utf8(html), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    several = (
        rows.where("same is not null").groupBy("same")
        .agg(F.max(F.struct("key", "url")).alias("top"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and top.key is not null").select(F.col("same").alias("of"), F.col("top.key").alias("origin"), F.col("top.url").alias("origin_url"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # Rows without a digest find no partner, whatever they are dealt by.
    salted = rows.withColumns({"own_part": F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int"), "by": F.coalesce("same", F.xxhash64("key", "url", "payload").cast("string"))})
    found = salted.join(several, (F.col("by") == F.col("of")) & (F.col("own_part") == F.col("part")), "left")
    other = ~F.col("key").eqNullSafe(F.col("origin"))
    return found.select("key", "url", "payload", F.when(other, F.col("origin")).alias("origin"), F.when(other, F.col("origin_url")).alias("origin_url"))


def to_warc(rows: DataFrame, *, date: str = "20240101000000") -> DataFrame:
    """Packs (key, url, payload, origin, origin_url) into ARC files, one of each version for every batch, and converts them.

    The version follows from the page, so it does not depend on how the rows are dealt out. ``file`` numbers
    the files of a task, each of FILE_BYTES of records at least, and of one record more at most.
    """

    def pack(listed: list[dict], version: int) -> list[bytes]:
        if not listed:
            return []
        records, origins = [], {}
        for at, row in enumerate(listed):
            own = "" if row["key"] is None else str(row["key"])
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Key: {own}\r\nContent-Length: {len(row['payload'])}\r\n\r\n"
            records.append((clean_uri(row["url"]), "0.0.0.0", date, "text/html", http.encode() + row["payload"]))
            if row["origin"] is not None:
                uri = clean_uri(row["origin_url"])
                origins[at] = (record_id(uri, warc_date(date), str(row["origin"])), uri, str(row["origin"]))
        arc = write_arc(records, version, f"part-{listed[0]['key']}.arc", date)
        return [convert(record, origins.get(at - 1)) for at, record in enumerate(read_arc(arc))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = size = 0
        for batch in batches:
            for part in slices(batch):
                listed = part.to_pylist()
                of = [1 + zlib.crc32(str(row["key"]).encode()) % 2 for row in listed]
                out = [x for version in (1, 2) for x in pack([row for row, v in zip(listed, of) if v == version], version)]
                numbers = []
                for record in out:
                    if size >= FILE_BYTES:
                        file, size = file + 1, 0
                    size += len(record)
                    numbers.append(file)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(numbers, pa.int32())], names=["record", "file"])

    return rows.mapInArrow(releasing(run), "record binary, file int")


def write_archives(records: DataFrame, path: str) -> None:
    """Writes gzip-compressed WARC files; a record's last line end is the writer's separator."""
    whole = records.select(F.expr("substring(record, 1, octet_length(record) - 2)").cast("string").alias("value"), "file")
    whole.write.options(lineSep="\r\n", compression="gzip").partitionBy("file").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """(key, uri, date, payload_bytes, payload_digest, record_type, refers_to, payload) of the page records of WARC files."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for content in batch.column(0):
            for head, block in read_warc(content.as_py()):
                if head["WARC-Type"] == "warcinfo":
                    continue
                http, payload = split_http(block)
                out.append({
                    "key": header_of(http, "X-Key") or None, "uri": head["WARC-Target-URI"], "date": head["WARC-Date"],
                    "payload_bytes": int(header_of(http, "Content-Length") or len(payload)),
                    "payload_digest": base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
                    "record_type": head["WARC-Type"], "refers_to": head.get("X-Refers-To-Key"), "payload": None if head["WARC-Type"] == "revisit" else payload,
                })
        types = [("key", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
        return pa.RecordBatch.from_pylist(out, schema=pa.schema(types))

    return arrow_map(files, make, "key string, uri string, date string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def archived(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages as archives in the shared folder and returns what reading them back gives."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(to_warc(originals(pages, key=key, url=url, html=html)), path)
    back = read_archives(spark, path)
    kind = pages.schema[key].dataType
    return back.withColumns({"key": F.col("key").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("key", key)
