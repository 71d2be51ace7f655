"""Legacy ARC archives to WARC archives and back to rows.

An ARC file begins with a `filedesc:` record that tells its version; each record is one header line, whose fields depend on the
version, and as many bytes as the line declares. The converter reads these and writes equivalent WARC/1.1 records, one gzip
member each: `warcinfo` for the file description, `response` or `revisit` for HTTP answers, `resource` for anything else, with
identifiers derived from what the record is, ISO timestamps and SHA-256 digests of block and payload.

`archive_pages` takes pages through this path: Spark finds equal payloads, each task lays its pages down as ARC files, versions
1 and 2 in turn, converts them and writes WARC files of bounded size to the shared folder under names that a repeated
task overwrites with equal content. `read_archives` reads WARC files back, one row a record, and checks the digests.

Defined results: a null html is an empty payload. White space and control characters in a url are escaped; a null url becomes
`urn:page:` and the identifier. Payloads under `LEAST` bytes are never revisits. Rows with the smallest identifier of a group are
responses, repeated ones too; no rows make an empty folder; a row without an identifier revisits one that has one, else it is a response. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1, sha256
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.llm.tables import shared_folder

LEAST, FILE_BYTES, ARC_BYTES = 100, 4 << 20, 2 << 20
#: The fields of a header line by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    "url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "code": "Result-code",
    "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ["record_id", "record_type", "refers_to_id", "target_uri", "payload_digest", "http"]


class ArcRecord(NamedTuple):
    version: int
    fields: dict[str, str]
    block: bytes


def arc_line(version: int, **fields) -> bytes:
    return (" ".join("-" if fields.get(f) in (None, "") else str(fields[f]) for f in ARC_FIELDS[version]) + "\n").encode()


def arc_file(name: str, version: int, date: str, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, ip, type, block) records."""
    about = f"{version} 0 tarnkit\n{' '.join(TITLES[f] for f in ARC_FIELDS[version])}\n".encode()
    out, place = [], 0
    for url, ip, kind, block in [(f"filedesc://{name}", "0.0.0.0", "text/plain", about), *records]:
        code = block[9:12].decode("latin-1") if block.startswith(b"HTTP/") else "200"
        line = arc_line(version, url=url, ip=ip, date=date, type=kind, code=code, offset=place, filename=name,
                        checksum=sha1(block).hexdigest(), length=len(block))
        out += [line, block, b"\n"]
        place += len(line) + len(block) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the file description first. Gzip members are opened first."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(members(data))
    at, version = 0, 0
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line without end at byte {at}")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        names = ARC_FIELDS.get(version) or ARC_FIELDS[2 if len(parts) == len(ARC_FIELDS[2]) else 1]
        if len(parts) < len(names) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line at byte {at}: {parts[:3]}")
        url = " ".join(parts[:len(parts) - len(names) + 1])
        fields = dict(zip(names, [url, *parts[len(parts) - len(names) + 1:]]))
        size = int(fields["length"])
        block = data[end + 1:end + 1 + size]
        if len(block) < size:
            raise ValueError(f"ARC record at byte {at} declares {size} bytes, {len(block)} are there")
        if not version:
            version = 2 if block[:1] == b"2" else 1
        yield ArcRecord(version, fields, block)
        at = end + 1 + size


def members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of a file."""
    while data:
        opened = zlib.decompressobj(31)
        yield opened.decompress(data) + opened.flush()
        data = opened.unused_data


def iso_date(date: str) -> str:
    """ISO timestamp of a date of 8 to 14 digits."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*what: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(what))}>"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header with its empty line, and payload, of an HTTP answer."""
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def header(block: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", block)
    return found[1].decode("utf-8", "replace") if found else None


def warc_record(arc: ArcRecord, own_id: str, refers_to: str | None = None) -> bytes:
    """The WARC record that stands for an ARC record; a revisit of the record `refers_to` if that is given."""
    fields, block = arc.fields, arc.block
    lines = [("WARC-Record-ID", own_id), ("WARC-Date", iso_date(fields["date"]))]
    if fields["url"].startswith("filedesc:"):
        kind, content = "warcinfo", "application/warc-fields"
        block = (f"format: WARC File Format 1.1\r\nsoftware: tarnkit\r\ndescription: converted from ARC version {arc.version}\r\n"
                 f"isPartOf: {fields['url'].removeprefix('filedesc://')}\r\n").encode()
        lines.append(("WARC-Filename", fields["url"].removeprefix("filedesc://")))
    else:
        lines += [("WARC-Target-URI", fields["url"]), ("WARC-IP-Address", fields["ip"])]
        if block.startswith(b"HTTP/"):
            kind, content = "response", "application/http; msgtype=response"
            head, payload = http_parts(block)
        else:
            kind, content, payload = "resource", fields["type"], block
        lines.append(("WARC-Payload-Digest", f"sha256:{sha256(payload).hexdigest()}"))
        if refers_to:
            kind, block = "revisit", head
            lines += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    lines += [("WARC-Block-Digest", "sha1:" + base64.b32encode(sha1(block).digest()).decode()), ("Content-Type", content)]
    text = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *lines, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + text.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    opened = zlib.compressobj(3, zlib.DEFLATED, 31)
    return opened.compress(data) + opened.flush()


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC file."""
    for record in members(data) if data[:2] == b"\x1f\x8b" else [data]:
        at = 0
        while at < len(record):
            end = record.index(b"\r\n\r\n", at)
            first, *lines = record[at:end].decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {first[:20]}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(fields["content-length"])
            yield fields, record[end + 4:end + 4 + size]
            at = end + 4 + size + 4


def convert_arc(data: bytes, name: str) -> bytes:
    """A gzipped WARC file from an ARC file; identifiers follow from the file's name and the record's place."""
    return b"".join(member(warc_record(x, record_id(name, str(k), x.fields["url"]))) for k, x in enumerate(read_arc(data)))


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder.split("/")[0] else f"file://{folder}")


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file under a name of its own, then give it the final one."""
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{path}/{name}")


def page_block(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def page_url(url: str | None, page_id: int | None) -> str:
    return f"urn:page:{page_id}" if not url else quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")


def page_record_id(page_id: int | None, digest: str) -> str:
    return record_id("page", str(page_id), digest)


def with_first(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html as bytes, digest, first): the smallest page_id of equal payloads that are long enough."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"))
    firsts = rows.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return rows.join(firsts.where("n > 1").select("digest", "first"), "digest", "left").select("page_id", "url", "html", "digest", "first")


def archive_pages(pages: DataFrame, folder: str, date: str = "20200101000000") -> None:
    """Write a WARC record for each page to files in `folder`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, archives = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        done: list[bytes] = []
        size = 0
        for row in chain_rows(batches):
            if row is not None:
                rows.append(row)
                size += len(row[2])
            if rows and (row is None or size >= ARC_BYTES):
                name = f"part-{part:06d}-{archives:06d}.arc"
                legacy = arc_file(name, 1 + archives % 2, date, [(page_url(u, k), "192.0.2.1", "text/html", page_block(k, x)) for k, u, x, _, _ in rows])
                about, *found = read_arc(legacy)
                done.append(member(warc_record(about, record_id(name, "0", about.fields["url"]))))
                for arc, (page_id, _, _, digest, first) in zip(found, rows, strict=True):
                    revisit = page_record_id(first, digest) if first is not None and first != page_id else None
                    own = page_record_id(page_id, digest if revisit is None else f"{digest} in {name} {len(done)}")
                    done.append(member(warc_record(arc, own, revisit)))
                rows, size, archives = [], 0, archives + 1
            if done and (row is None or sum(map(len, done)) >= FILE_BYTES):
                put(folder, f"part-{part:06d}-{files:06d}.warc.gz", b"".join(done))
                done, files = [], files + 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int32())], names=["files"])

    def chain_rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield tuple(x[k].as_py() for x in batch.columns)
        yield None

    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    ordered = with_first(pages).sortWithinPartitions("page_id", "digest", "url")
    ordered.mapInArrow(work, "files int").agg(F.sum("files")).first()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (record_id, record_type, refers_to_id, target_uri, payload_digest, http) of all records but descriptions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows: list[tuple] = []
                for fields, block in read_warc(batch.column(0)[k].as_py()):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    head, payload = http_parts(block) if "http" in fields["content-type"] else (b"", block)
                    if fields["warc-type"] != "revisit" and sha256(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {fields['warc-record-id']} does not match its payload")
                    rows.append((fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"),
                                 fields["warc-target-uri"], digest, head.decode("utf-8", "replace")))
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], names=RECORD)



    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(work, ", ".join(f"{n} string" for n in RECORD))


def pages_of(records: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of archived pages."""
    rows = records.select(
        F.regexp_extract("http", r"(?m)^X-Page-Id: (-?\d+)", 1).alias("page"),
        F.regexp_extract("http", r"(?m)^Content-Length: (\d+)", 1).cast("long").alias("payload_bytes"),
        "payload_digest", "record_type", "record_id", "refers_to_id").withColumn(
        "page_id", F.when(F.col("page") != "", F.col("page")).cast("long"))
    wanted = rows.where(F.col("refers_to_id").isNotNull()).select(F.col("refers_to_id").alias("first_id")).distinct()
    answered = rows.where("record_type = 'response'").select(F.col("record_id").alias("first_id"), "page_id").join(
        wanted, "first_id").groupBy("first_id").agg(F.min("page_id").alias("refers_to"))
    return rows.join(answered.withColumnRenamed("first_id", "refers_to_id"), "refers_to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Rows of `pages_of` after all pages went through archives in a new folder of the shared one."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    archive_pages(pages, folder)
    return pages_of(read_archives(spark, folder))
